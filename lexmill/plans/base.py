"""How queries register, and the tables that they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame under an operator's name, with its SQL."""

    def keep(f):
        if name in QUERIES:
            raise ValueError(f"{name} is there twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


class Tables:
    """The driver's tables by attribute, and the roles that they play."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sources(self) -> DataFrame:
        """documents as captured sources: path, uri, content hash, text."""
        return self.documents.select("doc_id", "source", "lang", "text", source_path().alias("path"), source_uri().alias("uri"), F.sha2("text", 256).alias("content_hash"))

    def claims(self) -> DataFrame:
        """Non-blank lines of documents that are no headings."""
        rows = self.documents.select("doc_id", source_uri().alias("uri"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        text = F.regexp_replace("line", r"^\s+|\s+$", "")
        return rows.select("doc_id", "uri", (F.col("pos") + 1).alias("line_no"), text.alias("claim")).where("claim <> '' AND NOT startswith(claim, '#')")


def source_path():
    return F.concat(F.lit("new/"), F.col("source"), F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))


def source_uri():
    return F.concat(F.lit("doc://"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))


#: The same roles in SQL, to put after WITH.
SOURCES = "src AS (SELECT doc_id, source, lang, text, 'new/' || source || '/doc-' || doc_id || '.md' AS path, 'doc://' || source || '/' || doc_id AS uri, sha256(text) AS content_hash FROM documents)"
CLAIMS = """lines AS (SELECT doc_id, 'doc://' || source || '/' || doc_id AS uri, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
claims AS (SELECT doc_id, uri, CAST(line_no AS INTEGER) AS line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS claim FROM lines WHERE trim(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) <> '' AND NOT starts_with(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '#'))"""
