"""Markdown links: rewriting and unlinking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINK = r"!?\[([^\]]*)\]\(([^)\n]+)\)"


def rewrite(pages: DataFrame, key: str, text: str, targets: DataFrame) -> DataFrame:
    """key, text: links to known targets (target, path) point to their new path, external ones stay, others
    become their label.

    Texts are cut at links; the pieces meet the target table by an equality join and are put
    together again in order."""
    marked = F.split(F.regexp_replace(text, f"({LINK})", "\u0001$1\u0001"), "\u0001", -1)
    pieces = pages.select(key, F.posexplode(marked).alias("pos", "piece"))
    is_link = F.col("piece").rlike(f"^{LINK}$")
    target = F.when(is_link, F.regexp_extract("piece", LINK, 2))
    pieces = pieces.withColumn("target", F.regexp_replace(target, "#.*$", "")).withColumn("anchor", F.regexp_extract(target, "(#.*)$", 1)).withColumn("label", F.regexp_extract("piece", LINK, 1))
    known = pieces.join(targets.select("target", "path"), "target", "left")
    external = F.col("target").rlike(r"^(?i)(https?://|mailto:|data:)") | (F.col("target") == "")
    out = F.when(F.col("target").isNull() | external, F.col("piece")).when(F.col("path").isNotNull(), F.concat(F.lit("["), "label", F.lit("]("), "path", "anchor", F.lit(")"))).otherwise(F.col("label"))
    return known.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", out.alias("o")))), lambda x: x["o"]), "").alias(text))
