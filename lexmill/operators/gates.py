"""Quality gates: checks that give codes or verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T


def code_integrity(rows: DataFrame, raw: str, candidate: str) -> DataFrame:
    """``rows`` with integrity: failed if the candidate has fewer of any code signature than the raw text."""
    a, b = T.code_signatures(raw), T.code_signatures(candidate)
    less = F.lit(False)
    for k in ("code_fence_markers", "code_urls", "code_numeric_tokens"):
        less = less | (a[k] > b[k])
    return rows.withColumn("integrity", F.when(less, "failed").otherwise("passed"))


def is_reader_target(path) -> Column:
    """README.md or Home.md at the top, or anything below indexes/ or pages/."""
    x = F.col(path) if isinstance(path, str) else path
    return x.isin("README.md", "Home.md") | x.startswith("indexes/") | x.startswith("pages/")


def reader_leaks(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key, code for every page that shows hashes or internal fields."""
    fields = ("Reader signals", "digest_content_hash", "digest_topic_id", "content_fingerprint", "source_id:")
    internal = F.lit(False)
    for f in fields:
        internal = internal | F.contains(text, F.lit(f))
    codes = F.array_compact(F.array(F.when(F.col(text).rlike(T.INTERNAL_HASH), "HASH_OR_INTERNAL_METADATA"), F.when(internal, "INTERNAL_FIELD")))
    return pages.select(key, F.explode(codes).alias("code"))


def sensitive_lines(claims: DataFrame, evidence: DataFrame, least: int = 12) -> DataFrame:
    """doc_id, n_lines: distinct lines of at least ``least`` characters that stand in the evidence.

    A semi join on the line, not a search of every line in every file."""
    rows = claims.where(F.char_length("claim") >= least).select("doc_id", "claim").distinct()
    return rows.join(evidence.select(F.col("line").alias("claim")).distinct(), "claim", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_lines"))


def faithful(claims: DataFrame, bodies: DataFrame, key: str) -> DataFrame:
    """key, status: faithful if every claim of the key stands in its body, else the fallback."""
    held = claims.join(bodies, key).groupBy(key).agg(F.bool_and(F.contains("body", F.col("claim"))).alias("all"))
    return held.select(key, F.when(F.col("all"), "faithful").otherwise("fallback_claim_concat").alias("status"))


def supported_by_body(claim, body) -> Column:
    """Whether a body carries a claim: verbatim, or with all its numbers and identifiers and at
    least half of its tokens (three or more)."""
    token = r"([a-z0-9]+%?|[一-鿿])"
    x, y = T.normalize_for_gate(F.regexp_replace(claim, r"^\s*(?:[-*+]\s+|[0-9]+\s*[.)、]\s*)", "")), T.normalize_for_gate(body)
    inside = lambda a, b: F.size(F.array_except(a, b)) == 0
    a, b = F.array_distinct(F.regexp_extract_all(x, F.lit(token), 1)), F.array_distinct(F.regexp_extract_all(y, F.lit(token), 1))
    enough = (F.size(a) >= 3) & (F.size(F.array_intersect(a, b)) >= F.greatest(F.lit(3), F.floor((F.size(a) + 1) / 2)))
    return ((x != "") & F.contains(y, x)) | (inside(T.numbers(x), T.numbers(y)) & inside(F.transform(T.identifiers(claim), F.lower), F.transform(T.identifiers(body), F.lower)) & enough)


def summary_valid(summary, source, refers: Column, claims: Column) -> Column:
    """Whether a summary refers to all claims and to no other, and takes every number and identifier from its source."""
    complete = (F.size(F.array_except(claims, refers)) == 0) & (F.size(F.array_except(refers, claims)) == 0)
    return complete & T.facts_kept(summary, source)
