"""Capture, validation and exact de-duplication of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T


def route_validation(sources: DataFrame, declared: str = "declared_hash", status: str = "source_status") -> DataFrame:
    """``sources`` (text, uri, declared hash, status) with validation_status and validation_reason.

    Checks in order: a declared fingerprint that differs, an empty shell, a missing URI."""
    mismatch = F.col(declared).isNotNull() & (F.col(declared) != T.fingerprint("text"))
    shell = T.is_empty_shell("text", status)
    reason = F.when(mismatch, "fingerprint_mismatch").when(shell, "empty_shell").when(F.coalesce(T.strip("uri"), F.lit("")) == "", "missing_uri").otherwise("passed")
    return sources.withColumn("validation_reason", reason).withColumn("validation_status", F.when(F.col("validation_reason") == "passed", "passed").otherwise("failed"))


def duplicates(sources: DataFrame, content: str = "content_hash", order: str = "path") -> DataFrame:
    """Rows whose content an earlier row (by ``order``) holds, with that row's ``duplicate_of``.

    One aggregate and one join on the hash; no sort of whole groups."""
    first = sources.groupBy(content).agg(F.min(order).alias("duplicate_of"))
    return sources.join(first, content).where(F.col(order) != F.col("duplicate_of"))


def uri_conflicts(sources: DataFrame, uri: str = "uri", content: str = "content_hash") -> DataFrame:
    """URIs under which more than one content stands."""
    return sources.groupBy(uri).agg(F.count_distinct(content).alias("n_contents")).where("n_contents > 1")


def signal_tier(tokens, least_score, high: float = 0.90, medium: float = 0.80):
    """insufficient_signal below three distinct tokens; auto and needs_review by the least pair score."""
    return F.when(F.size(tokens) < 3, "insufficient_signal").when(least_score >= high, "auto").when(least_score >= medium, "needs_review").otherwise("insufficient_signal")


def duplicate_report(sources: DataFrame) -> DataFrame:
    """source, tier and counts: how many sources are unique, duplicates, or too short to tell."""
    first = sources.groupBy("content_hash").agg(F.min("path").alias("first"))
    rows = sources.join(first, "content_hash").withColumn("tier", F.when(F.size(T.tokens("text")) < 3, "insufficient_signal").otherwise("auto"))
    return rows.groupBy("source", "tier").agg(F.count("*").alias("n_sources"), F.count_if(F.col("path") != F.col("first")).alias("n_duplicates"))


def latest_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order`` (unique within a key)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def first_by_key(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key by ``order`` (unique within a key)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
