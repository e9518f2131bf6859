"""Vector cache: entries bound to a model, looked up by the text's hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cache_misses(rows: DataFrame, text: str, cache: DataFrame) -> DataFrame:
    """input_hash, text: distinct texts that the cache (input_hash, ...) does not hold."""
    wanted = rows.where(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("input_hash"), F.col(text).alias("text")).dropDuplicates(["input_hash"])
    return wanted.join(cache, "input_hash", "left_anti")


def bound_entries(cache: DataFrame, *, endpoint: str, model: str, dimension: int) -> DataFrame:
    """Entries of one endpoint, model and dimension; others never answer for it."""
    return cache.where((F.col("endpoint_identity") == endpoint) & (F.col("model") == model) & (F.col("dimension") == dimension) & (F.size("vector") == dimension))
