"""Append-only ledgers: folds to the latest state, upserts, supersession, set checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of a JSON object with sorted keys, no blanks, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def provenance_text(uri: str, locator: Column, prefix: str = "provenance ") -> Column:
    return F.concat(F.lit(prefix), F.to_json(F.struct(locator.alias("locator"), F.col(uri).alias("source_uri"))))


def read_provenance(x, prefix: str = "provenance ") -> Column:
    """The struct that ``provenance_text`` wrote; null for other text."""
    body = F.when(F.col(x).startswith(prefix), F.substring(F.col(x), len(prefix) + 1, 1 << 30))
    return F.from_json(body, "locator string, source_uri string")


def fold_latest(log: DataFrame, keys: list[str], seq: str, columns: list[str]) -> DataFrame:
    """Latest state per key, field by field: each column's last non-null value by ``seq``.

    A map-side-combined aggregate: no sort and no window over a key's whole history."""
    return log.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The union with the last row of each key by ``seq``, and ``first_seq``, the place of its first."""
    rows = old.unionByName(new)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("__r"), F.min(seq).alias("first_seq")).select(*keys, "__r.*", "first_seq")


def active_history(log: DataFrame, status: str, closed: tuple[str, ...], targets: DataFrame, key: str) -> DataFrame:
    """Records of the targets whose status is none of the closed ones."""
    return log.where(~F.col(status).isin(*closed)).join(targets, key, "left_semi")


def growth(log: DataFrame, group: str, seq: str, baseline: int) -> DataFrame:
    """Records of each group after its first ``baseline`` ones."""
    w = Window.partitionBy(group).orderBy(seq)
    return log.withColumn("__n", F.row_number().over(w)).where(F.col("__n") > baseline).drop("__n")


def supersession(log: DataFrame, keys: list[str], seq: str, value: str) -> DataFrame:
    """``log`` with supersedes and superseded_by: neighbours in a key's history that hold another value."""
    w = Window.partitionBy(*keys).orderBy(seq)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return log.withColumn("supersedes", F.when(before != F.col(value), before)).withColumn("superseded_by", F.when(after != F.col(value), after))


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side: 'missing' from b, or 'extra' in b."""
    missing = a.select(key).distinct().join(b, key, "left_anti").select(key, F.lit("missing").alias("side"))
    return missing.unionByName(b.select(key).distinct().join(a, key, "left_anti").select(key, F.lit("extra").alias("side")))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` beyond as many equal rows of ``b``, with ``n``. Counts meet, not rows."""
    keys = a.columns
    left = a.groupBy(*keys).agg(F.count("*").alias("na"))
    right = b.groupBy(*keys).agg(F.count("*").alias("nb"))
    return left.join(right, keys, "left").withColumn("n", F.col("na") - F.coalesce("nb", F.lit(0))).where("n > 0").select(*keys, "n")


def pending_merge(old: DataFrame, new: DataFrame, resolved: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Old pending rows that are not resolved, and new ones; the last per key."""
    rows = old.join(resolved, keys, "left_anti").unionByName(new)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("__r")).select(*keys, "__r.*")


def null_sum(column: str) -> Column:
    """A sum that is null if any input is."""
    return F.when(F.count(column) == F.count("*"), F.sum(column))
