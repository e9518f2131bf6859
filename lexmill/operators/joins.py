"""Joins that are more than one equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def span_join(claims: DataFrame, spans: DataFrame, key: str, start: str, span_start: str, span_end: str, width: int = 64) -> DataFrame:
    """Claims with the spans of the same key that contain their start.

    Spans are dealt into bins of ``width`` lines, so that the join is an equality on (key, bin)
    and a key with very many lines is spread over its bins."""
    a = claims.withColumn("__bin", F.floor(F.col(start) / width))
    b = spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(span_start) / width), F.floor(F.col(span_end) / width))))
    return a.join(b, [key, "__bin"]).where(F.col(start).between(F.col(span_start), F.col(span_end))).drop("__bin")


def shared_targets(rows: DataFrame, target: str, overridden: Column) -> DataFrame:
    """Rows that are not overridden and whose target several rows have."""
    several = rows.groupBy(target).count().where("count > 1").select(target)
    return rows.join(several, target, "left_semi").where(~overridden)


def contained_in_one(sets: DataFrame, key: str, groups: DataFrame, group: str, member: str) -> DataFrame:
    """key, group: for each key whose members all belong to exactly one group. Relational division
    by counting; null where none or several groups hold all members."""
    own = sets.select(key, member).distinct()
    size = own.groupBy(key).agg(F.count("*").alias("size"))
    held = own.join(groups.select(group, member).distinct(), member).groupBy(key, group).agg(F.count("*").alias("n"))
    whole = held.join(size, key).where("n = size").groupBy(key).agg(F.count("*").alias("groups"), F.min(group).alias(group))
    return size.select(key).join(whole, key, "left").select(key, F.when(F.col("groups") == 1, F.col(group)).alias(group))


def compare(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, change: added, removed, changed or same; nulls equal nulls."""
    a, b = old.select(key, F.col(value).alias("x"), F.lit(True).alias("ha")), new.select(key, F.col(value).alias("y"), F.lit(True).alias("hb"))
    change = F.when(F.col("ha").isNull(), "added").when(F.col("hb").isNull(), "removed").when(~F.col("x").eqNullSafe(F.col("y")), "changed").otherwise("same")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def section_impact(old: DataFrame, new: DataFrame, page: str, section: str, value: str) -> DataFrame:
    """page, section, impact: reuse, affected, or uncertain for a page any of whose sections lost its record."""
    a = old.select(page, section, F.col(value).alias("x"))
    b = new.select(page, section, F.col(value).alias("y"))
    both = a.join(b, [page, section], "full_outer")
    lost = F.bool_or(F.col("y").isNull()).over(Window.partitionBy(page))
    impact = F.when(lost, "uncertain").when(F.col("x").eqNullSafe(F.col("y")), "reuse").otherwise("affected")
    return both.select(page, section, impact.alias("impact"))


def one_hop(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node: the seeds and their neighbours along edges (src, dst) either way."""
    forward = edges.join(seeds, edges["src"] == seeds["node"]).select(F.col("dst").alias("node"))
    backward = edges.join(seeds, edges["dst"] == seeds["node"]).select(F.col("src").alias("node"))
    return seeds.unionByName(forward).unionByName(backward).distinct()


def unique_matches(left: DataFrame, right: DataFrame, keys: list[str], rid: str) -> DataFrame:
    """Left rows with the one right row that has their keys; without, if there are none or several."""
    one = right.groupBy(*keys).agg(F.count("*").alias("n"), F.min(rid).alias(rid)).where("n = 1").drop("n")
    return left.join(one, keys, "left")


def pair_reasons(rows: DataFrame, key: str, reasons: dict[str, str]) -> DataFrame:
    """a, b, reasons: pairs a < b that share any of the named columns, and which, sorted.

    One equality join for each column; no join on a disjunction."""
    out = None
    for name, column in sorted(reasons.items()):
        x, y = rows.select(F.col(key).alias("a"), F.col(column).alias("v")), rows.select(F.col(key).alias("b"), F.col(column).alias("v"))
        own = x.join(y, "v").where("a < b").select("a", "b", F.lit(name).alias("reason"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("a", "b").agg(F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))


def either_key(left: DataFrame, key: str, columns: list[str], right: DataFrame, rkey: str, target: str) -> DataFrame:
    """key, target: matches by any of several columns, as a union of equality joins."""
    out = None
    for c in columns:
        own = left.select(key, F.col(c).alias(rkey)).join(right.select(rkey, target), rkey).select(key, target)
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def dependency_violations(rows: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """Values of ``determinant`` that come with more than one ``dependent``."""
    return rows.groupBy(determinant).agg(F.count_distinct(dependent).alias("n")).where("n > 1")


def merge_snapshots(index: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, codes): topics of ``index`` with the relations of ``snapshot``, and what keeps the two from matching one to one.

    Both have topic_id, digest_topic_id, topic_key; the first that is not blank names the row. ``index`` may have
    any other columns; of ``snapshot`` count related_topic_refs, old_path_mapping and related_topic_ids. merged: name, row (all of the
    index row), related_topic_refs, for names that are once on both sides and have no code. codes: side, name, code, n:
    NAME_MISSING (n rows without a name), NAME_REPEATED, NOT_IN_SNAPSHOT, NOT_IN_INDEX, OLD_PATHS_FOREIGN (only the
    index says where pages were), RELATIONS_WITHOUT_EVIDENCE. Both sides meet in one grouping by name, and each sends a count and a
    row for a name: names that repeat a third of all rows meet as one."""
    ids = ("topic_id", "digest_topic_id", "topic_key")
    name = F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in ids])
    kept = F.struct(*[F.col(f"`{c}`") for c in index.columns])
    refs = dict(snapshot.dtypes)["related_topic_refs"]
    kind = index.select(kept.alias("row")).schema["row"].dataType
    no = F.lit(False)
    a = index.select(name.alias("name"), kept.alias("row"), F.lit(None).cast(refs).alias("refs"), no.alias("old_paths"), no.alias("bare"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = snapshot.select(name.alias("name"), F.lit(None).cast(kind).alias("row"), F.col("related_topic_refs").alias("refs"), F.col("old_path_mapping").isNotNull().alias("old_paths"), F.col("related_topic_ids").isNotNull().alias("bare"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    both = a.unionByName(b).groupBy("name").agg(F.first("row", ignorenulls=True).alias("row"), F.first("refs", ignorenulls=True).alias("refs"), F.bool_or("old_paths").alias("old_paths"), F.bool_or("bare").alias("bare"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    named, has_a, has_b = F.col("name").isNotNull(), F.col("a") > 0, F.col("b") > 0
    code = lambda fits, side, label, n: F.when(fits, F.struct(F.lit(side).alias("side"), F.lit(label).alias("code"), n.alias("n")))
    found = F.array_compact(F.array(
        code(~named & has_a, "index", "NAME_MISSING", F.col("a")), code(~named & has_b, "snapshot", "NAME_MISSING", F.col("b")),
        code(named & (F.col("a") > 1), "index", "NAME_REPEATED", F.col("a")), code(named & (F.col("b") > 1), "snapshot", "NAME_REPEATED", F.col("b")),
        code(named & has_a & ~has_b, "index", "NOT_IN_SNAPSHOT", F.col("a")), code(named & has_b & ~has_a, "snapshot", "NOT_IN_INDEX", F.col("b")),
        code(named & F.col("old_paths"), "snapshot", "OLD_PATHS_FOREIGN", F.col("b")), code(named & F.col("bare"), "snapshot", "RELATIONS_WITHOUT_EVIDENCE", F.col("b")),
    ))
    rows = both.withColumn("found", found)
    codes = rows.select("name", F.explode("found").alias("f")).select("f.side", "name", "f.code", "f.n")
    return rows.where(F.size("found") == 0).select("name", "row", F.col("refs").alias("related_topic_refs")), codes
