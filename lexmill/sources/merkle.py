"""Manifests of any size as trees of hashes, in which a difference is found by going down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.similarity import stored

#: Entries below a leaf, about; a node above has at most 16 children.
LEAF_ENTRIES = 256
MOST_DEPTH = 12


def depth_for(rows: int, leaf: int = LEAF_ENTRIES) -> int:
    """Levels below the root, so that a leaf holds about ``leaf`` of so many entries."""
    depth, room = 1, 16 * leaf
    while room < rows and depth < MOST_DEPTH:
        depth, room = depth + 1, room * 16
    return depth


def entries(rows: DataFrame, path: str, values: list[str], groups: list[str] | None = None) -> DataFrame:
    """groups, path, at (the hash of the path, by which entries are dealt), entry: one line for each path, nulls as blanks."""
    line: Column = F.concat_ws("|", F.col(path), *[F.coalesce(F.col(v).cast("string"), F.lit("")) for v in values])
    return rows.select(*(groups or []), F.col(path).alias("path"), F.sha2(F.col(path), 256).alias("at"), line.alias("entry"))


def hash_tree(listed: DataFrame, depth: int, groups: list[str] | None = None) -> DataFrame:
    """groups, level, prefix, hash, n: a tree of hashes for each group; level 0 is the root, whose prefix is ''.

    ``listed``: of ``entries``. Paths are dealt by their hashes, which are even whatever the paths are, so that no task
    holds more than a leaf's entries. Repeated entries count each. The hash depends on the entries and the depth alone."""
    g = list(groups or [])
    join = lambda rows, sep: F.sha2(F.array_join(rows, sep), 256)
    leaf = listed.groupBy(*g, F.substring("at", 1, depth).alias("prefix")).agg(join(F.sort_array(F.collect_list("entry")), "\n").alias("hash"), F.count("*").alias("n"))
    level = leaf.withColumn("level", F.lit(depth))
    out = level = stored(level.select(*g, "level", "prefix", "hash", "n"))
    for k in range(depth - 1, -1, -1):
        children = F.sort_array(F.collect_list(F.struct("prefix", "hash")))
        up = level.groupBy(*g, F.substring("prefix", 1, k).alias("prefix")).agg(join(F.transform(children, lambda c: F.concat(c["prefix"], F.lit(":"), c["hash"])), "\n").alias("hash"), F.sum("n").alias("n"))
        level = up.select(*g, F.lit(k).alias("level"), "prefix", "hash", "n")
        out = out.unionByName(level)
    return out


def roots(tree: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """groups, hash, n of each tree; an empty manifest has none."""
    return tree.where("level = 0").select(*(groups or []), "hash", "n")


def changed_paths(old: DataFrame, new: DataFrame, depth: int) -> tuple[DataFrame, int]:
    """(path, change: added, removed or changed; how many pairs of nodes were compared) between two lists of ``entries``.

    Both trees are compared from their roots; only children of nodes that differ are looked at, and at the end only entries
    below leaves that differ are read. Only numbers of nodes reach the driver."""
    a, b = stored(hash_tree(old, depth)), stored(hash_tree(new, depth))
    side = lambda t, k, name: t.where(F.col("level") == k).select("prefix", F.col("hash").alias(name))
    open_, seen = None, 0
    for k in range(depth + 1):
        both = side(a, k, "x").join(side(b, k, "y"), "prefix", "full_outer").withColumn("above", F.substring("prefix", 1, max(k - 1, 0)))
        both = both if open_ is None else both.join(open_.withColumnRenamed("prefix", "above"), "above", "left_semi")
        both = stored(both)
        seen += both.count()
        open_ = both.where("NOT (x <=> y)").select("prefix")
    near = lambda rows, name: rows.withColumn("prefix", F.substring("at", 1, depth)).join(open_, "prefix", "left_semi").groupBy("path").agg(F.sort_array(F.collect_list("entry")).alias(name))
    rows = near(old, "x").join(near(new, "y"), "path", "full_outer").where("NOT (x <=> y)")
    return rows.select("path", F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("changed").alias("change")), seen
