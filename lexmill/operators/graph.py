"""Link graphs: reachability, routes, checks. Frontier loops write each level to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.sources.shared import checkpoint_dir


def _checkpointed(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint()


def links(pages: DataFrame, key: str, text: str, pattern: str = r'href="([^"]*)"') -> DataFrame:
    """key, pos, target: link targets in order; fragments cut, external and empty targets left out."""
    each = pages.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), 1)).alias("pos", "target"))
    bare = each.withColumn("target", F.regexp_replace("target", "#.*$", ""))
    return bare.where((F.col("target") != "") & ~F.col("target").rlike("^(?i)(https?|mailto|ftp|data):"))


def normalized_target(source, target):
    """A relative target against its source's folder, '.' and '..' folded; null if it leaves the tree."""
    base = F.regexp_replace(source, "[^/]*$", "")
    parts = F.split(F.concat(base, target), "/")

    def step(acc, p):
        ok = acc["ok"] & ~((p == "..") & (F.size(acc["out"]) == 0))
        out = F.when(p.isin("", "."), acc["out"]).when(p == "..", F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0)))).otherwise(F.concat(acc["out"], F.array(p)))
        return F.struct(ok.alias("ok"), out.alias("out"))

    start = F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(parts, start, step, lambda acc: F.when(acc["ok"], F.array_join(acc["out"], "/")))


def hops(edges: DataFrame, entries: DataFrame, most: int | None = None) -> DataFrame:
    """node, hops: fewest edges (src, dst) from any entry (node), up to ``most``.

    Each level joins only the new nodes, a node is visited once, and each level is stored once, as a table of its own."""
    edges = _checkpointed(edges.select("src", "dst").distinct())
    front = _checkpointed(entries.select("node").distinct().withColumn("hops", F.lit(0)))
    seen, level = front, 0
    while most is None or level < most:
        level += 1
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = _checkpointed(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(level)))
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen


def routes(edges: DataFrame, entry, most: int | None = None) -> DataFrame:
    """node, hops, route: a shortest path from the entry; ties to the link that stands first (pos) on
    the earliest page of the level. Without ``most`` hops given, all nodes that can be reached."""
    spark = edges.sparkSession
    edges = _checkpointed(edges.groupBy("src", "dst").agg(F.min("pos").alias("pos")))
    seen = _checkpointed(spark.createDataFrame([(entry,)], f"node {edges.schema['src'].dataType.simpleString()}").select("node", F.lit(0).alias("hops"), F.array("node").alias("route"), F.array(F.lit(0).cast("int")).alias("order")))
    front, level = seen, 0
    while most is None or level < most:
        level += 1
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node"), F.concat("order", F.array(F.col("pos").cast("int"))).alias("order"), F.concat("route", F.array("dst")).alias("route"))
        best = step.groupBy("node").agg(F.min(F.struct("order", "route")).alias("b")).join(seen.select("node"), "node", "left_anti")
        front = _checkpointed(best.select("node", F.lit(level).alias("hops"), F.col("b.route").alias("route"), F.col("b.order").alias("order")))
        if not front.limit(1).count():
            break
        seen = _checkpointed(seen.unionByName(front.select("node", "hops", "route", "order")))
    return seen.select("node", "hops", "route")


def broken(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges (src, dst) to no page (node)."""
    return edges.join(pages.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")


def one_way(edges: DataFrame) -> DataFrame:
    """Edges without their reverse."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("src", "dst").distinct().join(back, ["src", "dst"], "left_anti")


def broken_jumps(walks: DataFrame, key: str, jumps: str, edges: DataFrame) -> DataFrame:
    """key, pos, src, dst: jumps of a walk that are no edge."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(jumps) - 1), lambda i: F.struct(i.alias("pos"), F.element_at(jumps, i).alias("src"), F.element_at(jumps, i + 1).alias("dst")))
    steps = walks.where(F.size(jumps) >= 2).select(key, F.explode(pairs).alias("j")).select(key, "j.pos", "j.src", "j.dst")
    return steps.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select(key, "pos", "src", "dst")


def path_relations(mapping: DataFrame, old: str, new: str) -> DataFrame:
    """old, new, relation of a bipartite mapping: rename, merge, split or both."""
    n_new = mapping.groupBy(old).agg(F.count_distinct(new).alias("nn"))
    n_old = mapping.groupBy(new).agg(F.count_distinct(old).alias("no"))
    rows = mapping.select(old, new).distinct().join(n_new, old).join(n_old, new)
    kind = F.when((F.col("nn") > 1) & (F.col("no") > 1), "split_merge").when(F.col("nn") > 1, "split").when(F.col("no") > 1, "merge").otherwise("rename")
    return rows.select(old, new, kind.alias("relation"))
