"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import discard, durable_at


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (a, b: long).

    Each round hooks every node to its smallest neighbour, follows that pointer once more,
    and merges the nodes of a pointer; the edges left between merged nodes go to the next
    round. A star is done in one round, a path of n nodes in about log n. Nothing but
    the number of edges left reaches the driver. Every table is written to the shared
    folder, so that lost executors cost a round at most. Loops and repeated edges do no
    harm; no edges, no rows."""
    spark = edges.sparkSession
    left, path = durable_at(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct(), f"{name}-edges", few=True)
    labels, labels_path = None, None
    while left.limit(1).count():
        both = left.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(left.select(F.col("b").alias("v"), F.col("a").alias("u")))
        hooked = both.groupBy("v").agg(F.least("v", F.min("u")).alias("p"))
        up = hooked.select(F.col("v").alias("p"), F.col("p").alias("q"))
        parent, parent_path = durable_at(hooked.join(up, "p", "left").select("v", F.coalesce("q", "p").alias("p")), f"{name}-parents", few=True)
        if labels is None:
            new_labels, new_path = parent.select(F.col("v").alias("node"), F.col("p").alias("component")), parent_path
        else:
            at = parent.select(F.col("v").alias("component"), F.col("p"))
            new_labels, new_path = durable_at(labels.join(at, "component", "left").select("node", F.coalesce("p", "component").alias("component")), name, few=True)
        pa, pb = parent.select(F.col("v").alias("a"), F.col("p").alias("x")), parent.select(F.col("v").alias("b"), F.col("p").alias("y"))
        rest = left.join(pa, "a").join(pb, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        new_left, new_edges = durable_at(rest, f"{name}-edges", few=True)
        discard(spark, path, *({parent_path, labels_path} - {new_path, None}))
        left, path, labels, labels_path = new_left, new_edges, new_labels, new_path
    discard(spark, path)
    if labels is None:
        return spark.createDataFrame([], "node long, component long")
    return labels
