"""Exact quantiles by distributed selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.similarity import stored


def exact_quantiles(rows: DataFrame, groups: list[str], score: str, shares: list[float]) -> DataFrame:
    """groups, q: an array with the quantile at each of ``shares`` (0 to 1), linear between neighbours; nulls and NaNs don't
    count, and a group without values has no row. Null groups are groups.

    Equal scores of a group become one row with a weight, before anything is shuffled whole; those are sorted by range
    partitioning. A small table of weights by (partition, group) says which partition holds each rank, and only those
    partitions are ranked row by row. No task holds a group's values: a partition is a share of all distinct ones, and a group
    has one row for each partition that it reaches."""
    if not shares or any(not 0 <= s <= 1 for s in shares):
        raise ValueError("shares must be from 0 to 1")
    g = [F.col(c).alias(f"__g{i}") for i, c in enumerate(groups)]
    names = [f"__g{i}" for i in range(len(groups))]
    value = F.col(score).cast("double")
    weighed = rows.select(*g, value.alias("x")).where("x IS NOT NULL AND NOT isnan(x)").groupBy(*names, "x").agg(F.count("*").alias("n"))
    dealt = stored(weighed.repartitionByRange(*names, "x").select(*names, "x", "n", F.spark_partition_id().alias("part")))
    inside = dealt.groupBy(*names, "part").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*names)
    whole = F.sum("n").over(w)
    before = F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = inside.select(*names, "part", "n", before.alias("before"), whole.alias("total"))
    # ranks from nought: the value at or below the place, and the next one
    place = lambda s: (F.col("total") - 1) * F.lit(float(s))
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.floor(place(s)).alias("low"), F.ceil(place(s)).alias("high"), (place(s) - F.floor(place(s))).alias("share")) for i, s in enumerate(shares)])
    asked = spans.withColumn("r", F.explode(ranks)).withColumn("rank", F.explode(F.array_distinct(F.array("r.low", "r.high"))))
    asked = asked.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
    asked = stored(asked.select(*[F.col(c).alias(f"a{c}") for c in names], F.col("part").alias("a_part"), "before", "rank", "r"))
    at_home = lambda a, b: [a[c].eqNullSafe(b[f"a{c}"]) for c in names] + [a["part"] == b["a_part"]]
    needed = asked.select(*[f"a{c}" for c in names], "a_part", "before").distinct()
    near = dealt.join(needed, at_home(dealt, needed)).select(*names, "part", "x", "n", "before")
    upto = F.sum("n").over(Window.partitionBy(*names, "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    near = near.select(*names, "part", "x", (F.col("before") + upto - F.col("n")).alias("start"), (F.col("before") + upto).alias("stop"))
    hit = near.join(asked.drop("before"), [*at_home(near, asked), (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("stop"))])
    low, high = F.max(F.when(F.col("rank") == F.col("r.low"), F.col("x"))), F.max(F.when(F.col("rank") == F.col("r.high"), F.col("x")))
    each = hit.groupBy(*names, F.col("r.i").alias("i"), F.col("r.share").alias("share")).agg(low.alias("low"), high.alias("high"))
    each = each.select(*names, "i", (F.col("low") + (F.col("high") - F.col("low")) * F.col("share")).alias("v"))
    out = each.groupBy(*names).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("q")).where(F.size("q") > 0)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, groups, strict=True)], "q")
