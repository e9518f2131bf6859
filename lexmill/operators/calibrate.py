"""Threshold calibration against labelled cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.quantiles import exact_quantiles


def distribution(rows: DataFrame, groups: list[str], score: str) -> DataFrame:
    """count, min, max and exact quartiles (linear interpolation) of a score per group; a group without scores has n 0."""
    ends = rows.groupBy(*groups).agg(F.count(score).alias("n"), F.min(score).alias("min"), F.max(score).alias("max"))
    q = exact_quantiles(rows, groups, score, [0.25, 0.5, 0.75]).toDF(*[f"__{c}" for c in groups], "q")
    both = ends.join(q, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in groups], "left")
    return both.select(*groups, "n", "min", "max", *[F.get("q", F.lit(i)).alias(f"p{p}") for i, p in enumerate((25, 50, 75))])


def separation(rows: DataFrame, group: str, positive: str, score: str) -> DataFrame:
    """group, overlap_count, overlap_rate, margin of the two classes' scores; nulls for a class without cases."""
    pos = F.col(positive)
    ends = rows.groupBy(group).agg(F.min(F.when(pos, F.col(score))).alias("min_pos"), F.max(F.when(~pos, F.col(score))).alias("max_neg"))
    joined = rows.join(F.broadcast(ends), group)
    overlap = (pos & (F.col(score) <= F.col("max_neg"))) | (~pos & (F.col(score) >= F.col("min_pos")))
    return joined.groupBy(group).agg(F.count_if(overlap).alias("overlap_count"), F.count("*").alias("n"), F.first("min_pos").alias("a"), F.first("max_neg").alias("b")).select(group, "overlap_count", (F.col("overlap_count") / F.col("n")).alias("overlap_rate"), (F.col("a") - F.col("b")).alias("margin"))


def classification(rows: DataFrame, group: str, actual: str, predicted: str) -> DataFrame:
    """group, tp, fp, fn, precision, recall, f1; null where a denominator is nought."""
    a, p = F.col(actual), F.col(predicted)
    n = rows.groupBy(group).agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"))
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return n.select(group, "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def denominator_gaps(metrics: DataFrame, group: str) -> DataFrame:
    """group, gap for every metric whose denominator is nought."""
    gaps = F.array_compact(F.array(F.when(F.col("tp") + F.col("fp") == 0, "precision|predicted_positive"), F.when(F.col("tp") + F.col("fn") == 0, "recall|gold_positive")))
    return metrics.select(group, F.explode(gaps).alias("gap"))


def query_accuracy(rows: DataFrame, group: str, query: str, correct: str) -> DataFrame:
    """group, accuracy over distinct queries, conflicts: queries with differing outcomes."""
    each = rows.groupBy(group, query).agg(F.min(correct).alias("lo"), F.max(correct).alias("hi"))
    return each.groupBy(group).agg((F.sum(F.col("lo").cast("int")) / F.count("*")).alias("accuracy"), F.count_if(F.col("lo") != F.col("hi")).alias("conflicts"))


def thresholds(rows: DataFrame, positive: str, score: str) -> DataFrame:
    """high: median of positives; medium: at most high, midpoint of the classes."""
    pos = F.col(positive)
    mid = rows.agg(((F.min(F.when(pos, F.col(score))) + F.max(F.when(~pos, F.col(score)))) / 2).alias("mid"))
    high = exact_quantiles(rows.where(pos), [], score, [0.5]).select(F.get("q", F.lit(0)).alias("high"))
    # one row each; without positives high is null
    return mid.join(high, F.lit(True), "left").select("high", F.least("high", "mid").alias("medium"))


def missing_cells(rows: DataFrame, axes: list[str], split: str, splits: list[str]) -> DataFrame:
    """Cells of the grid of all axis values by splits that hold no case. Axes are low-cardinality labels."""
    grid = rows.select(*axes[:1]).distinct()
    for a in axes[1:]:
        grid = grid.crossJoin(F.broadcast(rows.select(a).distinct()))
    grid = grid.withColumn(split, F.explode(F.array(*map(F.lit, splits))))
    return grid.join(rows.select(*axes, split).distinct(), [*axes, split], "left_anti")


def adoption(metrics: DataFrame, old: str, new: str, new_errors: DataFrame) -> DataFrame:
    """allowed: no new errors, no metric worse, any metric better."""
    m = metrics.agg(F.bool_and(F.col(new) >= F.col(old)).alias("none_worse"), F.bool_or(F.col(new) > F.col(old)).alias("any_better"))
    n = new_errors.agg(F.count("*").alias("n"))
    return m.crossJoin(n).select(((F.col("n") == 0) & F.col("none_worse") & F.col("any_better")).alias("allowed"))
