"""Rule-based classification."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T


@dataclass(frozen=True)
class Rule:
    """Fits where the root is equal (if given), any of ``any`` occurs (if given), and all of ``all`` occur."""

    name: str
    root: str | None
    any: tuple[str, ...]
    all: tuple[str, ...]


def classify(root: str, haystack: str, rules: list[Rule], fallback: str = "unmatched") -> Column:
    """The first rule that fits, by the order given; text is compared case folded."""
    low, out = T.casefold(haystack), F.lit(fallback)
    for rule in reversed(rules):
        fits = F.lit(True) if rule.root is None else T.casefold(root) == rule.root.lower()
        if rule.any:
            hit = F.lit(False)
            for term in rule.any:
                hit = hit | F.contains(low, F.lit(term.lower()))
            fits = fits & hit
        for term in rule.all:
            fits = fits & F.contains(low, F.lit(term.lower()))
        out = F.when(fits, rule.name).otherwise(out)
    return out


def labelled(column: str, labels: dict[str, str]) -> Column:
    """A fixed label map, other values as slugs."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[F.col(column)], T.slug(column))


def tiered_match(records: DataFrame, key: str, tiers: list[tuple[str, Column]], entries: DataFrame) -> DataFrame:
    """key, tier, canonical, status: dimension match by the first tier that has a hit.

    ``tiers``: (name, column of ``records``); ``entries`` (canonical, name): every spelling of each entry. Several
    entries hit by one tier are a conflict. Keys without any hit are unknown. Each tier is
    one equi join on the folded name; the union is ranked per key."""
    hits = None
    for rank, (name, column) in enumerate(tiers):
        own = records.select(F.col(key), F.lit(rank).alias("rank"), F.lit(name).alias("tier"), T.normalize_claim(column).alias("n"))
        hits = own if hits is None else hits.unionByName(own)
    spelt = entries.select("canonical", T.normalize_claim("name").alias("n")).distinct()
    found = hits.join(spelt, "n").groupBy(key, "rank", "tier").agg(F.count_distinct("canonical").alias("n"), F.min("canonical").alias("canonical"))
    first = found.groupBy(key).agg(F.min_by(F.struct("tier", "n", "canonical"), "rank").alias("f"))
    status = F.when(F.col("f").isNull(), "unknown").when(F.col("f.n") > 1, "conflict").otherwise("matched")
    return records.select(key).join(first, key, "left").select(key, F.col("f.tier").alias("tier"), F.when(F.col("f.n") == 1, F.col("f.canonical")).alias("canonical"), status.alias("status"))
