"""Ordered layout: packing with reset, part navigation, sections, slugs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _packed(rows: DataFrame, group: str, pos: str, size: str, limit: float, most: int | None) -> DataFrame:
    """group, pos, size, bin. One sorted pass over each task's rows; a group's rows follow one another,
    and nothing but the open bin's sums is kept between them."""
    kinds = dict(rows.dtypes)
    key = kinds[group]

    def walk(batches):
        last, number, total, count = object(), 0, 0.0, 0
        for batch in batches:
            bins = []
            for g, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if g != last:
                    last, number, total, count = g, 1, 0.0, 0
                if count and (total + x > limit and (total > 0 or most is not None) or most is not None and count >= most):
                    number, total, count = number + 1, 0.0, 0
                bins.append(number)
                total, count = total + x, count + 1
                if most is None and x > limit:
                    number, total, count = number + 1, 0.0, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins, pa.int32())], names=["g", "pos", "size", "bin"])

    each = rows.select(F.col(group).alias("g"), F.col(pos).cast("long").alias("pos"), F.coalesce(F.col(size).cast("double"), F.lit(0.0)).alias("size"))
    done = each.repartition("g").sortWithinPartitions("g", "pos", "size").mapInArrow(walk, f"g {key}, pos long, size double, bin int")
    return done.select(F.col("g").alias(group), F.col("pos").alias(pos), F.col("size").alias(size), "bin")


def pack_groups(rows: DataFrame, group: str, pos: str, size: str, limit: int) -> DataFrame:
    """group, pos, size, bin: each group's rows, in order, packed into bins from 1.

    A new bin starts when the running size would pass ``limit`` and the bin has something;
    a piece larger than ``limit`` closes its bin. A group of any size is packed in time in
    proportion to its rows, and in bounded memory."""
    return _packed(rows, group, pos, size, limit, None)


def pack_two(rows: DataFrame, group: str, pos: str, size: str, most: int, limit: int) -> DataFrame:
    """As ``pack_groups`` with a second limit, at most ``most`` rows in a bin; a large piece leaves its bin open."""
    return _packed(rows, group, pos, size, limit, most)


def part_links(parts: DataFrame, topic: str, order: str, path: str) -> DataFrame:
    """``parts`` with previous and following: the neighbours' paths within the topic."""
    w = Window.partitionBy(topic).orderBy(order)
    return parts.withColumn("previous", F.lag(path).over(w)).withColumn("following", F.lead(path).over(w))


def owner_of_structure(lines: DataFrame, group: str, pos: str, claim: str) -> DataFrame:
    """``lines`` with owner: the claim at the line or the next one after it; after the last claim, the last one."""
    ahead = Window.partitionBy(group).orderBy(pos).rowsBetween(0, Window.unboundedFollowing)
    behind = Window.partitionBy(group).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("owner", F.coalesce(F.first(claim, ignorenulls=True).over(ahead), F.last(claim, ignorenulls=True).over(behind)))


def ordinal_match(left: DataFrame, right: DataFrame, group: str, text: str, lpos: str, rpos: str) -> DataFrame:
    """group, text, lpos, rpos: the n-th equal line meets the n-th equal claim."""
    number = lambda df, pos: df.withColumn("__n", F.row_number().over(Window.partitionBy(group, text).orderBy(pos)))
    return number(left, lpos).join(number(right, rpos), [group, text, "__n"]).select(group, text, lpos, rpos)


def blank_runs(lines: DataFrame, group: str, pos: str, text: str, most: int = 2) -> DataFrame:
    """``lines`` without blank ones beyond ``most`` in a row."""
    w = Window.partitionBy(group).orderBy(pos)
    blank = F.trim(text) == ""
    rows = lines.withColumn("__island", F.sum(F.when(blank, 0).otherwise(1)).over(w))
    run = Window.partitionBy(group, "__island", blank).orderBy(pos)
    return rows.withColumn("__n", F.row_number().over(run)).where(~blank | (F.col("__n") <= most)).drop("__island", "__n")


def sections(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key, section_no, heading, level, n_lines: Markdown sections; lines before the first heading are section 0."""
    lines = pages.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    head = F.col("line").rlike(r"^#{1,6}\s+")
    w = Window.partitionBy(key).orderBy("pos")
    rows = lines.withColumn("section_no", F.sum(head.cast("int")).over(w))
    heading = F.when(head, F.regexp_replace("line", r"^#{1,6}\s+", ""))
    level = F.when(head, F.length(F.regexp_extract("line", "^(#+)", 1)))
    return rows.groupBy(key, "section_no").agg(F.max(heading).alias("heading"), F.max(level).alias("level"), F.count_if(~head).alias("n_lines"))


def nearest_above(pos: str, level: str, levels: int = 6) -> Column:
    """For a window function's row: the position of the nearest heading before it with a smaller level.
    One running value for each level of headings, none of a group's history."""
    return F.greatest(*[F.when(F.coalesce(F.col(level), F.lit(levels + 1)) > k, F.col(f"__h{k}")) for k in range(1, levels + 1)], F.lit(None).cast("long"))


def parents(fragments: DataFrame, key: str, pos: str, level: str, levels: int = 6) -> DataFrame:
    """``fragments`` with parent: the position of the nearest heading before it with a smaller level
    (1 to ``levels``; null for rows that are no heading, below all of them)."""
    before = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    last = {f"__h{k}": F.last(F.when(F.col(level) == k, F.col(pos).cast("long")), ignorenulls=True).over(before) for k in range(1, levels + 1)}
    return fragments.withColumns(last).withColumn("parent", nearest_above(pos, level, levels).cast(fragments.schema[pos].dataType)).drop(*last)


def unique_slugs(rows: DataFrame, base: str, order: str) -> DataFrame:
    """``rows`` with slug: the base, and from the second on a suffix -2, -3, ... in order."""
    w = Window.partitionBy(base).orderBy(order)
    n = F.row_number().over(w)
    return rows.withColumn("__n", n).withColumn("slug", F.when(F.col("__n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), F.col("__n").cast("string")))).drop("__n")


def chunks(lines: DataFrame, pos: str, size: int = 240) -> DataFrame:
    """``lines`` with chunk: fixed-size runs by position from 1."""
    return lines.withColumn("chunk", F.floor((F.col(pos) - 1) / size).cast("long"))


def module_prefixes(rows: DataFrame, path: str) -> DataFrame:
    """prefix, depth, n: how many rows stand below each prefix of a slash-separated path."""
    parts = F.split(path, "/")
    each = rows.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("prefix"), i.alias("depth")))).alias("x"))
    return each.groupBy("x.prefix", "x.depth").agg(F.count("*").alias("n"))


def nested_sections(docs: DataFrame, key: str, text: str, levels: int = 6) -> DataFrame:
    """key, line_no, heading, level, line_end, body, substantive: every heading with all below it up to the next heading of
    its level or a smaller one.

    line_end is the last line of that; body the lines that are no headings; substantive whether it has four letters or
    digits. One sorted pass keeps, for each level, where its last heading stands; a line belongs to those headings that no
    later one of a smaller level has closed, ``levels`` at most. A null text has no sections."""
    lines = docs.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)).alias("p", "line")).withColumn("line_no", F.col("p") + 1)
    level = F.when(F.col("line").rlike(r"^#{1,6}\s+"), F.length(F.regexp_extract("line", "^(#+)", 1)))
    upto = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("level", level)
    last = [F.last(F.when(F.col("level") == k, F.col("line_no")), ignorenulls=True).over(upto).alias(f"__h{k}") for k in range(1, levels + 1)]
    rows = rows.select(key, "line_no", "line", "level", *last)
    nothing = F.lit(0)
    closed = lambda k: F.greatest(nothing, nothing, *[F.coalesce(f"__h{j}", nothing) for j in range(1, k)])
    open_ = F.array_compact(F.array(*[F.when(F.col(f"__h{k}") > closed(k), F.col(f"__h{k}")) for k in range(1, levels + 1)]))
    each = rows.select(key, "line_no", "line", "level", F.explode(open_).alias("at"))
    own = F.col("line_no") == F.col("at")
    inside = F.sort_array(F.collect_list(F.when(F.col("level").isNull(), F.struct("line_no", "line"))))
    found = each.groupBy(key, "at").agg(F.max(F.when(own, F.col("line"))).alias("head"), F.max(F.when(own, F.col("level"))).alias("level"), F.max("line_no").alias("line_end"), F.array_join(F.transform(inside, lambda x: x["line"]), "\n").alias("body"))
    letters = F.char_length(F.regexp_replace("body", r"[^\p{L}\p{N}]+", ""))
    return found.select(key, F.col("at").alias("line_no"), F.regexp_replace("head", r"^#{1,6}\s+", "").alias("heading"), "level", "line_end", "body", (letters >= 4).alias("substantive"))
