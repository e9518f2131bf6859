"""Routes from many entries at once: one search per distinct entry, all of them in the same rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.similarity import stored


def question_routes(edges: DataFrame, pages: DataFrame, questions: DataFrame) -> DataFrame:
    """question, entry, target, status, hops, route of every question.

    ``edges`` (src, dst, pos: the place of the link on its page), ``pages`` (node), ``questions`` (question, entry, target).
    The route is the one that a reader finds who takes pages in the order in which they were found, and links in the
    order in which they stand. ``status`` is ``reached``, or ``entry_missing`` or ``target_missing`` if that is no page, or
    ``unreachable``. Links to what is no page lead nowhere; of repeated links the first counts.

    All entries are searched in common rounds over (entry, node). Each level is a table of its own, with each node's parent
    and rank: nothing that is known is written again, and no row holds a route until the end, when the questions
    alone walk back from their targets. An entry whose targets are all found is searched no further. Ranks come from a range
    partitioning, so that a level of any size is spread over tasks, and only the number of open rows reaches the driver."""
    node = dict(pages.dtypes)["node"]
    known = stored(pages.select("node").distinct())
    links = edges.groupBy("src", "dst").agg(F.min("pos").alias("pos")).join(known.select(F.col("node").alias("dst")), "dst", "left_semi")
    links = stored(links)
    asked = stored(questions.select("question", "entry", "target"))
    entries = asked.select("entry").distinct().join(known.select(F.col("node").alias("entry")), "entry", "left_semi")
    level = stored(entries.select("entry", F.col("entry").alias("node"), F.lit(None).cast(node).alias("parent"), F.lit(0).cast("long").alias("rank")))
    levels, seen = [level], level.select("entry", "node")
    wanted = stored(asked.select("entry", F.col("target").alias("node")).distinct().join(known, "node", "left_semi").join(entries, "entry", "left_semi"))
    while True:
        # targets that are still to be found keep their entries open
        wanted = stored(wanted.join(levels[-1].select("entry", "node"), ["entry", "node"], "left_anti"))
        front = levels[-1].join(wanted.select("entry").distinct(), "entry", "left_semi")
        step = front.select("entry", F.col("node").alias("parent"), "rank").join(links, F.col("parent") == F.col("src"))
        best = step.groupBy("entry", F.col("dst").alias("node")).agg(F.min(F.struct("rank", "pos", "parent")).alias("b"))
        new = best.join(seen, ["entry", "node"], "left_anti").select("entry", "node", F.col("b.parent").alias("parent"), F.col("b.rank").alias("of"), F.col("b.pos").alias("pos"))
        # in the order of discovery; two nodes have one place only where one page links to both at one pos
        ranked = new.repartitionByRange("of", "pos", "node", "entry").sortWithinPartitions("of", "pos", "node", "entry")
        level = stored(ranked.select("entry", "node", "parent", F.monotonically_increasing_id().alias("rank")))
        if not level.limit(1).count():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("entry", "node"))
    # where each target was found, and from there back to its entry
    at = None
    for hops, found in enumerate(levels):
        own = found.select("entry", F.col("node").alias("target"), F.lit(hops).alias("hops"))
        at = own if at is None else at.unionByName(own)
    hit = stored(asked.join(at, ["entry", "target"]))
    walk = hit.select("question", "entry", "target", "hops", F.col("target").alias("node"), F.array("target").alias("route"))
    for hops in range(len(levels) - 1, 0, -1):
        # a node stands in one level, so that only walks that have come down to this one meet it
        back = levels[hops].select("entry", "node", "parent")
        found = F.col("parent").isNotNull()
        walk = walk.join(back, ["entry", "node"], "left").select("question", "entry", "target", "hops", F.coalesce("parent", "node").alias("node"), F.when(found, F.concat(F.array("parent"), "route")).otherwise(F.col("route")).alias("route"))
        walk = stored(walk) if hops % 4 == 0 else walk
    is_page = lambda column, flag: known.select(F.col("node").alias(column), F.lit(True).alias(flag))
    rows = asked.join(is_page("entry", "has_entry"), "entry", "left").join(is_page("target", "has_target"), "target", "left")
    rows = rows.join(walk.select("question", "entry", "target", "hops", "route").distinct(), ["question", "entry", "target"], "left")
    status = F.when(F.col("hops").isNotNull(), "reached").when(F.col("has_entry").isNull(), "entry_missing").when(F.col("has_target").isNull(), "target_missing").otherwise("unreachable")
    return rows.select("question", "entry", "target", status.alias("status"), "hops", "route")


def check_jumps(answers: DataFrame, routed: DataFrame) -> DataFrame:
    """question, code of answers (question, positive, jumps, first_hit) whose walk is not the route of ``routed``.

    ``ROUTE_MISSING``: no route leads to the target; ``JUMPS_INVALID``: no jumps, or a null one; ``JUMPS_OFF_ROUTE``: other
    jumps than the route; ``HIT_OFF_TARGET``: a positive question's hit is another page; ``NEGATIVE_HIT``: a negative
    question has a hit. A positive question without a hit is sound: the answer, not the walk, is wrong."""
    rows = answers.join(routed.select("question", "target", "route"), "question", "left")
    jumps = F.col("jumps")
    valid = F.coalesce((F.size(jumps) > 0) & ~F.exists(jumps, lambda x: x.isNull()), F.lit(False))
    same = F.coalesce(jumps == F.col("route"), F.lit(False))
    codes = F.array(
        F.when(F.col("route").isNull(), "ROUTE_MISSING"), F.when(~valid, "JUMPS_INVALID"), F.when(valid & F.col("route").isNotNull() & ~same, "JUMPS_OFF_ROUTE"),
        F.when(F.col("positive") & F.col("first_hit").isNotNull() & ~F.col("first_hit").eqNullSafe(F.col("target")), "HIT_OFF_TARGET"), F.when(~F.col("positive") & F.col("first_hit").isNotNull(), "NEGATIVE_HIT"),
    )
    return rows.select("question", F.explode(F.array_compact(codes)).alias("code"))
