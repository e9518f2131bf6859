"""Pages built from components, and the proof that every line and claim of the sources stands on them once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import scan
from lexmill.operators.joins import span_join
from lexmill.operators.layout import pack_groups

#: Lines that one window of the cover check holds.
STRETCH = 4096


def place_components(docs: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """key, component, kind, line_start, line_end, page, oversized: the components of each document in order, dealt to
    pages of at most ``most`` lines. A component is never broken; one that is longer closes its page and is marked."""
    spans = scan.components(docs, key, text).withColumn("n", F.col("line_end") - F.col("line_start") + 1)
    packed = pack_groups(spans, key, "component", "n", most).select(key, F.col("component").cast("int").alias("component"), F.col("bin").alias("page"))
    return spans.join(packed, [key, "component"]).select(key, "component", "kind", "line_start", "line_end", "page", (F.col("n") > most).alias("oversized"))


def target_path(base: Column, page: Column) -> Column:
    """The first page's path as it is, others with -part-n before ``.md``."""
    stem = F.regexp_replace(base, r"\.md$", "")
    end = F.when(base.endswith(".md"), ".md").otherwise("")
    return F.when(page == 1, base).otherwise(F.concat(stem, F.lit("-part-"), page.cast("string"), end))


def rendered_lines(docs: DataFrame, key: str, text: str, placed: DataFrame) -> DataFrame:
    """key, component, page, line_no, place: non-blank lines as they stand on their page, counted from its first one;
    unsupported lines are not rendered, blank ones between others count."""
    lines = docs.select(key, F.posexplode(T.lines(text)).alias("p", "line")).select(key, (F.col("p") + 1).alias("line_no"), (T.strip("line") == "").alias("blank"), T.is_unsupported("line").alias("left_out"))
    shown = span_join(lines.where("NOT left_out"), placed.select(key, "component", "page", "line_start", "line_end"), key, "line_no", "line_start", "line_end")
    w = Window.partitionBy(key, "page")
    n = F.row_number().over(w.orderBy("line_no"))
    rows = shown.withColumn("n", n).withColumn("first", F.min(F.when(~F.col("blank"), F.col("n"))).over(w))
    return rows.where("NOT blank").select(key, "component", "page", "line_no", (F.col("n") - F.col("first") + 1).cast("int").alias("place"))


def claim_places(claims: DataFrame, key: str, placed: DataFrame, rendered: DataFrame) -> DataFrame:
    """key, claim, component, page, out_start, out_end for ``claims`` (key, claim, line_start, line_end).

    A claim belongs to the component that holds its first line; its place on the page runs over those of its lines that are
    shown there in that component, null if none is. A claim outside all components has a null component."""
    spans = placed.select(key, "component", "page", F.col("line_start").alias("from_line"), F.col("line_end").alias("to_line"))
    owned = span_join(claims.select(key, "claim", "line_start", "line_end"), spans, key, "line_start", "from_line", "to_line")
    shown = rendered.select(F.col(key).alias("__k"), F.col("component").alias("__c"), "line_no", "place")
    mine = (F.col(key) == F.col("__k")) & (F.col("component") == F.col("__c")) & (F.col("line_no") >= F.col("line_start")) & (F.col("line_no") <= F.col("line_end"))
    found = owned.join(shown, mine, "left").groupBy(key, "claim", "component", "page").agg(F.min("place").alias("out_start"), F.max("place").alias("out_end"))
    return claims.select(key, "claim").join(found, [key, "claim"], "left").select(key, "claim", "component", "page", "out_start", "out_end")


def component_places(placed: DataFrame, key: str, rendered: DataFrame) -> DataFrame:
    """key, component, page, out_start, out_end, omitted: where each component stands; one of which nothing is shown is
    omitted and has no page."""
    found = rendered.groupBy(key, "component").agg(F.min("place").alias("out_start"), F.max("place").alias("out_end"))
    rows = placed.select(key, "component", "page").join(found, [key, "component"], "left")
    shown = F.col("out_start").isNotNull()
    return rows.select(key, "component", F.when(shown, F.col("page")).alias("page"), "out_start", "out_end", (~shown).alias("omitted"))


def uneven_cover(spans: DataFrame, key: str, start: str, end: str, extents: DataFrame, low: str, high: str, stretch: int = STRETCH) -> DataFrame:
    """key, line_start, line_end, owners: the lines of ``extents`` (key, low, high) that are not in exactly one span (0: a gap;
    more: an overlap), as the longest runs with one number of owners. No rows: every line is owned once.

    Spans outside an extent, or of a key without one, count for the lines that they cover. Spans are cut at every
    ``stretch`` lines, and each stretch is swept by itself, so that a document of any length is spread over tasks; runs
    that meet at a cut are put together again, and of those there are only the uneven ones."""
    kind = lambda a, b: (F.floor(F.col(a) / stretch).cast("long"), F.floor(F.col(b) / stretch).cast("long"))

    def cut(rows: DataFrame, a: str, b: str, weight: int, inside: int) -> DataFrame:
        first, last = kind(a, b)
        each = rows.where((F.col(a) <= F.col(b)) & F.col(key).isNotNull()).select(key, F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"), F.explode(F.sequence(first, last)).alias("s"))
        return each.select(key, "s", F.greatest("a", F.col("s") * stretch).alias("a"), F.least("b", (F.col("s") + 1) * stretch - 1).alias("b"), F.lit(weight).alias("w"), F.lit(inside).alias("e"))

    pieces = cut(spans, start, end, 1, 0).unionByName(cut(extents, low, high, 0, 1))
    edges = pieces.select(key, "s", F.col("a").alias("at"), "w", "e").unionByName(pieces.select(key, "s", (F.col("b") + 1).alias("at"), (-F.col("w")).alias("w"), (-F.col("e")).alias("e")))
    steps = edges.groupBy(key, "s", "at").agg(F.sum("w").alias("w"), F.sum("e").alias("e"))
    w = Window.partitionBy(key, "s").orderBy("at")
    runs = steps.select(key, "s", "at", (F.lead("at").over(w) - 1).alias("to"), F.sum("w").over(w).alias("owners"), F.sum("e").over(w).alias("inside"))
    runs = runs.where((F.col("to") >= F.col("at")) & ((F.col("owners") > 1) | (F.col("owners") == 0) & (F.col("inside") > 0) | (F.col("owners") == 1) & (F.col("inside") == 0)))
    # runs of one kind that touch are one
    by = Window.partitionBy(key).orderBy("at")
    joined = (F.lag("to").over(by) + 1 == F.col("at")) & (F.lag("owners").over(by) == F.col("owners")) & (F.lag("inside").over(by) == F.col("inside"))
    marked = runs.withColumn("new", F.when(joined, 0).otherwise(1)).withColumn("run", F.sum("new").over(by))
    return marked.groupBy(key, "run", "owners").agg(F.min("at").alias("line_start"), F.max("to").alias("line_end")).select(key, "line_start", "line_end", F.col("owners").cast("long").alias("owners"))


def topic_layouts(drafts: DataFrame, placed: DataFrame, key: str, most: int) -> DataFrame:
    """topic, n_drafts, n_lines, n_pages, first_key, oversized: one layout for each topic of ``drafts`` (topic, key), whose
    drafts follow one another by key, components unbroken, on pages of at most ``most`` lines; n_pages is what that takes.

    The components of all drafts of a topic are packed in one sorted pass; a topic of any size needs bounded memory."""
    sized = placed.join(drafts.select("topic", key), key).select("topic", key, "component", (F.col("line_end") - F.col("line_start") + 1).alias("n"))
    # the order of a topic's components as one number, which packing needs
    order = sized.repartitionByRange("topic", key, "component").sortWithinPartitions("topic", key, "component").withColumn("pos", F.monotonically_increasing_id())
    packed = pack_groups(order, "topic", "pos", "n", most)
    pages = packed.groupBy("topic").agg(F.sum("n").cast("long").alias("n_lines"), F.max("bin").alias("n_pages"), F.count_if(F.col("n") > most).alias("oversized"))
    known = drafts.groupBy("topic").agg(F.count("*").alias("n_drafts"), F.min(key).alias("first_key"))
    return known.join(pages, "topic", "left").select("topic", "n_drafts", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_pages", F.lit(0)).alias("n_pages"), "first_key", F.coalesce("oversized", F.lit(0)).alias("oversized"))
