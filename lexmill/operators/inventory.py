"""The inventory of declared sources: what each file is, what it links to, and what keeps it out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators.graph import normalized_target

#: Fixed value of the contract: a link that is no image.
SOURCE_LINK = r"(?<!!)\[[^\]]*\]\(([^)]+)\)"


def source_links(files: DataFrame) -> DataFrame:
    """path, line_number, target, state of every link to a file of the tree in ``files`` (path, text).

    Fragments are cut and escapes decoded; links to the web and below ``/wiki`` are none. A target without a suffix is a page
    (``.md``). ``state``: ``local``, or ``escapes`` (target null) if it leaves the tree or is absolute."""
    lines = files.select("path", F.posexplode(T.lines("text")).alias("p", "line")).where(F.contains("line", F.lit("](")))
    each = lines.select("path", (F.col("p") + 1).alias("line_number"), F.explode(F.regexp_extract_all("line", F.lit(SOURCE_LINK), 1)).alias("raw"))
    bare = F.regexp_replace(F.trim("raw"), r"(?s)#.*$", "")
    bare = F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
    rows = each.withColumn("raw", bare).where((F.col("raw") != "") & ~F.col("raw").rlike("^(http:|https:|mailto:|ftp:)") & ~F.col("raw").rlike("^/wiki(/|$)"))
    inner = F.when(~F.col("raw").startswith("/"), normalized_target(F.col("path"), F.col("raw")))
    page = F.when(F.regexp_extract(inner, r"[^/]*$", 0).rlike(r"^.+\.[^.]+$"), inner).otherwise(F.concat(inner, F.lit(".md")))
    return rows.select("path", "line_number", page.alias("target"), F.when(inner.isNull(), "escapes").otherwise("local").alias("state"))


def source_inventory(files: DataFrame, declarations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inventory, codes). ``files``: path, text. ``declarations``: path, source_uri, knowledge_type, title, parent_path.

    inventory: source_id, source_uri, knowledge_type, path, content_hash, title, h1, h1_line, parent_path, features (seven booleans), links (target_uri,
    target, line_number, sorted), evidence_line, for files without a code. codes: path, code, detail: ``UNDECLARED``, ``FILE_MISSING``,
    ``DECLARED_TWICE``, ``URI_MISSING``, ``URI_CONFLICT`` (one URI, several contents), ``LINK_ESCAPES``, ``LINK_UNDECLARED``. Files and declarations
    meet by path, links meet declarations by target; contents are compared by hashes."""
    held = declarations.groupBy("path").agg(F.count("*").alias("n"), F.first(F.struct("source_uri", "knowledge_type", "title", "parent_path")).alias("d"))
    hashed = files.select("path", "text", F.sha2("text", 256).alias("content_hash"), F.lit(True).alias("there"))
    both = hashed.join(held, "path", "full_outer").withColumn("uri", F.trim(F.col("d.source_uri")))
    no_uri = F.col("n").isNotNull() & (F.coalesce("uri", F.lit("")) == "")
    conflict = both.where("there AND uri <> ''").groupBy("uri").agg(F.min("content_hash").alias("a"), F.max("content_hash").alias("b")).where("a <> b").select("uri", F.lit(True).alias("conflict"))
    links = source_links(files)
    known = held.where(F.trim("d.source_uri") != "").select(F.col("path").alias("target"), F.trim("d.source_uri").alias("target_uri"))
    met = links.join(known, "target", "left")
    lost = met.where("state = 'escapes' OR target_uri IS NULL").select("path", F.when(F.col("state") == "escapes", "LINK_ESCAPES").otherwise("LINK_UNDECLARED").alias("code"), F.concat(F.col("line_number").cast("string"), F.lit(":"), F.coalesce("target", F.lit(""))).alias("detail"))
    rows = both.join(conflict, "uri", "left")
    own = F.array_compact(F.array(
        F.when(F.col("n").isNull(), "UNDECLARED"), F.when(F.col("there").isNull(), "FILE_MISSING"), F.when(F.col("n") > 1, "DECLARED_TWICE"), F.when(no_uri, "URI_MISSING"), F.when(F.col("conflict") & F.col("there"), "URI_CONFLICT"),
    ))
    codes = rows.select("path", F.explode(own).alias("code"), F.lit(None).cast("string").alias("detail")).unionByName(lost.distinct())
    edges = met.where("target_uri IS NOT NULL").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("target_uri", "target", "line_number"))).alias("links"))
    good = rows.where(F.size(own) == 0).join(lost.select("path").distinct(), "path", "left_anti").join(edges, "path", "left")
    stem = F.regexp_replace(F.regexp_extract("path", "[^/]*$", 0), r"(?<=.)\.[^.]*$", "")
    title = F.coalesce(F.when(F.trim("d.title") != "", F.trim("d.title")), stem)
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    parent = F.coalesce(F.when(F.trim("d.parent_path") != "", F.col("d.parent_path")), F.when(folder != "", folder))
    heads = F.filter(F.transform(T.lines("text"), lambda v, i: F.struct(F.regexp_extract(v, r"^#\s+(.+?)\s*$", 1).alias("h"), (i + 1).alias("at"))), lambda x: x["h"] != "")
    good = good.withColumn("head", F.get(heads, F.lit(0))).withColumn("title", title).withColumn("parent", parent)
    none = F.array().cast(edges.schema["links"].dataType)
    inventory = good.select(
        T.source_id("uri").alias("source_id"), F.col("uri").alias("source_uri"), F.col("d.knowledge_type").alias("knowledge_type"), "path", "content_hash", "title", F.col("head.h").alias("h1"), F.col("head.at").alias("h1_line"), F.col("parent").alias("parent_path"),
        T.structure_features("text", "path", F.col("title"), F.col("parent")).alias("features"), F.coalesce("links", none).alias("links"), F.coalesce("head.at", F.lit(1)).alias("evidence_line"),
    )
    return inventory, codes
