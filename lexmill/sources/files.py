"""File sources: trees of notes, JSONL ledgers, manifests. Read by Spark's own readers, on any store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUFFIXES = ("md", "txt", "json")


def scan_tree(spark: SparkSession, root: str, *, suffixes: tuple[str, ...] = SUFFIXES, allowed: DataFrame | None = None) -> DataFrame:
    """path (relative), text, bytes, sha256 of the files below ``root`` with these suffixes; hidden
    files are left out, and with ``allowed`` (path) all that it does not name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(root)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    relative = F.regexp_replace("path", "^.*?" + "\\Q" + base.split(":", 1)[-1].lstrip("/") + "\\E/", "")
    rows = files.select(relative.alias("path"), F.decode("content", "UTF-8").alias("text"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    rows = rows.where(~F.col("path").rlike(r"(^|/)\."))
    return rows if allowed is None else rows.join(allowed.select("path"), "path", "left_semi")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSONL ledger. Blank lines are skipped; a torn last line is left out; any other line that is
    no JSON object raises.

    Line numbers are not collected: only the largest offset of a bad line meets that of all lines."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"))
    return parse_jsonl(lines, schema)


def parse_jsonl(lines: DataFrame, schema: str) -> DataFrame:
    """As ``read_jsonl``, from lines (file, n, value), n rising within a file."""
    parsed = lines.where(F.trim("value") != "").withColumn("ok", F.coalesce(F.expr("try_parse_json(value)").isNotNull() & F.ltrim("value").startswith("{"), F.lit(False)))
    last = parsed.groupBy("file").agg(F.max("n").alias("last"))
    checked = parsed.join(last, "file")
    value = F.when(~F.col("ok") & (F.col("n") < F.col("last")), F.raise_error(F.concat(F.lit("corrupt line in "), "file"))).otherwise(F.col("value"))
    return checked.where("ok OR n < last").select(F.from_json(value, schema).alias("r")).select("r.*")


def tree_hash(rows: DataFrame, path: str = "path", content: str = "content_hash", size: str | None = None) -> DataFrame:
    """One row, tree_hash: over all (path, hash[, size]) in path order.

    Folded in two levels, by the path's first hex digit of its hash, so that no task holds all paths at once."""
    entry = F.concat_ws(":", F.col(path), F.col(content), *([F.col(size).cast("string")] if size else []))
    shelves = rows.groupBy(F.substring(F.sha2(F.col(path), 256), 1, 2).alias("shelf")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(entry)), "\n"), 256).alias("h"))
    return shelves.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shelf", "h"))), lambda x: x["h"]), "\n"), 256).alias("tree_hash"))


def declared_sources(files: DataFrame, declarations: DataFrame) -> DataFrame:
    """``files`` (path) with the declaration's uri: by the whole path, by the path without 'items/', by the
    base name, in that order; of several declarations of a spelling the last one (by seq)."""
    keyed = declarations.withColumn("key", F.explode(F.array_distinct(F.array("content_path", F.regexp_replace("content_path", "^items/", ""), F.regexp_replace("content_path", "^.*/", "")))))
    lookup = keyed.groupBy("key").agg(F.max_by("uri", "seq").alias("found"))
    whole = lookup.select(F.col("key").alias("path"), F.col("found").alias("by_path"))
    base = lookup.select(F.col("key").alias("name"), F.col("found").alias("by_name"))
    return files.withColumn("name", F.regexp_replace("path", "^.*/", "")).join(whole, "path", "left").join(base, "name", "left").withColumn("uri", F.coalesce("by_path", "by_name")).drop("name", "by_path", "by_name")


def first_per_uri(candidates: DataFrame, sources: str, seq: str) -> DataFrame:
    """uri and the candidate's seq: arrays of sources opened, the first row of each URI wins."""
    return candidates.select(F.col(seq), F.explode(sources).alias("uri")).groupBy("uri").agg(F.min(seq).alias(seq))


def parse_table(rows: DataFrame, text: str, key: str) -> DataFrame:
    """key, row, cells: Markdown table rows with escaped bars kept, delimiter rows left out."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n")).alias("row", "line")).where(F.col("line").rlike(r"^\s*\|.*\|\s*$"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))
    return lines.select(key, "row", cells.alias("cells")).where(~F.forall("cells", lambda c: c.rlike("^:?-*:?$")))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with n from 1 in the given order, numbered by range partitions and their sizes.

    The sorted partitions are stored once: their numbers, sizes and rows then agree whatever is read."""
    from lexmill.operators.similarity import stored

    parts = stored(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy("__p").orderBy(order))
    # one row for each partition
    base = parts.groupBy("__p").count().select("__p", (F.sum("count").over(Window.orderBy("__p")) - F.col("count")).alias("__base"))
    return parts.withColumn("__n", within).join(base, "__p").withColumn("n", F.col("__n") + F.col("__base")).drop("__n", "__p", "__base")
