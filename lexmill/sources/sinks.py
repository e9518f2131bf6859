"""Sinks: staged writes, appends, upserts of ledgers."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_jsonl(df: DataFrame, path: str) -> None:
    """Overwrite a JSONL ledger, keys sorted, nulls kept."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def replace_jsonl(df: DataFrame, path: str) -> None:
    """As ``write_jsonl``, staged beside the target and renamed into place: readers see the old rows
    or the new ones. A failure leaves the old ones."""
    spark = df.sparkSession
    stage, old = f"{path}.stage-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    write_jsonl(df, stage)
    fs, target = _fs(spark, path)
    moved = fs.exists(target) and fs.rename(target, _fs(spark, old)[1])
    if not fs.rename(_fs(spark, stage)[1], target):
        if moved:
            fs.rename(_fs(spark, old)[1], target)
        raise OSError(f"cannot move {stage} to {path}")
    if moved:
        fs.delete(_fs(spark, old)[1], True)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append rows as new files of a JSONL ledger, keys sorted. Lines that an earlier writer left torn are cut first, so
    that they don't stand before whole ones; a new file becomes visible when it is complete."""
    fs, at = _fs(df.sparkSession, path)
    if fs.exists(at):
        cut_torn_tails(df.sparkSession, path)
    df.select(*sorted(df.columns)).write.mode("append").option("ignoreNullFields", "false").json(path)


#: Suffixes of files in which a line feed can't be looked for.
COMPRESSED = (".gz", ".bz2", ".zst", ".zstd", ".lz4", ".snappy", ".deflate", ".xz")
#: Bytes that are copied, or searched for a line feed, at once.
COPY_BYTES = 8 << 20


def _whole_lines(file, length: int, step: int = 1 << 16) -> int:
    """Bytes up to and with the last line feed, looked for from the end."""
    end = length
    while end:
        start = max(0, end - step)
        found = file.read_at(end - start, start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        end = start
    return 0


def _cut_file(fs, path: str, keep: int) -> None:
    """Leave the first ``keep`` bytes of a file. They are written under a name that readers pass over and renamed onto the
    file, so that whenever this stops, the ledger has the old file or the new one, and no other."""
    folder, _, name = path.rpartition("/")
    with fs.open_input_file(path) as old, fs.open_output_stream(f"{folder}/.{name}.cut") as new:
        for start in range(0, keep, COPY_BYTES):
            new.write(old.read_at(min(COPY_BYTES, keep - start), start))
    # a checksum that Hadoop keeps beside a local file speaks of the old bytes; without one it isn't checked
    crc = f"{folder}/.{name}.crc"
    if fs.get_file_info(crc).is_file:
        fs.delete_file(crc)
    fs.move(f"{folder}/.{name}.cut", path)


def cut_torn_tails(spark: SparkSession, path: str) -> int:
    """Cut each file of a ledger after its last line feed, and say how many were cut. Compressed files raise, before any
    file is touched: their bytes don't show where a line ends.

    Only the last bytes of each file are read, in parallel. What an interrupted call left behind is hidden from Spark's
    readers, and the next call writes over it."""
    import pyarrow as pa
    import pyarrow.fs as pafs

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json*").load(path).select("path", "length")
    packed = files.where(F.lower("path").rlike("(" + "|".join(re.escape(x) for x in COMPRESSED) + ")$")).select("path").head(1)
    if packed:
        raise ValueError(f"a compressed file can't be cut: {packed[0]['path']}")

    def run(batches):
        for batch in batches:
            cut = []
            for name, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = (pafs.LocalFileSystem(), re.sub("^file:/*", "/", name)) if name.startswith("file:") else pafs.FileSystem.from_uri(name)
                with fs.open_input_file(at) as f:
                    keep = _whole_lines(f, length)
                if keep < length:
                    _cut_file(fs, at, keep)
                    cut.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.string())], names=["path"])

    return files.where("length > 0").repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "path string").count()


def remember(claims: DataFrame, store: DataFrame, key: str = "identity") -> DataFrame:
    """Claims that the store does not hold yet: what an upsert by identity has to write."""
    return claims.dropDuplicates([key]).join(store.select(key), key, "left_anti")


def archive_rows(removed: DataFrame, *, operation: str, reason: str, run_id: str) -> DataFrame:
    """Archive ledger rows for removed claims."""
    return removed.select(F.struct(*removed.columns).alias("claim"), F.lit(operation).alias("operation"), F.lit(reason).alias("reason"), F.lit(run_id).alias("run_id"))


def write_plan(drafts: DataFrame, targets: str, pages: DataFrame) -> DataFrame:
    """target, action, archive_required for every target of every draft."""
    rows = drafts.select(F.explode(targets).alias("target")).distinct()
    known = pages.select(F.col("path").alias("target"), F.lit(True).alias("known")).distinct()
    exists = F.coalesce("known", F.lit(False))
    return rows.join(known, "target", "left").select("target", F.when(exists, "revise").otherwise("new").alias("action"), exists.alias("archive_required"))


def queue_lines(rows: DataFrame, key: str, reason: str) -> DataFrame:
    """Rendered queue entries, one per key: 'id: reason'."""
    return rows.select(F.concat_ws(": ", F.col(key).cast("string"), reason).alias("entry"))
