"""Pieces that several operators share: shared storage, text kernels, hashing.

Tables that must outlive an executor are written below ``spark.checkpoint.dir``,
the only folder that driver and executors have in common.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a kernel holds at once; its arrays take about 60 times that.
SLICE_BYTES = 1 << 19
#: Bytes of an Arrow batch between Spark and Python, where the session has Spark's default of 64 MB.
BATCH_BYTES = 8 << 20

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


# --- shared storage ---------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, a fresh temporary one on a single
    machine; a cluster without one is an error, since its executors share no local disk."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_MADE: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _MADE:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Delete, at the end, all scratch tables that were made within. Frames that operators
    return read such tables: write what is to be kept to a path of one's own first."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield
    finally:
        _MADE[:] = [m for m in _MADE if m is not made]
        discard(spark, *made)


@contextmanager
def _merged(spark: SparkSession):
    """Adaptive execution merges partitions up to its advisory size, not just down to one per core."""
    key = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def durable(df: DataFrame, name: str, few: bool = False, gather: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives
    lost executors, and lets later steps prune columns. ``few``: the table is small, or cheap
    to compute; it is written in as few files as its bytes need. ``gather``: the same for a small table
    that takes many tasks to compute, which a shuffle parts from the writing."""
    return durable_at(df, name, few, gather)[0]


def durable_at(df: DataFrame, name: str, few: bool = False, gather: bool = False) -> tuple[DataFrame, str]:
    """As ``durable``, and the path, for ``discard``."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    writer = (df.hint("rebalance") if gather else df).write.option("compression", "zstd")
    if few or gather:
        with _merged(spark):
            writer.parquet(path)
    else:
        writer.parquet(path)
    return spark.read.schema(schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later plan reads, and let Spark drop the
    shuffle files of plans that are out of reach."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    gc.collect()
    jvm.System.gc()


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, on any store that Arrow knows."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri.removeprefix("file:").replace("///", "/").replace("//", "/")
    return pafs.FileSystem.from_uri(uri)


def out_of_the_way(df: DataFrame, *names: str) -> None:
    """Raise if a column that the operator needs is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python operators, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        if spark.conf.get(key) in ("67108864b", "64m", "64MB"):
            spark.conf.set(key, f"{BATCH_BYTES}b")
    except Exception as error:  # a Spark without this setting
        if "SQL_CONF_NOT_FOUND" not in str(error) and "NoSuchElement" not in str(error):
            raise


# --- text kernels -----------------------------------------------------------


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES):
    """Yield (first row, bytes as uint8, offsets) over runs of rows; nulls count as
    empty. A run holds at most ``limit`` bytes, or one row that is longer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    big = column.cast(pa.large_string()).fill_null("")
    _, off, data = big.buffers()
    offsets = np.frombuffer(off, np.int64)[big.offset : big.offset + len(big) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row, n = 0, len(big)
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words_of(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Word starts, ends (byte positions) and, per row, the index of its first word.

    ``is_word``: 256 booleans. A row's end ends a word.
    """
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = is_word[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    heads = offsets[:-1]
    before[heads[heads < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    tails = offsets[1:]
    after[tails[tails > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for key, base in (("up", _ODD), ("down", inverse)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = ASCII_LOWER) -> np.ndarray:
    """64-bit hash of every word, bytes folded through ``fold`` first. The value
    depends on the word's bytes alone, not on where it stands. Long texts are hashed in
    runs of words, so that the arrays stay small."""
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, "right")))
        base = starts[i]
        part, s, e = raw[base : ends[j - 1]], starts[i:j] - base, ends[i:j] - base
        up, down = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE_CODES[fold][part] * up[: len(part)], out=sums[1:])
        out[i:j] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every run of ``n`` consecutive words of one row."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * _ODD + words[k : k + m]
    return mix64(out + np.uint64(n))
