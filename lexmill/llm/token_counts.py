"""Token counts of documents in flat token files without an index.

A flat token file holds unsigned 16- or 32-bit ids back to back; an end-of-document id
closes each document. The scan reads blocks of the files in parallel, finds the
separators of a block with one vectorised comparison, and stitches documents that cross
blocks with a prefix scan over one small summary row per block.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import durable, open_fs, out_of_the_way, scratch_path, small_batches
from lexmill.llm.tokens import encoder, vocabulary

#: <|endoftext|> of byte_bpe_50k.json; no text encodes to it.
SEPARATOR = 50256
BLOCK_TOKENS = 1 << 20


def write_token_files(docs: DataFrame, directory: str, *, text: str = "text", doc_id: str = "doc_id", path: str | None = None, separator: int = SEPARATOR, dtype: str = "<u2") -> DataFrame:
    """Write one flat token file per partition of ``docs`` below ``directory``.

    Returns, lazily, what the files themselves do not hold: file, doc_index (from 0),
    doc_id for each document. Files appear under their final name only when complete,
    and a task that runs again writes the same file again. Null and empty texts are a
    separator alone; empty partitions write no file."""
    out_of_the_way(docs, text, doc_id)
    small_batches(docs.sparkSession)
    path = path or vocabulary()
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.spark_partition_id().alias("part"))
    key = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        out, name, nth = None, None, 0
        encode = encoder(path)
        top = np.iinfo(dtype).max
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                name = f"part-{batch.column(2)[0].as_py():06d}.bin"
                fs, folder = open_fs(directory)
                fs.create_dir(folder, recursive=True)
                temporary = f"{folder}/.{name}-{uuid.uuid4().hex}"
                out = fs.open_output_stream(temporary)
            for text in batch.column(1):
                ids = encode(text.as_py()) if text.is_valid else []
                ids.append(separator)
                block = np.array(ids, dtype=np.uint32)
                if block[:-1].size and (block[:-1] == separator).any() or int(block.max()) > top:
                    raise ValueError("a text's ids hold the separator or exceed the file's integers")
                out.write(block.astype(dtype).tobytes())
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * rows), pa.array(np.arange(nth, nth + rows)), batch.column(0)], names=["file", "doc_index", "doc_id"])
            nth += rows
        if out is not None:
            out.close()
            fs.move(temporary, f"{folder}/{name}")

    return source.mapInArrow(run, f"file string, doc_index long, doc_id {key}")


def list_token_files(spark: SparkSession, directory: str) -> DataFrame:
    """file, bytes of the token files in a folder, hidden files left out."""
    fs, folder = open_fs(directory)
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    rows = [(f.base_name, f.size) for f in found if f.is_file and not f.base_name.startswith((".", "_"))]
    return spark.createDataFrame(rows, "file string, bytes long")


def count_tokens(files: DataFrame, directory: str, *, separator: int = SEPARATOR, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, doc_index, start, n_tokens, complete for every document of ``files``
    (file, bytes; below ``directory``), ``start`` and ``n_tokens`` in tokens without the
    separator.

    Two separators in a row bound an empty document. Tokens after a file's last
    separator are one more document with ``complete`` false. Empty files and no files
    give no rows. A file whose size is no whole number of tokens raises. A file may be
    of any size: each block is a row of its own."""
    out_of_the_way(files, "file", "bytes")
    width = np.dtype(dtype).itemsize
    size = F.when(F.col("bytes") % width == 0, F.col("bytes") / width).otherwise(F.raise_error(F.lit("not a whole number of tokens"))).cast("long")
    blocks = files.select("file", size.alias("size")).where("size > 0")
    last = F.floor((F.col("size") - 1) / block_tokens)
    blocks = blocks.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    # the default number of partitions is the cluster's; adaptive execution must not merge them
    parts = max(2 * files.sparkSession.sparkContext.defaultParallelism, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = blocks.repartition(parts, "file", "block")

    def run(batches):
        for batch in batches:
            names, tops, nths = (batch.column(i).to_pylist() for i in range(3))
            for name, top, block in sorted(zip(names, tops, nths, strict=True), key=lambda x: (x[0], x[2])):
                fs, folder = open_fs(directory)
                start = block * block_tokens
                n = min(block_tokens, top - start)
                with fs.open_input_file(f"{folder}/{name}") as f:
                    ids = np.frombuffer(f.read_at(n * width, start * width), dtype)
                ends = (np.flatnonzero(ids == separator) + start).astype(np.int64)
                final = ends[-1] if len(ends) else None
                arrays = [pa.array([name]), pa.array([block], pa.int64()), pa.array([start + n], pa.int64()), pa.array([top], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([final], pa.int64()), pa.array([ends], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["file", "block", "stop", "size", "n", "final", "ends"])

    scanned = durable(blocks.mapInArrow(run, "file string, block long, stop long, size long, n long, final long, ends array<bigint>"), "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = scanned.select("file", "block", "n", "final")
    carried = summary.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("docs_before"), F.coalesce(F.last("final", ignorenulls=True).over(before), F.lit(-1)).alias("end_before"))
    # one row per block on either side; the long side is streamed, not grouped
    joined = scanned.join(carried, ["file", "block"])
    tail = F.when((F.col("stop") == F.col("size")) & (F.coalesce("final", "end_before") < F.col("size") - 1), F.array(F.col("size")))
    stops = F.concat("ends", F.coalesce(tail, F.array().cast("array<bigint>")))
    opens = F.concat(F.array("end_before"), "ends")
    each = joined.select("file", "docs_before", "size", F.posexplode(F.arrays_zip(F.slice(opens, F.lit(1), F.size(stops)).alias("a"), stops.alias("b"))).alias("nth", "span"))
    return each.select(
        "file",
        (F.col("docs_before") + F.col("nth")).alias("doc_index"),
        (F.col("span.a") + 1).alias("start"),
        (F.col("span.b") - F.col("span.a") - 1).alias("n_tokens"),
        (F.col("span.b") < F.col("size")).alias("complete"),
    )


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return document_token_counts(docs)


def document_token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, file, doc_index, start: the documents written to flat token
    files and counted by scanning those."""
    spark = docs.sparkSession
    directory = scratch_path(spark, "tokens")
    order = durable(write_token_files(docs, directory), "token-order")
    counted = count_tokens(list_token_files(spark, directory), directory)
    return order.join(counted, ["file", "doc_index"]).select("doc_id", "n_tokens", "file", "doc_index", "start")
