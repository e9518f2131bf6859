"""Best-fit-decreasing packing of token sequences into rows of fixed length.

Pieces of equal length are interchangeable, so best-fit decreasing over all pieces
depends on nothing but how many pieces there are of each length. The driver gets that
histogram (as many rows as a sequence has tokens, whatever the input), runs the
best-fit over it with a segment tree over remaining capacities, and gets a plan of runs:
the pieces of one length with ranks a..b go to the sequences from s on. Ranks are made
in Spark: a piece's rank within (bucket, length) plus the pieces of earlier buckets.
No text, piece or sequence list reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import durable, out_of_the_way, small_batches
from lexmill.llm.tokens import END_ID, ids_of, vocabulary

LENGTH = 1024
#: Pieces of one length are ranked in buckets of about so many; more, once the driver's table would
#: have over MAX_BUCKETS rows. Any number gives the same packing quality.
BUCKET_ROWS = 256
MAX_BUCKETS = 250_000
#: Token bytes in one Arrow batch on the way out.
OUT_BYTES = 8 << 20


def tokenize_pieces(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids (binary: little-endian unsigned 32-bit).

    Each row of ``docs`` is a document: its ids, then ``end_id``. Longer ones than
    ``length`` are cut into pieces of exactly ``length``, but for the first. Null and
    empty texts are ``end_id`` alone; null and repeated doc_ids stay as they are."""
    out_of_the_way(docs, text, doc_id)
    small_batches(docs.sparkSession)
    path = path or vocabulary()
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    key = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, size = [], 0

            def flush(rows, kind=batch.schema.field(0).type):
                cols = list(zip(*rows, strict=True))
                types = (kind, pa.int32(), pa.int64(), pa.int64(), pa.binary())
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids"])

            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                ids = ids_of(path, value.as_py(), end_id)
                count = -(-len(ids) // length)
                first = len(ids) - (count - 1) * length
                for piece in range(count):
                    a = 0 if piece == 0 else first + (piece - 1) * length
                    b = first + piece * length
                    rows.append((key.as_py(), piece, a, b - a, ids[a:b].tobytes()))
                    size += 4 * (b - a)
                    if size >= OUT_BYTES:
                        yield flush(rows)
                        rows, size = [], 0
            if rows:
                yield flush(rows)

    return source.mapInArrow(run, f"doc_id {key}, piece int, start long, length long, ids binary")


class CapacityTree:
    """A segment tree over remaining capacities 0..length: how many open bins have each."""

    def __init__(self, length: int):
        self.size = 1 << (length + 1 - 1).bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, least: int) -> int:
        """The smallest capacity of at least ``least`` that an open bin has; -1 if none."""
        i = least + self.size
        if self.count[i]:
            return least
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


@dataclass(frozen=True)
class Run:
    """Pieces of ``length`` with ranks ``rank``..``rank + n - 1`` go, ``each`` to a bin, to bins ``bin``, ``bin + 1``, ... from ``offset`` on."""

    length: int
    rank: int
    n: int
    bin: int
    each: int
    offset: int


def plan_best_fit(histogram: dict[int, int], length: int = LENGTH) -> list[Run]:
    """Best-fit decreasing over {piece length: pieces}. Bins of equal capacity are kept
    as runs of consecutive numbers, so that the work and the plan depend on the lengths
    that occur, not on the number of pieces."""
    if any(x < 1 or x > length for x in histogram):
        raise ValueError("piece lengths must be from 1 to the sequence length")
    tree, bins, plan, opened = CapacityTree(length), {}, [], 0
    for size in sorted(histogram, reverse=True):
        rank, left = 0, histogram[size]
        while left:
            capacity = tree.tightest(size)
            if capacity < 0:
                # new bins: each takes pieces of this size until it has no room for one
                each = length // size
                full, rest = divmod(left, each)
                for n, k in ((full, each), (1, rest)):
                    if n and k:
                        plan.append(Run(size, rank, n * k, opened, k, 0))
                        if room := length - k * size:
                            bins.setdefault(room, []).append((opened, n))
                            tree.add(room, n)
                        opened, rank, left = opened + n, rank + n * k, left - n * k
                continue
            start, n = bins[capacity].pop()
            # a bin stays the tightest one until the size no longer fits into it
            each = min(capacity // size, left)
            use = min(n, left // each)
            tree.add(capacity, -use)
            if n > use:
                bins[capacity].append((start + use, n - use))
            plan.append(Run(size, rank, use * each, start, each, length - capacity))
            if room := capacity - each * size:
                bins.setdefault(room, []).append((start, use))
                tree.add(room, use)
            rank, left = rank + use * each, left - use * each
    return plan


def place_pieces(pieces: DataFrame, *, length: int = LENGTH, bucket_rows: int = BUCKET_ROWS, max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any other columns) with sequence_id and
    offset. Every row is placed; rows alike in all columns are placed one by one.
    Columns called sequence_id or offset are replaced; no rows in, no rows out.

    ``pieces`` is computed once and written with a number for each row, by which pieces of a length are
    dealt to buckets and ranked in them: numbers that were computed again could differ, if the cluster's size has
    changed."""
    out_of_the_way(pieces, "doc_id", "piece", "length")
    spark = pieces.sparkSession
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    numbered = pieces.select(*[F.col(f"`{c}`") for c in keep], F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()).alias("__number"))
    pieces = durable(numbered, "pieces")
    totals = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``length`` rows
    bucket_rows = max(bucket_rows, sum(totals.values()) // max_buckets)
    buckets = [max(1, -(-totals.get(size, 0) // bucket_rows)) for size in range(length + 1)]
    of_length = F.element_at(F.array(*map(F.lit, buckets)), F.col("length").cast("int") + 1)
    rows = pieces.withColumn("__bucket", F.pmod("__number", of_length).cast("int"))
    # at most length + max_buckets rows, whatever the input
    base = rows.groupBy("length", "__bucket").count().orderBy("length", "__bucket").toArrow()
    sizes, bucket, n = (base.column(c).to_numpy() for c in ("length", "__bucket", "count"))
    heads = np.concatenate(([0], np.cumsum(buckets)))
    starts = np.zeros(heads[-1], np.int64)
    if len(n):
        before = np.cumsum(n) - n
        first = np.flatnonzero(np.concatenate(([True], sizes[1:] != sizes[:-1])))
        starts[heads[sizes] + bucket] = before - np.repeat(before[first], np.diff(np.append(first, len(n))))
    histogram: dict[int, int] = {}
    for size, many in zip(sizes.tolist(), n.tolist(), strict=True):
        histogram[size] = histogram.get(size, 0) + many
    plan = plan_best_fit(histogram, length)
    table: dict[int, tuple] = {}
    for size in histogram:
        own = [r for r in plan if r.length == size]
        table[size] = tuple(np.array([getattr(r, k) for r in own], np.int64) for k in ("rank", "bin", "each", "offset"))
    shared = spark.sparkContext.broadcast((starts, heads, table))
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("__bucket", "length").orderBy("doc_id", "piece", "__number")) - 1)

    def run(batches):
        starts, heads, table = shared.value
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            size = batch.column(at["length"]).to_numpy().astype(np.int64)
            rank = batch.column(at["__rank"]).to_numpy() + starts[heads[size] + batch.column(at["__bucket"]).to_numpy()]
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for x in np.unique(size):
                own = np.flatnonzero(size == x)
                first, bins, each, offset = table[int(x)]
                i = np.searchsorted(first, rank[own], "right") - 1
                nth = rank[own] - first[i]
                seq[own] = bins[i] + nth // each[i]
                off[own] = offset[i] + nth % each[i] * x
            yield pa.RecordBatch.from_arrays([*[batch.column(at[c]) for c in keep], pa.array(seq), pa.array(off)], names=[*keep, "sequence_id", "offset"])

    fields = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in keep)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, length, ids: the packed rows themselves, from placed pieces with ids."""
    grouped = placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit("").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    return grouped.select("sequence_id", "length", joined.alias("ids"))


def op2_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed(docs)


def packed(docs: DataFrame) -> DataFrame:
    """The contract's columns; the ids are reduced to their checksum before they are stored."""
    pieces = tokenize_pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place_pieces(pieces)
