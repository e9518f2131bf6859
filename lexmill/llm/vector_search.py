"""Exact top-k by inner product over a pivot-distance index.

Vectors are lifted by one component, so that all have the same norm and the largest inner
product is the smallest distance. Each lifted vector is keyed by its nearest pivot and the
distance to it; the index is sorted by that key and cut into blocks, which are annuli
around a pivot. A query takes the block it falls into and its neighbours first, which gives
a bound on its k-th best distance; by the triangle inequality, an annulus that the bound
does not reach holds no better vector. The annuli that it does reach are searched second,
and within each block only the slice of rows whose pivot distance the bound allows.

A query is sent to the blocks it must search, and to no others; blocks are of bounded size,
so no task ever holds a whole pivot's cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import discard, durable, durable_at, out_of_the_way, small_batches

PIVOTS = 64
#: Pivots are fitted on at most this many vectors, chosen by a hash of their ids. All are indexed.
SAMPLE = 4096
BLOCK_ROWS = 1024
#: Blocks that a query searches first, for its bound.
FIRST_BLOCKS = 2
#: Query rows that a task works on at once.
QUERY_BLOCK = 512
#: Queries that are sent to one copy of a block, about; a block that more of them reach is copied.
QUERIES_A_COPY = 8192
SCALE = 256.0
#: Slack for distances in floating point, relative to the common norm.
EPSILON = 1e-9


def quantized(vectors: DataFrame, vector: str, vec_id: str) -> DataFrame:
    """row, vec_id, v: floor(256 * x) per component. Rows without id, without vector, or with a null
    or non-finite component are left out. ``row`` tells rows apart that are alike; write the
    result before it is read twice."""
    v = F.col(f"`{vector}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col(f"`{vec_id}`").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    return vectors.where(good).select(F.monotonically_increasing_id().alias("row"), F.col(f"`{vec_id}`").cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(column, dims: int) -> np.ndarray:
    """Rows of a list column as a matrix, shorter ones filled up with noughts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims).astype(np.float64)
    out = np.zeros((len(sizes), dims))
    ends = np.concatenate(([0], np.cumsum(sizes)))
    for i, n in enumerate(sizes):
        out[i, :n] = flat[ends[i] : ends[i] + n]
    return out


def _pivots(x: np.ndarray, k: int) -> np.ndarray:
    """Up to k of the rows, each the farthest from those before it."""
    if not len(x):
        return x
    chosen, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < k and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d, 0))


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    """One more component, which brings every squared norm to ``top``."""
    return np.concatenate((x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))[:, None]), axis=1)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    most = max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    return np.array([[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in x] for r in q], dtype=object).reshape(len(q), len(x))


class Index:
    """rows: a written table (block, pivot, row, vec_id, d, v) sorted by d within a block; low, high: each block's annulus; pivots: lifted."""

    def __init__(self, rows, pivots, top, dims, of_block, low, high):
        self.rows, self.pivots, self.top, self.dims = rows, pivots, top, dims
        self.of_block, self.low, self.high = of_block, low, high


def build_index(vectors: DataFrame, *, pivots: int = PIVOTS, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS) -> Index:
    """Index every row of ``vectors`` (row, vec_id, v). The driver holds the pivots, fitted on a bounded
    sample, and 24 bytes for each block."""
    spark = vectors.sparkSession
    stats = vectors.agg(F.coalesce(F.max(F.size("v")), F.lit(1)), F.coalesce(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.lit(0.0)), F.count("*")).first()
    dims, top, total = max(1, stats[0]), float(stats[1]), stats[2]
    few = vectors.where(F.pmod(F.xxhash64("vec_id", "row"), F.lit(1 << 30)) < int(min(1.0, sample / max(total, 1)) * (1 << 30))).select("v").toArrow()
    centres = _pivots(_lift(_matrix(few.column("v"), dims), top), pivots)
    if not len(centres):
        centres = np.zeros((1, dims + 1))
    shared = spark.sparkContext.broadcast(centres)

    def key(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            d = _distances(_lift(_matrix(batch.column(2), dims), top), shared.value)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])], names=["row", "vec_id", "v", "pivot", "d"])

    keyed, keyed_path = durable_at(vectors.select("row", "vec_id", "v").mapInArrow(key, "row long, vec_id long, v array<double>, pivot int, d double"), "keyed")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), total // (64 * block_rows))
    dealt = keyed.repartitionByRange(parts, "pivot", "d", "row").sortWithinPartitions("pivot", "d", "row").select("row", "vec_id", "v", "pivot", "d", F.spark_partition_id().alias("part"))

    def cut(batches):
        block, count, last = 0, 0, None
        for batch in batches:
            pivot = batch.column(3).to_numpy()
            numbers = np.empty(len(pivot), np.int64)
            for i, p in enumerate(pivot.tolist()):
                if p != last or count == block_rows:
                    block, count, last = block + 1, 0, p
                numbers[i] = block
                count += 1
            numbers += batch.column(5).to_numpy().astype(np.int64) << 32
            yield pa.RecordBatch.from_arrays([pa.array(numbers), *(batch.column(i) for i in (3, 0, 1, 4, 2))], names=["block", "pivot", "row", "vec_id", "d", "v"])

    rows = durable(dealt.mapInArrow(cut, "block long, pivot int, row long, vec_id long, d double, v array<double>"), "annuli")
    discard(spark, keyed_path)
    table = rows.groupBy("block", "pivot").agg(F.min("d").alias("low"), F.max("d").alias("high")).orderBy("block").toArrow()
    # dense numbers for blocks, in the order of the index
    numbers, of_block, low, high = (table.column(i).to_numpy() for i in range(4))
    names = spark.sparkContext.broadcast(numbers)

    @F.pandas_udf("int")
    def dense(block: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(names.value, block.to_numpy()).astype(np.int32))

    return Index(rows.withColumn("block", dense("block")), centres, top, dims, of_block, low, high)


class _Annuli:
    """The blocks of each pivot, by distance. Annuli of one pivot follow one another, so that those
    within reach of a query are found by bisection."""

    def __init__(self, pivots: np.ndarray, top: float, of_block: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.pivots, self.top, self.low, self.high = pivots, top, low, high
        cut = np.flatnonzero(np.concatenate(([True], of_block[1:] != of_block[:-1], [True])))
        self.cells = [(int(of_block[a]), int(a), int(b)) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lifted distance from each query to each pivot, and the queries' squared norms."""
        # a query has norm of its own, and nought in the lifted component
        return _distances(np.concatenate((q, np.zeros((len(q), 1))), axis=1), self.pivots), (q * q).sum(axis=1)

    def nearest(self, d: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` blocks with the nearest annuli for each query, -1 where there are fewer."""
        blocks, least = [], []
        for pivot, a, b in self.cells:
            own = d[:, pivot]
            # the annulus that holds the distance or the next one outwards, and as many on both sides as could count
            at = a + np.searchsorted(self.high[a:b], own)
            for step in range(-count, count):
                k = at + step
                inside = (k >= a) & (k < b)
                k = np.clip(k, a, b - 1)
                blocks.append(np.where(inside, k, -1))
                least.append(np.where(inside, np.maximum(0, np.maximum(self.low[k] - own, own - self.high[k])), np.inf))
        blocks, least = np.stack(blocks, axis=1), np.stack(least, axis=1)
        order = np.lexsort((blocks, least), axis=1)[:, :count]
        return np.take_along_axis(blocks, order, axis=1)

    def within(self, d: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query numbers and blocks of all annuli that each query's ball reaches."""
        query, block = [], []
        for pivot, a, b in self.cells:
            first = a + np.searchsorted(self.high[a:b], d[:, pivot] - reach)
            last = a + np.searchsorted(self.low[a:b], d[:, pivot] + reach, "right")
            many = np.maximum(last - first, 0)
            query.append(np.repeat(np.arange(len(d)), many))
            block.append(np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum()))
        return np.concatenate(query), np.concatenate(block)


def search(index: Index, queries: DataFrame, k: int, *, first_blocks: int = FIRST_BLOCKS, queries_a_copy: int = QUERIES_A_COPY) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query (query_id, v and,
    for rows of the index, row) with the indexed rows, ties to the smaller vec_id, then to the smaller
    row; all of them if fewer. A query with a row leaves that row out, one without all rows of its id.

    Shorter vectors count as filled up with noughts. Ids may repeat: each row is a query and a
    candidate of its own. A task holds one block and some ``queries_a_copy`` queries: a block that
    more queries reach is copied."""
    spark = queries.sparkSession
    if not len(index.of_block):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shared = spark.sparkContext.broadcast(_Annuli(index.pivots, index.top, index.of_block, index.low, index.high))
    top, dims = index.top, index.dims
    by_row = "row" in queries.columns
    number = F.col("row") if by_row else F.monotonically_increasing_id()
    queries = durable(queries.select(number.alias("query"), "query_id", "v"), "queries")

    def reach_of(norms: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Lifted distance of the k-th best so far; without one, all."""
        return np.where(np.isnan(floor), np.inf, np.sqrt(np.maximum(norms + top - 2 * floor, 0))) + EPSILON * np.sqrt(top + norms) + 1e-6

    def route(with_bound: bool):
        """The blocks that each query goes to: the nearest ones, or the others that its bound reaches."""

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, QUERY_BLOCK):
                    own = batch.slice(at, QUERY_BLOCK)
                    d, norms = shared.value.distances(_matrix(own.column(2), dims))
                    near = shared.value.nearest(d, first_blocks)
                    if with_bound:
                        floor = own.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
                        i, block = shared.value.within(d, reach_of(norms, floor))
                        fresh = (near[i] != block[:, None]).all(axis=1)
                        i, block = i[fresh], block[fresh]
                        bounds = own.column(3).take(pa.array(i))
                    else:
                        i, block = np.nonzero(near >= 0)[0], near[near >= 0]
                        bounds = pa.nulls(len(i), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), *(own.column(c).take(pa.array(i)) for c in (0, 1, 2)), bounds], names=["block", "query", "query_id", "v", "floor"])

        return run

    def scan(left, right):
        """One block's rows against the queries sent to it, some at a time."""
        out = []
        x = _matrix(right.column("v"), dims)
        numbers, ids, dist = (right.column(c).to_numpy() for c in ("row", "vec_id", "d"))
        order = np.argsort(dist, kind="stable")
        x, numbers, ids, dist = x[order], numbers[order], ids[order], dist[order]
        if len(x) and left.num_rows:
            pivot = right.column("pivot")[0].as_py()
            for at in range(0, left.num_rows, QUERY_BLOCK):
                own = left.slice(at, QUERY_BLOCK)
                q, own_row, q_ids = _matrix(own.column("v"), dims), own.column("query").to_numpy(), own.column("query_id").to_numpy()
                floor = own.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
                d, norms = shared.value.distances(q)
                reach = reach_of(norms, floor)
                a, b = np.searchsorted(dist, (d[:, pivot] - reach).min(), "left"), np.searchsorted(dist, (d[:, pivot] + reach).max(), "right")
                score = _products(q, x[a:b])
                for i in range(len(q)):
                    keep = np.flatnonzero(numbers[a:b] != own_row[i] if by_row else ids[a:b] != q_ids[i])
                    best = keep[np.lexsort((numbers[a:b][keep], ids[a:b][keep], -score[i][keep]))[:k]]
                    out.append((np.full(len(best), own_row[i]), np.full(len(best), q_ids[i]), numbers[a:b][best], ids[a:b][best], score[i][best]))
        columns = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(5)]
        return pa.table({n: pa.array(c.astype(np.int64)) for n, c in zip(("query", "query_id", "row", "vec_id", "score"), columns, strict=True)})

    def searched(routed: DataFrame, name: str) -> DataFrame:
        routed = durable(routed, name)
        copies = routed.groupBy("block").agg(F.ceil(F.count("*") / queries_a_copy).cast("int").alias("copies"))
        sent = routed.join(copies, "block").withColumn("copy", F.pmod(F.xxhash64("query"), F.col("copies")).cast("int"))
        blocks = index.rows.join(copies, "block").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        pairs = sent.drop("copies").groupBy("block", "copy").cogroup(blocks.drop("copies").groupBy("block", "copy"))
        return pairs.applyInArrow(scan, "query long, query_id long, row long, vec_id long, score long")

    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    near = durable(searched(queries.mapInArrow(route(False), "block int, query long, query_id long, v array<double>, floor long"), "routed-near"), "near")
    floors = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query", F.col("score").alias("floor"))
    bounded = queries.join(floors, "query", "left").select("query", "query_id", "v", "floor")
    far = searched(bounded.mapInArrow(route(True), "block int, query long, query_id long, v array<double>, floor long"), "routed-far")
    ranked = near.unionByName(far).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_vector_search(spark, sf_dir: str) -> DataFrame:
    return nearest_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def nearest_vectors(embeddings: DataFrame, *, vector: str = "embedding", vec_id: str = "vec_id", every: int = 50, k: int = 5) -> DataFrame:
    """The contract's columns: queries are the rows whose id is divisible by ``every``, candidates all
    rows but the query's own. A query id that repeats is one query for each row, each under that
    id, and the other rows with that id are candidates."""
    out_of_the_way(embeddings, vector, vec_id)
    small_batches(embeddings.sparkSession)
    rows = durable(quantized(embeddings, vector, vec_id), "quantized")
    queries = rows.where(F.col("vec_id") % every == 0).select("row", F.col("vec_id").alias("query_id"), "v")
    return search(build_index(rows), queries, k)


OP3_SQL = """
WITH r AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)]) AS BIGINT) AS score
      FROM r q JOIN r c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""
