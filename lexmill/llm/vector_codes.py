"""Vector code compression: product codebooks fitted by Yinyang Lloyd rounds, in whole numbers.

Vectors are cut into equal parts, and each part position has a codebook. Lloyd rounds assign every
part to its nearest entry and move the entries. Entries are put into groups once; each part keeps an
upper bound on the distance to its own entry and one lower bound for each group. When entries move, the
bounds give way by the distance moved, and only groups whose bound no longer rules them out are
scanned. Bounds are floating-point and rounded to the safe side; whatever they leave open, ties among
it, is decided by integer distances, so that codes equal those of a full scan.

The table is dealt to tasks by rows, and bounds are written beside the rows between rounds. The driver
holds the codebooks, the sums for them, and nothing that grows with the rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import discard, durable, durable_at, out_of_the_way, small_batches

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256.0
#: Entries in a group, about.
GROUP = 10
#: Share by which a float bound must clear another one to count without integers.
SLACK = 1e-6
#: Labels up to which the totals are sent to every task; beyond it they are joined over salted keys.
FEW_LABELS = 100_000
SALTS = 64
#: Rows that a kernel works on at once.
ROWS = 2048

STATE = "vec_id long, label {label}, v array<long>, code binary, up array<float>, low array<float>"


def _rows(column, width: int, kind) -> np.ndarray:
    """A list column of lists of ``width`` as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(kind, copy=False)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(matrix.reshape(-1)))


def groups_of(book: np.ndarray, size: int = GROUP, rounds: int = 5) -> np.ndarray:
    """The group of each entry: a few rounds of k-means over the entries themselves."""
    k = -(-len(book) // size)
    x = book.astype(np.float64)
    centre = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        of = ((x[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
        centre = np.stack([x[of == g].mean(axis=0) if (of == g).any() else centre[g] for g in range(k)])
    return np.unique(of, return_inverse=True)[1]


def _safe(matrix: np.ndarray, upwards: bool) -> np.ndarray:
    """As 32-bit floats, rounded to the safe side."""
    return np.nextafter(matrix.astype(np.float32), np.float32(np.inf if upwards else -np.inf))


def first_assignment(x: np.ndarray, book: np.ndarray, group: np.ndarray):
    """Entry, upper bound, lower bound for each group and integer distance of every row of x, from a full scan."""
    d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    own, at = d.argmin(axis=1), np.arange(len(x))
    best = d[at, own].copy()
    rest = np.sqrt(d.astype(np.float64))
    rest[at, own] = np.inf
    low = np.stack([rest[:, group == g].min(axis=1) for g in range(group.max() + 1)], axis=1)
    return own, np.sqrt(best.astype(np.float64)), low, best


def next_assignment(x: np.ndarray, book: np.ndarray, group: np.ndarray, moved: np.ndarray, own: np.ndarray, up: np.ndarray, low: np.ndarray):
    """Entry, bounds and integer distance after the entries moved by ``moved``; scans only groups whose bound
    fails. Last value: how many distances were computed."""
    up = up + moved[own]
    low = low - np.stack([moved[group == g].max() for g in range(group.max() + 1)])[None]
    at = np.arange(len(x))
    exact = ((x - book[own]) ** 2).sum(axis=1)
    done = len(x)
    open_ = np.flatnonzero(up * (1 + SLACK) >= low.min(axis=1))
    # the distance to the own entry may settle it
    up[open_] = np.sqrt(exact[open_].astype(np.float64))
    open_ = open_[up[open_] * (1 + SLACK) >= low[open_].min(axis=1)]
    if len(open_):
        before, far = own[open_].copy(), np.iinfo(np.int64).max
        d = np.full((len(open_), len(book)), far)
        failed = up[open_][:, None] * (1 + SLACK) >= low[open_]
        for g in range(failed.shape[1]):
            i, entries = np.flatnonzero(failed[:, g]), np.flatnonzero(group == g)
            d[np.ix_(i, entries)] = ((x[open_[i]][:, None, :] - book[entries][None]) ** 2).sum(axis=2)
            done += len(i) * len(entries)
        d[np.arange(len(open_)), before] = exact[open_]
        now = d.argmin(axis=1)  # whole numbers: the first of equal ones
        own, exact = own.copy(), exact.copy()
        own[open_], exact[open_] = now, d[np.arange(len(open_)), now]
        up[open_] = np.sqrt(exact[open_].astype(np.float64))
        d[np.arange(len(open_)), now] = far
        rest = np.where(d == far, np.inf, np.sqrt(d.astype(np.float64)))
        for g in range(failed.shape[1]):
            seen = rest[:, group == g].min(axis=1)
            low[open_, g] = np.where(failed[:, g], seen, np.minimum(low[open_, g], seen))
    return own, up, low, exact, done


def whole_vectors(vectors: DataFrame, vector: str, vec_id: str, label: str) -> DataFrame:
    """vec_id, label, v: floor(256 * x) of each component, without rows whose vector is null or holds a null or
    non-finite component."""
    v = F.col(f"`{vector}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    good = v.isNotNull() & F.coalesce(fine, F.lit(False))
    return vectors.where(good).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), whole.alias("v"))


def _sums(own: np.ndarray, x: np.ndarray, entries: int) -> np.ndarray:
    """For each part and entry: how many, and the sum of each component."""
    out = np.zeros((x.shape[1], entries, x.shape[2] + 1), np.int64)
    for p in range(x.shape[1]):
        np.add.at(out[p], own[:, p], np.concatenate((np.ones((len(x), 1), np.int64), x[:, p]), axis=1))
    return out


def compress(vectors: DataFrame, *, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (binary, one byte a part), error of each vector; and the codebooks [part, entry, component].

    Codebooks start as the ``entries`` smallest vec_ids (null ids last, rows of one id by vector), fewer if there
    are fewer. Shorter vectors count as filled up with noughts, to a multiple of ``parts``. Rows that repeat count
    each. No vectors: no rows, and empty codebooks. Components must stay below about 2**29 / sqrt(width of a part)
    after scaling, or a ValueError says so."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    spark = vectors.sparkSession
    small_batches(spark)
    out_of_the_way(vectors, vector, vec_id, label)
    kept = whole_vectors(vectors, vector, vec_id, label)
    longest, most = kept.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    width = -(-max(longest or 1, 1) // parts)
    if most is not None and width * (2 * int(most)) ** 2 >= 2**62:
        raise ValueError("components are too large for distances in 64 bits")
    dims = width * parts
    full = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("v")))
    kept = kept.withColumn("v", full)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    book = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    kind = kept.schema["label"].dataType.simpleString()
    schema = STATE.format(label=kind)
    if not len(first):
        return spark.createDataFrame([], f"vec_id long, label {kind}, code binary, error long"), book
    group = [groups_of(book[p]) for p in range(parts)]
    widths = [g.max() + 1 for g in group]
    cuts = np.concatenate(([0], np.cumsum(widths)))

    def step(shared, begins: bool):
        """One assignment over a batch of rows, with the books of this round."""

        def run(batch):
            books, moved = shared.value
            x = _rows(batch.column(2), dims, np.int64).reshape(-1, parts, width)
            n = len(x)
            own, up, low, error = np.zeros((n, parts), np.uint8), np.zeros((n, parts)), np.zeros((n, cuts[-1])), np.zeros(n, np.int64)
            if not begins:
                old = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, parts)
                up, low = _rows(batch.column(4), parts, np.float64), _rows(batch.column(5), int(cuts[-1]), np.float64)
            new_up, new_low = up.copy(), low.copy()
            for p in range(parts):
                span = slice(cuts[p], cuts[p + 1])
                if begins:
                    own[:, p], new_up[:, p], new_low[:, span], d = first_assignment(x[:, p], books[p], group[p])
                else:
                    own[:, p], new_up[:, p], new_low[:, span], d, _ = next_assignment(x[:, p], books[p], group[p], moved[p], old[:, p].astype(np.int64), up[:, p], low[:, span])
                error += d
            return x, own, new_up, new_low, error

        return run

    def slices(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield batch.slice(at, ROWS)

    def codes(own: np.ndarray) -> pa.Array:
        return pa.array([r.tobytes() for r in own], pa.binary())

    def assigning(shared, begins: bool):
        one = step(shared, begins)

        def run(batches):
            for batch in slices(batches):
                _, own, up, low, _ = one(batch)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), codes(own), _lists(_safe(up, True)), _lists(_safe(low, False))], names=["vec_id", "label", "v", "code", "up", "low"])

        return run

    def finishing(shared, begins: bool):
        one = step(shared, begins)

        def run(batches):
            for batch in slices(batches):
                _, own, _, _, error = one(batch)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes(own), pa.array(error)], names=["vec_id", "label", "code", "error"])

        return run

    def summing(batches):
        total = np.zeros((parts, len(first), width + 1), np.int64)
        for batch in slices(batches):
            own = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, parts)
            total += _sums(own, _rows(batch.column(1), dims, np.int64).reshape(-1, parts, width), len(first))
        p, e, c = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(total[p, e, c])], names=["part", "entry", "place", "total"])

    empty = kept.select("vec_id", "label", "v", F.lit(None).cast("binary").alias("code"), F.array().cast("array<float>").alias("up"), F.array().cast("array<float>").alias("low"))
    state, path, moved, begins = empty, None, None, True
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((book, moved))
        after, after_path = durable_at(state.mapInArrow(assigning(shared, begins), schema), "codes")
        found = after.select("code", "v").mapInArrow(summing, "part int, entry int, place int, total long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect()
        totals = np.zeros((parts, len(first), width + 1), np.int64)
        for r in found:
            totals[r["part"], r["entry"], r["place"]] = r["total"]
        many = totals[:, :, :1]
        new = np.where(many > 0, totals[:, :, 1:] // np.maximum(many, 1), book)
        moved = np.sqrt(((new - book).astype(np.float64) ** 2).sum(axis=2)) * (1 + 1e-12)
        book, begins = new, False
        if path:
            discard(spark, path)
        state, path = after, after_path
    shared = spark.sparkContext.broadcast((book, moved))
    out = durable(state.mapInArrow(finishing(shared, begins), f"vec_id long, label {kind}, code binary, error long"), "coded")
    if path:
        discard(spark, path)
    return out, book


def with_label_totals(rows: DataFrame, label: str, value: str, total: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over rows of an equal label, nulls together. Sums are pre-aggregated; up
    to 100,000 labels they are sent to every task, beyond it rows of a label are dealt to 64 salted keys."""
    sums = durable(rows.groupBy(F.col(label).alias("__label")).agg(F.sum(value).alias(total)), "label-totals", gather=True)
    if sums.count() <= FEW_LABELS:
        return rows.join(F.broadcast(sums), F.col(label).eqNullSafe(F.col("__label"))).drop("__label")
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    each = sums.withColumn("__at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(each, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__salt") == F.col("__at"))).drop("__label", "__salt", "__at")


def books_digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over ``embeddings``."""
    coded, book = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = with_label_totals(coded, "label", "error", "label_error")
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(book)).alias("codebooks_sha256"))


def _round_sql(n: int) -> str:
    return f"""
d{n} AS MATERIALIZED (SELECT p.vec_id, p.part, b.entry, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(p.x, b.x)])::BIGINT AS d FROM p JOIN b{n} b ON b.part = p.part),
a{n} AS MATERIALIZED (SELECT vec_id, part, entry, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1)"""


def _move_sql(n: int) -> str:
    return f"""
s{n} AS (SELECT a.part, a.entry, e.i, sum(p.x[e.i])::BIGINT AS s, count(*) AS c FROM a{n} a JOIN p ON p.vec_id = a.vec_id AND p.part = a.part CROSS JOIN (SELECT unnest(range(1, 5)) AS i) e GROUP BY ALL),
m{n} AS (SELECT part, entry, list((s - ((s % c) + c) % c) // c ORDER BY i) AS x FROM s{n} GROUP BY part, entry),
b{n + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN m{n} m ON m.part = b.part AND m.entry = b.entry)"""


#: For vectors of 64 components with distinct ids.
OP12_SQL = f"""
WITH k AS (SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[part * 4 + 1 : part * 4 + 4] AS x FROM k CROSS JOIN (SELECT unnest(range(16)) AS part)),
b0 AS MATERIALIZED (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, x FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64)),
{_round_sql(0)}, {_move_sql(0)}, {_round_sql(1)}, {_move_sql(1)}, {_round_sql(2)},
c AS (SELECT vec_id, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id) CROSS JOIN h
"""
