"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative a group.

Equal vectors are one row with a weight. Centroids are fitted on a bounded sample; every vector is then
dealt to the cell of its nearest centroid and, as a guest, to each cell whose border it is close to. Two
vectors of cosine c lie within a distance e of each other, so that their advantages for their own cells
sum up to at most e times the distance of the two centroids; a vector is a guest where its own advantage
is at most half of that. In more than ``SPREAD``**2 dimensions the bound is divided by sqrt(dims) / SPREAD: a
difference between near-duplicates that has no preferred direction passes it once in 370. README has the
recall that was measured.

Within a cell, rows that are closer to the centroid than half the angle of the threshold (the core) are
linked with each other without a product. All others are compared in blocks of bounded size: a block pair
sends back counts and, for each row, one link to the first row of its group in the block pair; no pairs. So
a tight group of any size costs time in proportion to its rows, and components come from these links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import discard, durable, durable_at, out_of_the_way, small_batches
from lexmill.llm.components import components

COSINE = 0.95
#: Distinct vectors in a cell, about, up to MAX_CELLS cells; larger cells are compared in blocks.
CELL_ROWS = 256
MAX_CELLS = 8192
#: Centroids are fitted on at most this many vectors for each cell, chosen by a hash.
SAMPLE_A_CELL = 16
ROUNDS = 4
SPREAD = 3.0
#: Own rows and guests in a block.
BLOCK_ROWS = 1024
GUEST_ROWS = 4096
#: Products this near to the threshold are computed again, with exact sums.
DOUBT = 1e-9
#: Rows that are dealt to cells at once.
DEAL_ROWS = 512


def _matrix(column, dims: int) -> np.ndarray:
    """Rows of a list column as a matrix in double precision, shorter ones filled up with noughts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims)[None] < sizes[:, None]] = flat
    return out


def _units(x: np.ndarray) -> np.ndarray:
    """Rows at length one; each is brought to a safe size first, by a power of two."""
    top = np.abs(x).max(axis=1, initial=0)
    x = np.ldexp(x, -np.frexp(np.where(top > 0, top, 1))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """With sums that are rounded once, whatever the order."""
    total = lambda p, q: math.fsum((p * q).tolist())
    return total(a, b) / (math.sqrt(total(a, a)) * math.sqrt(total(b, b)))


def linked(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which rows of x and y (at length one) have a cosine of at least ``least``."""
    cos = x @ y.T
    out = cos >= least
    for i, j in zip(*np.nonzero(np.abs(cos - least) < DOUBT), strict=True):
        out[i, j] = exact_cosine(x[i], y[j]) >= least
    return out


def first_of_group(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows ``left`` and ``right`` (node numbers) of a link matrix: the smallest node that each reaches."""
    top = np.iinfo(np.int64).max
    a, b = np.full(len(left), top), np.full(len(right), top)
    busy_a, busy_b = links.any(axis=1), links.any(axis=0)
    open_a = busy_a.copy()
    for i in np.flatnonzero(busy_a):
        if not open_a[i]:
            continue
        in_a, in_b = np.zeros(len(left), bool), np.zeros(len(right), bool)
        front = np.array([i])
        while len(front):
            in_a[front] = True
            fresh = links[front].any(axis=0) & ~in_b
            in_b |= fresh
            front = np.flatnonzero(links[:, fresh].any(axis=1) & ~in_a)
        least = min(left[in_a].min(), right[in_b].min())
        a[in_a], b[in_b] = least, least
        open_a &= ~in_a
    return np.where(busy_a, a, left), np.where(busy_b, b, right)


def distinct_vectors(vectors: DataFrame, vector: str, vec_id: str) -> tuple[DataFrame, DataFrame]:
    """rows: vec_id, key (null if the vector takes no part); points: key, node, v, weight, first, for each
    distinct vector that does. Rows without id, and vectors that are null, zero or hold null or non-finite
    components take no part."""
    v = F.col(f"`{vector}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = F.col(f"`{vec_id}`").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False))
    # -0.0 and 0.0 are one value
    plain = F.transform(v, lambda x: F.when(x == 0, F.lit(0)).otherwise(x).cast(vectors.schema[vector].dataType.elementType))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.when(good, plain).alias("v"))
    rows = rows.withColumn("key", F.when(F.col("v").isNotNull(), F.struct(F.xxhash64("v"), F.xxhash64(F.lit(1), "v"), F.xxhash64(F.lit(2), "v"))))
    points = rows.where("key IS NOT NULL").groupBy("key").agg(F.first("v").alias("v"), F.count("*").alias("weight"), F.min("vec_id").alias("first"))
    return rows.select("vec_id", "key"), points.select("key", F.monotonically_increasing_id().alias("node"), "v", "weight", "first")


def fit_cells(points: DataFrame, dims: int, total: int, *, cell_rows: int = CELL_ROWS, max_cells: int = MAX_CELLS, sample_a_cell: int = SAMPLE_A_CELL, least: float = COSINE) -> np.ndarray:
    """Centroids at length one, by rounds of spherical k-means over a bounded sample, a Spark job each. The driver
    holds the centroids. Centroids closer than ``least`` to an earlier one are left out, so that a tight group
    has one cell."""
    spark = points.sparkSession
    k = min(max_cells, max(1, total // cell_rows))
    share = min(1.0, sample_a_cell * k / max(total, 1))
    order = F.xxhash64("key", F.lit(7))
    sample = durable(points.where(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("v", order.alias("at")), "sample", gather=True)
    centres = _units(_matrix(sample.orderBy("at").limit(k).select("v").toArrow().column("v"), dims)) if total else np.zeros((0, dims))
    for _ in range(ROUNDS if len(centres) > 1 else 0):
        shared = spark.sparkContext.broadcast(centres)

        def pull(batches, shared=shared):
            sums = np.zeros(shared.value.shape)
            for batch in batches:
                for at in range(0, batch.num_rows, DEAL_ROWS):
                    x = _units(_matrix(batch.column(0).slice(at, DEAL_ROWS), dims))
                    np.add.at(sums, (x @ shared.value.T).argmax(axis=1), x)
            used = np.flatnonzero(sums.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(list(sums[used]), pa.list_(pa.float64()))], names=["cell", "s"])

        each = sample.select("v").mapInArrow(pull, "cell int, s array<double>").select("cell", F.posexplode("s").alias("i", "x"))
        got = each.groupBy("cell", "i").agg(F.sum("x").alias("x")).toArrow()
        new = np.zeros_like(centres)
        new[got.column("cell").to_numpy(), got.column("i").to_numpy()] = got.column("x").to_numpy()
        full = np.flatnonzero((new * new).sum(axis=1) > 0)
        centres = centres.copy()
        centres[full] = _units(new[full])
    keep = []
    for i, c in enumerate(centres):
        if not keep or (centres[keep] @ c).max() < least:
            keep.append(i)
    return centres[keep]


def _dealer(shared, dims: int, least: float, spread: float):
    """Cells of each vector: its home, whether it is in the core there, the cells where it is a guest, and for home
    and guests whether it is near enough to meet the core."""
    angle = math.acos(least)
    reach = math.sqrt(2 - 2 * least) * min(1.0, spread / math.sqrt(dims)) / 2 + 1e-9
    core, near = math.cos(max(angle / 2 - 1e-6, 0)), math.cos(min(1.5 * angle + 1e-6, math.pi))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, DEAL_ROWS):
                own = batch.slice(at, DEAL_ROWS)
                x, centres = _units(_matrix(own.column(1), dims)), shared.value
                cos = x @ centres.T
                home = cos.argmax(axis=1)
                best = cos[np.arange(len(x)), home]
                apart = np.sqrt(np.maximum(2 - 2 * centres[home] @ centres.T, 0))
                guest = best[:, None] - cos <= reach * apart
                guest[np.arange(len(x)), home] = False
                i, cell = np.nonzero(guest)
                cuts = pa.array(np.searchsorted(i, np.arange(len(x) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(c)) for c in (cell.astype(np.int32), cos[i, cell] >= near)]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(home.astype(np.int32)), pa.array(best >= core), pa.array(best >= near), *lists], names=["node", "v", "weight", "home", "core", "near", "guest", "guest_near"])

    return run


def near_links(points: DataFrame, centres: np.ndarray, dims: int, *, least: float = COSINE, spread: float = SPREAD, block_rows: int = BLOCK_ROWS, guest_rows: int = GUEST_ROWS) -> DataFrame:
    """a, b, n: for node a, the weight n of nodes linked with it, in parts to be summed, and a node b of its group (or
    a itself). ``points``: node, v, weight."""
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast(centres)
    dealt = durable(points.select("node", "v", "weight").mapInArrow(_dealer(shared, dims, least, spread), f"node long, v {points.schema['v'].dataType.simpleString()}, weight long, home int, core boolean, near boolean, guest array<int>, guest_near array<boolean>"), "dealt")
    own = dealt.select("node", "weight", F.col("home").alias("cell"), F.lit(True).alias("own"), "core", "near")
    guests = dealt.select("node", "weight", F.explode(F.arrays_zip("guest", "guest_near")).alias("g")).select("node", "weight", F.col("g.guest").alias("cell"), F.lit(False).alias("own"), F.lit(False).alias("core"), F.col("g.guest_near").alias("near"))
    size = lambda what, rows: F.ceil(F.count_if(what) / rows).cast("int")
    o, c, m = F.col("own"), F.col("core"), F.col("near")
    tally = own.unionByName(guests).groupBy("cell").agg(
        size(o & ~c, block_rows).alias("n_own"), size(~o, guest_rows).alias("n_guest"), size(c, block_rows).alias("n_core"), size(~c & m, guest_rows).alias("n_near"),
        F.sum(F.when(c, F.col("weight"))).alias("core_weight"), F.min(F.when(c, F.col("node"))).alias("core_first"),
    )
    tally = durable(tally, "tally", gather=True)  # a row for each cell, MAX_CELLS at most
    in_core = dealt.where("core").join(F.broadcast(tally), F.col("home") == F.col("cell")).select(F.col("node").alias("a"), F.col("core_first").alias("b"), (F.col("core_weight") - F.col("weight")).alias("n"))

    # a row's part in each comparison: (kind, i, j, side); kind 0 own and own, 1 own and guest, 2 core and near
    up_to = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    block = lambda n: F.pmod(F.xxhash64("node", F.lit(3)), F.greatest(F.col(n), F.lit(1))).cast("int")
    task = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    me, as_guest, as_core, as_near = block("n_own"), block("n_guest"), block("n_core"), block("n_near")
    none = F.array().cast("array<struct<kind:int,i:int,j:int,side:int>>")
    among_own = F.flatten(F.transform(up_to("n_own"), lambda k: F.when(k == me, F.array(task(0, k, k, 0))).when(k < me, F.array(task(0, k, me, 1))).otherwise(F.array(task(0, me, k, 0)))))
    tasks = F.concat(
        F.when(o & ~c, F.concat(among_own, F.transform(up_to("n_guest"), lambda k: task(1, me, k, 0)))).otherwise(none),
        F.when(~o, F.transform(up_to("n_own"), lambda k: task(1, k, as_guest, 1))).otherwise(none),
        F.when(c, F.transform(up_to("n_near"), lambda k: task(2, as_core, k, 0))).otherwise(none),
        F.when(~c & m, F.transform(up_to("n_core"), lambda k: task(2, k, as_near, 1))).otherwise(none),
    )
    places = F.concat(F.array(F.struct(F.col("home").alias("cell"), F.lit(True).alias("own"), F.col("core").alias("core"), F.col("near").alias("near"))), F.transform(F.arrays_zip("guest", "guest_near"), lambda g: F.struct(g["guest"].alias("cell"), F.lit(False).alias("own"), F.lit(False).alias("core"), g["guest_near"].alias("near"))))
    placed = dealt.select("node", "v", "weight", "home", "guest", F.explode(places).alias("p")).select("node", "v", "weight", "home", "guest", "p.*").join(F.broadcast(tally.drop("core_weight", "core_first")), "cell")
    sent = placed.select("cell", "node", "v", "weight", "home", "guest", F.explode(tasks).alias("t")).select("cell", "t.*", "node", "v", "weight", "home", "guest")

    def compare(table: pa.Table) -> pa.Table:
        """One pair of blocks, or one block with itself."""
        kind, i, j, cell = (table.column(x)[0].as_py() for x in ("kind", "i", "j", "cell"))
        side, node, weight, home = (table.column(x).to_numpy() for x in ("side", "node", "weight", "home"))
        x = _units(_matrix(table.column("v"), dims))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = kind == 0 and i == j
        if alone:
            right = left
        links = linked(x[left], x[right], least)
        if alone:
            np.fill_diagonal(links, False)
        away = np.flatnonzero(home[right] != cell)
        if len(away) and links[:, away].any():
            # two rows that are guests of each other's cells meet twice: the smaller cell counts
            guests = [set(g) for g in table.column("guest").take(pa.array(left)).to_pylist()]
            for other in np.unique(home[right[away]]):
                if other < cell:
                    both = np.array([other in g for g in guests], bool)
                    links[np.ix_(both, home[right] == other)] = False
        a, b = first_of_group(links, node[left], node[right])
        n_a, n_b = links @ weight[right], links.T @ weight[left]
        parts = [(node[left], a, n_a)] if alone else [(node[left], a, n_a), (node[right], b, n_b)]
        out = [np.concatenate(c)[np.concatenate([p[2] for p in parts]) > 0] for c in zip(*parts, strict=True)]
        return pa.table({n: pa.array(c.astype(np.int64)) for n, c in zip("abn", out, strict=True)})

    return sent.groupBy("cell", "kind", "i", "j").applyInArrow(compare, "a long, b long, n long").unionByName(in_core)


def near_duplicates(vectors: DataFrame, *, vector: str = "embedding", vec_id: str = "vec_id", least: float = COSINE, spread: float = SPREAD, cell_rows: int = CELL_ROWS, max_cells: int = MAX_CELLS, block_rows: int = BLOCK_ROWS, guest_rows: int = GUEST_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``, which may have other columns of any name.

    n_links counts other rows with a cosine of at least ``least`` (in (0, 1)), rows of an equal vector among them;
    component_id is the smallest vec_id that links reach; kept is true where that is the row's own. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing: n_links 0, their own id, kept. Rows
    without id the same, with a null component, not kept. Ids may repeat; each row counts for itself. Shorter
    vectors count as filled up with noughts. An empty table gives no rows."""
    out_of_the_way(vectors, vector, vec_id)
    small_batches(vectors.sparkSession)
    rows, points = distinct_vectors(vectors, vector, vec_id)
    points, points_path = durable_at(points, "points")
    total, dims = points.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    centres = fit_cells(points, dims, total, cell_rows=cell_rows, max_cells=max_cells, least=least)
    alone = F.lit(0).cast("long")
    if not len(centres):
        found = points.select("key", alone.alias("n_links"), F.col("first").alias("component_id"))
    else:
        links, links_path = durable_at(near_links(points, centres, dims, least=least, spread=spread, block_rows=block_rows, guest_rows=guest_rows), "links")
        group = components(links.select("a", "b"), "near-vectors")
        count = links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
        each = points.select("key", "node", "weight", "first").join(group, "node", "left").join(count, "node", "left")
        each, each_path = durable_at(each.select("key", "weight", "first", F.coalesce("component", "node").alias("component"), F.coalesce("n", alone).alias("n")), "grouped")
        discard(vectors.sparkSession, links_path)
        least_id = each.groupBy("component").agg(F.min("first").alias("component_id"))
        found = each.join(least_id, "component").select("key", (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id")
    # rows of no key are dealt by their ids
    done = rows.where("key IS NOT NULL").join(found, "key").select("vec_id", "n_links", "component_id")
    rest = rows.where("key IS NULL").select("vec_id", alone.alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op13_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over ``embeddings``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: For distinct ids.
OP13_SQL = """
WITH RECURSIVE g AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT t.vec_id, (SELECT count(*) FROM e WHERE e.a = t.vec_id) AS n_links, c.component_id, t.vec_id = c.component_id AS kept
FROM embeddings t JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = t.vec_id
"""
