import random

import pytest

from lexmill.llm import vector_search as V
from tests.oracle import same_rows

SMALL = "/root/testdata/sf0.001"
VECS = "vec_id long, embedding array<double>"


def brute(rows, every=50, k=5):
    import math

    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in fine:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in fine if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_equals_sql(spark):
    same_rows(V.op3_vector_search(spark, SMALL), V.OP3_SQL, SMALL)


@pytest.mark.parametrize("seed", range(3))
def test_clusters_ties_and_copies(spark, seed):
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [x + r.gauss(0, 0.02) for x in r.choice(centres)]) for i in range(300)]
    rows += [(300 + i, centres[0]) for i in range(150)]
    got = V.nearest_vectors(spark.createDataFrame(rows, VECS).repartition(5)).collect()
    assert sorted(tuple(x) for x in got) == brute(rows)


def test_small_blocks_prune_and_stay_exact(spark):
    r = random.Random(9)
    rows = [(i, [r.uniform(-2, 2) * (1 + i % 5) for _ in range(3)]) for i in range(400)]
    q = V.quantized(spark.createDataFrame(rows, VECS), "embedding", "vec_id").persist()
    index = V.build_index(q, pivots=8, block_rows=16)
    queries = q.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "v")
    assert sorted(tuple(x) for x in V.search(index, queries, 5).collect()) == brute(rows)


def test_rows_that_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [inf, 0.0]), (4, [nan, 0.0]), (None, [1.0, 1.0]), (50, [0.5, 0.5]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, []), (9, [1.0])]
    df = spark.createDataFrame(rows, VECS).selectExpr("*", "1 AS score", "2 AS rank", "3 AS query_id")
    assert sorted(tuple(x) for x in V.nearest_vectors(df).collect()) == brute(rows)


def test_empty_and_fewer_than_k(spark):
    assert V.nearest_vectors(spark.createDataFrame([], VECS)).count() == 0
    assert V.nearest_vectors(spark.createDataFrame([(0, [1.0])], VECS)).count() == 0
    rows = [(0, [1.0]), (1, [2.0])]
    assert [tuple(x) for x in V.nearest_vectors(spark.createDataFrame(rows, VECS)).collect()] == brute(rows)


def brute_by_row(rows, every=50, k=5):
    import math

    fine = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows)]
    out = []
    for n, q, v in fine:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for m, i, w in fine if m != n)[:k]
            out += [(q, at + 1, i, -s) for at, (s, i) in enumerate(best)]
    return sorted(out)


def test_each_row_of_a_repeated_id_is_a_query_and_a_candidate(spark):
    r = random.Random(4)
    rows = [(i // 3 * 10, [r.uniform(-1, 1) for _ in range(4)]) for i in range(90)]
    rows += [(0, [1.0, 0.0, 0.0, 0.0]), (0, [-1.0, 0.0, 0.0, 0.0]), (0, [1.0, 0.0, 0.0, 0.0])]
    got = sorted(tuple(x) for x in V.nearest_vectors(spark.createDataFrame(rows, VECS).repartition(3)).collect())
    assert got == brute_by_row(rows) and len(got) == 5 * sum(i % 50 == 0 for i, _ in rows)


def test_copied_blocks_change_nothing(spark):
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) for _ in range(3)]) for i in range(300)]
    q = V.durable(V.quantized(spark.createDataFrame(rows, VECS), "embedding", "vec_id"), "test-vectors")
    queries = q.where("vec_id % 5 = 0").selectExpr("row", "vec_id AS query_id", "v")
    got = V.search(V.build_index(q, pivots=4, block_rows=32), queries, 5, queries_a_copy=3)
    assert sorted(tuple(x) for x in got.collect()) == brute(rows, every=5)
