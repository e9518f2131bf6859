import math
import random

import numpy as np
import pytest

from lexmill.llm import embedding_dedup as D
from tests.oracle import same_rows

SMALL = "/root/testdata/sf0.001"
COLUMNS = "vec_id long, embedding array<double>"


def brute(rows, least=0.95):
    n = max([len(v) for _, v in rows if v is not None] + [1])
    good = [i for i, (c, v) in enumerate(rows) if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, up = {i: 0 for i in range(len(rows))}, list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    x = np.array([list(rows[i][1]) + [0.0] * (n - len(rows[i][1])) for i in good]).reshape(len(good), n)
    x = x / np.abs(x).max(axis=1, initial=1e-300)[:, None]
    x = x / np.linalg.norm(x, axis=1)[:, None]
    for p, q in zip(*np.nonzero(np.triu(x @ x.T >= least, 1)), strict=True):
        a, b = good[p], good[q]
        links[a] += 1
        links[b] += 1
        up[top(a)] = top(b)
    smallest = {}
    for i, (c, _) in enumerate(rows):
        if c is not None:
            smallest[top(i)] = min(smallest.get(top(i), c), c)
    return sorted(((c, links[i], smallest.get(top(i)), c is not None and c == smallest[top(i)]) for i, (c, _) in enumerate(rows)), key=repr)


def ours(df, **kw):
    return sorted((tuple(r) for r in D.near_duplicates(df, **kw).collect()), key=repr)


def around(r, centre, spread):
    return [x + r.gauss(0, spread) for x in centre]


def test_equals_sql(spark):
    same_rows(D.op13_embedding_dedup(spark, SMALL), D.OP13_SQL, SMALL)


@pytest.mark.parametrize("seed", range(3))
def test_families_in_small_cells(spark, seed):
    """Families of several widths over many cells and blocks, exact copies among them."""
    r = random.Random(seed)
    rows = []
    for spread in (0.0, 0.01, 0.03, 0.05, 0.06):
        for _ in range(6):
            c = [r.gauss(0, 0.25) for _ in range(16)]
            rows += [around(r, c, spread) for _ in range(r.randrange(1, 25))]
    rows += [[r.gauss(0, 0.25) for _ in range(16)] for _ in range(300)]
    rows = list(enumerate(r.sample(rows, len(rows))))
    df = spark.createDataFrame(rows, COLUMNS).repartition(4)
    assert ours(df, cell_rows=24, block_rows=7, guest_rows=11) == brute(rows)


def test_exact_in_few_dimensions(spark):
    """Up to nine dimensions the bound on guests is exact, whatever the direction of the difference."""
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(3)]) for i in range(500)]
    assert ours(spark.createDataFrame(rows, COLUMNS), cell_rows=16, block_rows=8, guest_rows=8) == brute(rows)


def test_tight_group_is_linked_without_products(spark, monkeypatch):
    r = random.Random(6)
    c = [r.gauss(0, 1) for _ in range(32)]
    rows = [(i, around(r, c, 0.02)) for i in range(600)] + [(600 + i, [r.gauss(0, 1) for _ in range(32)]) for i in range(100)]
    compared = spark.sparkContext.accumulator(0)
    plain = D.linked

    def counted(x, y, least):
        compared.add(x.shape[0] * y.shape[0])
        return plain(x, y, least)

    monkeypatch.setattr(D, "linked", counted)
    assert ours(spark.createDataFrame(rows, COLUMNS).repartition(3), cell_rows=64) == brute(rows)
    assert 0 < compared.value < 60_000  # of 245,000 pairs


def test_rows_that_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(9, [1.0, 0.0]), (1, None), (2, [1.0, None]), (3, [inf, 0.0]), (4, [nan, 1.0]), (5, [0.0, 0.0]), (6, []), (None, [1.0, 0.0]), (7, [1.0]), (8, [1e300, 1e298]), (10, [-0.0, 1e-300]), (11, [0.0, 2e-300]), (9, [0.0, 1.0]), (12, [1.0, 0.0])]
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS node", "2 AS key", "3 AS v", "4 AS cell", "5 AS first", "6 AS component_id")
    assert ours(df) == brute(rows)


def test_empty_and_single(spark):
    assert ours(spark.createDataFrame([], COLUMNS)) == []
    assert ours(spark.createDataFrame([(3, [1.0, 2.0])], COLUMNS)) == [(3, 0, 3, True)]
    assert ours(spark.createDataFrame([(3, None)], COLUMNS)) == [(3, 0, 3, True)]


def test_groups_are_found_over_local_minima():
    links = np.zeros((3, 3), bool)
    links[0, 0] = links[0, 2] = links[1, 1] = links[1, 2] = True
    a, b = D.first_of_group(links, np.array([10, 11, 12]), np.array([1, 2, 20]))
    assert a.tolist() == [1, 1, 12] and b.tolist() == [1, 1, 1]


def test_one_verdict_at_the_threshold():
    r = np.random.default_rng(1)
    x = D._units(r.normal(size=(50, 64)))
    cos = D.exact_cosine(x[3], x[9])
    for rows in (x, x[3:10], x[[3, 9]]):
        i, j = (3, 9) if len(rows) == 50 else (0, len(rows) - 1)
        assert D.linked(rows, rows, cos)[i, j] and D.linked(rows, rows, cos)[j, i]


def test_recall_at_the_threshold(spark):
    """64 dimensions, pairs just above the threshold in random directions, among other vectors, in small cells."""
    r = np.random.default_rng(8)
    base = D._units(r.normal(size=(1500, 64)))
    away = r.normal(size=base.shape)
    away = D._units(away - (away * base).sum(axis=1)[:, None] * base)
    twin = 0.951 * base + math.sqrt(1 - 0.951**2) * away
    rows = [(i, v) for i, v in enumerate(np.concatenate((base, twin)).tolist())]
    found = {r["vec_id"]: r["component_id"] for r in D.near_duplicates(spark.createDataFrame(rows, COLUMNS).repartition(4), cell_rows=32).collect()}
    assert sum(found[i + 1500] == i for i in range(1500)) >= 1490
