import hashlib
import math
import random

import numpy as np
import pytest

from lexmill.llm import vector_codes as V
from tests.oracle import same_rows

SMALL = "/root/testdata/sf0.001"
COLUMNS = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = sorted(((i, v + [0] * (width * parts - len(v)), label) for i, v, label in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda v, p: v[p * width : (p + 1) * width]
    book = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def assign(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), j) for j, e in enumerate(book[p]))

    for _ in range(rounds):
        members = {}
        for _, v, _ in kept:
            for p in range(parts):
                members.setdefault((p, assign(v, p)[1]), []).append(cut(v, p))
        for (p, e), own in members.items():
            book[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    done = [(i, [assign(v, p) for p in range(parts)], label) for i, v, label in kept]
    totals = {}
    for _, a, label in done:
        totals[label] = totals.get(label, 0) + sum(d for d, _ in a)
    digest = hashlib.sha256(",".join(str(x) for b in book for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in a), sum(d for d, _ in a), totals[label], digest) for i, a, label in done), key=repr)


def ours(df):
    coded, book = V.compress(df)
    out = V.with_label_totals(coded, "label", "error", "total").collect()
    return sorted(((r["vec_id"], r["code"].hex(), r["error"], r["total"], V.books_digest(book)) for r in out), key=repr)


def test_equals_sql(spark):
    same_rows(V.op12_vector_codes(spark, SMALL), V.OP12_SQL, SMALL)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    coarse = seed == 2  # many ties
    x = lambda: r.randrange(-2, 3) / 256 if coarse else r.gauss(0, 0.3)
    rows = [(i, [x() for _ in range(32)], r.choice([0, 1, 2, None])) for i in range(300)]
    rows += [(7, rows[3][1], 1)] * 4 + [(None, [x() for _ in range(32)], None), (400, rows[0][1], 0)]
    assert ours(spark.createDataFrame(rows, COLUMNS).repartition(4)) == brute(rows)


def test_rows_that_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0] * 16, 1), (2, None, 1), (3, [inf] * 16, 1), (4, [nan] + [0.0] * 15, 2), (5, [None] + [0.0] * 15, 2), (6, [], 2), (7, [0.5, 0.25], None), (8, [-1.5] * 17, None)]
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS code", "2 AS v", "3 AS error", "4 AS part")
    assert ours(df) == brute(rows)


def test_empty_and_huge(spark):
    assert ours(spark.createDataFrame([], COLUMNS)) == []
    assert ours(spark.createDataFrame([(1, None, 1)], COLUMNS)) == []
    with pytest.raises(ValueError):
        V.compress(spark.createDataFrame([(1, [1e12] * 16, 1)], COLUMNS))


def test_bounds_skip_groups_and_change_nothing():
    r = np.random.default_rng(5)
    centres = r.integers(-300, 300, (64, 4))
    x = centres[r.integers(0, 64, 4000)] + r.integers(-4, 5, (4000, 4))
    book = x[:64].copy()
    group = V.groups_of(book)
    own, up, low, error = V.first_assignment(x, book, group)
    done_share = []
    for _ in range(4):
        new = book.copy()
        for e in range(64):
            if (own == e).any():
                new[e] = np.floor_divide(x[own == e].sum(axis=0), (own == e).sum())
        moved = np.sqrt(((new - book) ** 2).sum(axis=1).astype(float))
        book = new
        own, up, low, error, done = V.next_assignment(x, book, group, moved, own, V._safe(up, True).astype(float), V._safe(low, False).astype(float))
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (own == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()
        assert (up >= np.sqrt(d.min(axis=1)) - 1e-9).all()
        d = np.sqrt(d.astype(float))
        d[np.arange(len(x)), own] = np.inf
        for g in range(group.max() + 1):
            assert (low[:, g] <= d[:, group == g].min(axis=1) + 1e-9).all()
        done_share.append(done / (len(x) * 64))
    assert done_share[-1] < 0.1


def test_many_labels_are_joined_over_salted_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else i % 5, i) for i in range(500)], "vec_id long, label int, error long")
    few = sorted(map(repr, V.with_label_totals(rows, "label", "error", "t").collect()))
    monkeypatch.setattr(V, "FEW_LABELS", 1)
    assert sorted(map(repr, V.with_label_totals(rows, "label", "error", "t").collect())) == few and len(few) == 500
