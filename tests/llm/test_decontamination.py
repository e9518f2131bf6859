import random

import pytest

from lexmill.llm import decontamination as D
from tests.llm.brute import contamination
from tests.oracle import same_rows

SMALL = "/root/testdata/sf0.001"
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def test_equals_sql(spark):
    same_rows(D.op9_decontamination(spark, SMALL), D.OP9_SQL, SMALL)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    word = lambda: r.choice("ab") + r.choice(["", "É", "1", "z"])
    text = lambda n: "".join(word() + r.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 2, 3, 9, 10, 11, 30]))) for i in range(25)]
    docs = [(i, text(r.randint(0, 60)) + (r.choice(items)[1].upper() if r.random() < 0.5 else "")) for i in range(80)]
    b = spark.createDataFrame(items, ITEMS)
    for size in (1 << 20, 300):
        got = D.mark(spark.createDataFrame(docs, DOCS), b, pass_bytes=size)
        found = {x["doc_id"]: (x["n_words"], x["n_hit"], sorted({m["item_id"] for m in x["matches"]})) for x in got.collect()}
        assert found == {i: contamination(t, [(str(n), x) for n, x in items]) for i, t in docs}


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([(1, item), (1, item), (None, "zzz"), (2, None), (3, "...")], ITEMS)
    long = "pad " * 300_000 + item
    rows = [(1, None), (2, ""), (3, item.upper()), (3, item.upper()), (None, "x zzz y"), (4, long), (5, "one two three")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS n_hit", "2 AS matches", "3 AS item_id")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in D.contamination(df, items).collect()]
    assert got == [(1, 0, 0, 0, False), (2, 0, 0, 0, False), (3, 11, 11, 1, True), (3, 11, 11, 1, True), (None, 3, 1, 1, True), (4, 300_011, 11, 1, True), (5, 3, 0, 0, False)]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([], ITEMS)
    assert [r["n_hit"] for r in D.mark(docs, items).collect()] == [0]
    assert D.mark(docs.limit(0), items).count() == 0


def test_long_items_are_cut_and_found_whole(spark, monkeypatch):
    r = random.Random(4)
    words = [f"w{r.randrange(40)}" for _ in range(400)]
    monkeypatch.setattr(D, "ITEM_WORDS", 16)
    items = [(1, " ".join(words)), (2, " ".join(words[:9])), (3, " ".join(words[100:130]))]
    docs = [(i, " ".join(words[i * 7 : i * 7 + 12 + i % 3])) for i in range(50)] + [(99, " ".join(words))]
    for size in (1 << 20, 200):
        got = D.mark(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), pass_bytes=size)
        found = {x["doc_id"]: (x["n_words"], x["n_hit"], sorted({m["item_id"] for m in x["matches"]})) for x in got.collect()}
        assert found == {i: contamination(t, [(str(n), x) for n, x in items]) for i, t in docs}


def test_cost_does_not_follow_the_benchmark():
    """Text with frequent words: a benchmark forty times as large costs a few times as much, not its square."""
    import time

    import numpy as np

    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(30_000)]
    zipf = lambda n: " ".join(vocabulary[i % 30_000] for i in rng.zipf(1.2, n))
    docs = [zipf(2000) for _ in range(20)]
    seconds = []
    for items in (50, 2000):
        tables = D.build_tables([(str(i), zipf(200)) for i in range(items)] + [("hit", docs[3][500:900])])
        began, hits = time.process_time(), 0
        for text in docs:
            folded, starts, ends, hashes = D._split(text)
            hits += sum(1 for t in tables for _ in D._search(t, folded, starts, ends, hashes, np.array([0, len(starts)])))
        seconds.append(time.process_time() - began)
        assert hits > 30
    assert seconds[1] < 1.0
