"""Operators whose form matters at scale: same results as the plain definitions."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import layout, similarity
from lexmill.plans import runner
from lexmill.sources import files


def first_split(strata):
    """The first assignment in the order of the contract, by trying all."""
    of = {}
    for x, s in strata:
        of.setdefault(x, set()).add(s)
    order = sorted(of, key=lambda x: (-len(of[x]), runner._hash(x), x))
    members = {}
    for x, s in strata:
        members.setdefault(s, set()).add(x)
    wish = [int(runner._hash(x), 16) % 2 for x in order]
    for turned in itertools.product((0, 1), repeat=len(order)):
        colour = {x: w ^ t for x, w, t in zip(order, wish, turned, strict=True)}
        if all(len({colour[x] for x in own}) == 2 for own in members.values() if len(own) > 1):
            return {x: runner.SPLITS[c] for x, c in colour.items()}
    return None


@pytest.mark.parametrize("seed", range(40))
def test_lineage_split_is_the_first_one(seed):
    r = random.Random(seed)
    strata = [(f"l{r.randrange(8)}", f"s{r.randrange(6)}") for _ in range(r.randint(1, 18))]
    want = first_split(strata)
    if want is None:
        with pytest.raises(ValueError):
            runner.split_lineages(strata)
    else:
        assert runner.split_lineages(strata) == want


def test_lineage_split_of_many_lineages():
    chosen = runner.split_lineages([(f"l{i}", f"s{i % 700}") for i in range(5000)])
    assert len(chosen) == 5000 and all(len({chosen[f"l{i}"] for i in range(s, 5000, 700)}) == 2 for s in range(700))


def packed(sizes, limit, most=None):
    out, number, total, count = [], 1, 0, 0
    for x in sizes:
        if count and ((total + x > limit and (total > 0 or most is not None)) or (most is not None and count >= most)):
            number, total, count = number + 1, 0, 0
        out.append(number)
        total, count = total + x, count + 1
        if most is None and x > limit:
            number, total, count = number + 1, 0, 0
    return out


def test_packing_of_a_large_group_and_small_ones(spark):
    r = random.Random(3)
    rows = [(g, p, float(r.choice((0, 1, 5, 9, 40)))) for g in (None, 1, 2) for p in range(3000 if g == 1 else 20)]
    df = spark.createDataFrame(rows, "g int, p long, s double").repartition(5)
    for got, most in ((layout.pack_groups(df, "g", "p", "s", 20), None), (layout.pack_two(df, "g", "p", "s", 7, 20), 7)):
        found = {(x["g"], x["p"]): x["bin"] for x in got.collect()}
        for g in (None, 1, 2):
            sizes = [s for h, _, s in rows if h == g]
            assert [found[g, p] for p in range(len(sizes))] == packed(sizes, 20, most)
    assert layout.pack_groups(df.limit(0), "g", "p", "s", 20).count() == 0


def test_parents_equal_brute_force(spark):
    r = random.Random(8)
    rows = [(d, p, r.choice((1, 2, 3, 4, 5, 6, None))) for d in range(3) for p in range(60)]
    got = {(x["d"], x["p"]): x["parent"] for x in layout.parents(spark.createDataFrame(rows, "d int, p int, l int"), "d", "p", "l").collect()}
    for d, p, level in rows:
        above = [q for e, q, l in rows if e == d and q < p and l is not None and l < (level or 7)]
        assert got[d, p] == max(above, default=None)


def test_similar_pairs_with_copies_equal_brute_force(spark):
    r = random.Random(6)
    sets = [frozenset(r.sample("abcdefghijklmnop", r.randint(1, 9))) for _ in range(25)]
    rows = [(i, " ".join(r.sample(sorted(s), len(s)))) for i, s in enumerate(r.choice(sets) for _ in range(120))] + [(500, ""), (501, "")]
    got = {(x["a"], x["b"]): x["score"] for x in similarity.similar_pairs(spark.createDataFrame(rows, "k long, t string"), "k", "t", 0.6).collect()}
    toks = {k: set(t.split()) for k, t in rows}
    want = {(a, b): len(toks[a] & toks[b]) / len(toks[a] | toks[b]) for a, b in itertools.combinations(sorted(toks), 2) if toks[a] and toks[b]}
    assert got == pytest.approx({k: s for k, s in want.items() if s >= 0.6})


def test_copies_stay_one_set_and_groups_of_near_copies_are_sent_in_parts(spark, monkeypatch):
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[: 60 - r.randint(0, 4)] + [f"x{r.randint(0, 30)}" for _ in range(r.randint(0, 4))])) for i in range(90)]
    rows += [(100 + i, rows[i % 3][1]) for i in range(40)]
    monkeypatch.setattr(similarity._scored, "__defaults__", (16,))
    members, pairs = similarity.similar_sets(spark.createDataFrame(rows, "k long, t string"), "k", "t", 0.8)
    toks, first = {k: frozenset(t.split()) for k, t in rows}, {}
    for k in sorted(toks):
        first.setdefault(toks[k], k)
    assert {x["row"]: x["rep"] for x in members.collect()} == {k: first[s] for k, s in toks.items() if list(toks.values()).count(s) > 1}
    want = {(a, b): len(toks[a] & toks[b]) / len(toks[a] | toks[b]) for a, b in itertools.combinations(sorted(first.values()), 2)}
    got = [(x["a"], x["b"], x["score"]) for x in pairs.collect()]
    assert sorted(got) == [(a, b, s) for (a, b), s in sorted(want.items()) if s >= 0.8]


def test_large_sets_that_are_not_similar_are_parted_by_sketches(spark, monkeypatch):
    r = random.Random(4)
    words = [f"w{i}" for i in range(800)]
    # 30 sets of 700 of 800 words: similar to some 0.78 at most; and two near copies of the first in another size of sketch
    rows = [(i, " ".join(r.sample(words, 700))) for i in range(30)]
    first = rows[0][1].split()
    rows += [(40, " ".join([*first, *[f"x{i}" for i in range(90)]])), (41, " ".join([*first, *[f"y{i}" for i in range(400)]])), (42, " ".join([*first, *[f"x{i}" for i in range(90)], "z"]))]
    toks = {k: frozenset(t.split()) for k, t in rows}
    want = {(a, b): len(toks[a] & toks[b]) / len(toks[a] | toks[b]) for a, b in itertools.combinations(sorted(toks), 2)}
    asked, scored = [], similarity._scored
    monkeypatch.setattr(similarity, "_scored", lambda near, *more: (asked.append(near.count()), scored(near, *more))[1])
    _, pairs = similarity.similar_sets(spark.createDataFrame(rows, "k long, t string"), "k", "t", 0.84)
    assert {(x["a"], x["b"]): x["score"] for x in pairs.collect()} == {k: s for k, s in want.items() if s >= 0.84}
    assert asked[0] <= sum(s >= 0.8 for s in want.values()) < len(want) / 4


def test_wide_sketches_never_differ_more_than_the_sets():
    r = np.random.default_rng(2)
    for n, more in ((1, 0), (3, 40), (300, 20), (700, 600), (20_000, 900)):
        x = r.integers(0, 1 << 63, n).astype(np.uint64)
        y = np.concatenate((x[n // 9 :], r.integers(0, 1 << 63, more).astype(np.uint64)))
        a, b = (pa.array([similarity._wide(v), similarity._wide(x)], pa.list_(pa.int64())) for v in (x, y))
        assert similarity._differing(a, b).tolist()[1] <= len(np.setxor1d(x, y)) and similarity._differing(a, a).tolist() == [0, 0]


def test_numbers_of_many_rows(spark):
    rows = spark.range(20_000).withColumn("h", F.xxhash64("id")).repartition(7)
    got = files.numbered(rows, "h").select("h", "n").collect()
    assert [x["n"] for x in sorted(got, key=lambda x: x["h"])] == list(range(1, 20_001))


def test_long_texts_have_grams_in_time(spark):
    text = " ".join(f"w{i}" for i in range(20_000))
    assert spark.createDataFrame([(text,)], "t string").select(F.size(T.word_grams("t")).alias("n")).first()["n"] == 19_996


def test_torn_tails_are_cut_and_rows_appended(spark, tmp_path):
    from lexmill.sources.sinks import append_jsonl, cut_torn_tails

    (tmp_path / "a.json").write_text('{"k": 1}\n{"k": 2}\n{"k": 3, "v"')
    (tmp_path / "b.json").write_text('{"k": 4}\n')
    (tmp_path / "c.json").write_text('{"k"' + " " * 200_000)
    (tmp_path / "d.json").write_text("")
    path = f"file://{tmp_path}"
    assert cut_torn_tails(spark, path) == 2 and cut_torn_tails(spark, path) == 0
    append_jsonl(spark.createDataFrame([(5,)], "k long").coalesce(1), path)
    lines = [x for f in tmp_path.glob("*.json") for x in f.read_text().split("\n") if x]
    assert sorted(lines) == [f'{{"k": {i}}}' for i in (1, 2, 4)] + ['{"k":5}']
