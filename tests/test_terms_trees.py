"""Many terms in one pass, nested sections, hash trees, snapshot merges."""

import random
import time

import pytest

from lexmill.operators import joins, layout, terms
from lexmill.sources import merkle as M


def test_absent_terms(spark):
    pages = spark.createDataFrame([(1, "The Quick brown"), (2, None), (3, "ÉTÉ à Paris")], "k long, t string")
    asked = [(1, "quick"), (2, "BROWN"), (3, "slow"), (4, "été"), (5, None), (6, ""), (7, "quick")]
    got = terms.absent_terms(spark.createDataFrame(asked, "id long, term string"), "id", pages, "t")
    assert {r["id"]: r["absent"] for r in got.collect()} == {1: False, 2: False, 3: True, 4: False, 5: True, 6: False, 7: False}
    assert all(r["absent"] for r in terms.absent_terms(spark.createDataFrame([(1, "a"), (2, "")], "id long, term string"), "id", pages.limit(0), "t").collect())
    assert terms.absent_terms(spark.createDataFrame([], "id long, term string"), "id", pages, "t").count() == 0


def test_votes_equal_counting(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcß") for _ in range(r.randrange(1, 4))) for _ in range(60)]
    listed = [(r.choice("xyz"), w) for w in words] + [("x", "ab"), ("y", "ab"), ("x", "ab")]
    texts = [(i, "".join(r.choice("abcABCß ") for _ in range(r.randrange(30)))) for i in range(80)] + [(90, None), (91, "")]
    got = {x["k"]: x["category"] for x in terms.category_votes(spark.createDataFrame(texts, "k long, t string"), "k", "t", spark.createDataFrame(listed, "category string, term string")).collect()}
    fold = lambda x: x.lower().replace("ß", "ss")
    for k, t in texts:
        n = {c: len({fold(w) for d, w in listed if d == c and fold(w) in fold(t or "")}) if t is not None else 0 for c in "xyz"}
        best = min(n, key=lambda c: (-n[c], c))
        assert got[k] == (best if n[best] else "pending")


def test_ten_thousand_terms_cost_little_more_than_ten(spark):
    r = random.Random(1)
    pages = spark.createDataFrame([(" ".join(f"w{r.randrange(50_000)}" for _ in range(400)),) for _ in range(400)], "t string").repartition(4).persist()
    pages.count()
    seconds = []
    for n in (10, 10_000):
        asked = spark.createDataFrame([(i, f"term-{i}-x") for i in range(n - 1)] + [(-1, "w7")], "id long, term string").persist()
        asked.count()
        terms.absent_terms(asked, "id", pages, "t").count()
        began = time.time()
        assert terms.absent_terms(asked, "id", pages, "t").where("NOT absent").count() == 1
        seconds.append(time.time() - began)
    assert seconds[1] < 4 * seconds[0] + 1


def test_too_many_characters_raise(spark, monkeypatch):
    monkeypatch.setattr(terms, "MOST_CHARS", 5)
    with pytest.raises(ValueError):
        terms.found_terms(spark.createDataFrame([("x",)], "t string"), "t", spark.createDataFrame([("abc",), ("def",)], "term string"))


@pytest.mark.parametrize("seed", range(3))
def test_nested_sections_equal_a_search(spark, seed):
    r = random.Random(seed)
    lines = ["#" * r.randrange(1, 7) + f" h{i}" if r.random() < 0.4 else r.choice(["", "- ", "ab", "long text here", "#no heading"]) for i in range(80)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "no heading"), (3, None), (4, "# only")], "k long, t string")
    got = {(x["k"], x["line_no"]): tuple(x)[2:] for x in layout.nested_sections(docs, "k", "t").collect()}
    level = lambda x: len(x) - len(x.lstrip("#")) if x.lstrip("#").startswith(" ") and x.startswith("#") else None
    want = {(4, 1): ("only", 1, 1, "", False)}
    for i, x in enumerate(lines):
        if level(x):
            stop = next((j for j in range(i + 1, len(lines)) if level(lines[j]) and level(lines[j]) <= level(x)), len(lines))
            body = "\n".join(y for y in lines[i + 1 : stop] if not level(y))
            want[1, i + 1] = (x.lstrip("#")[1:], level(x), stop, body, sum(c.isalnum() for c in body) >= 4)
    assert got == want


def test_hash_trees_find_what_changed(spark):
    rows = [(f"p/{i}", f"h{i}", i) for i in range(600)]
    new = [("p/7", "other", 7) if i == 7 else x for i, x in enumerate(rows) if i != 100] + [("p/new", "h", 1)]
    a, b = (M.entries(spark.createDataFrame(x, "path string, h string, size long"), "path", ["h", "size"]) for x in (rows, new))
    changes, compared = M.changed_paths(a, b, 2)
    assert sorted(map(tuple, changes.collect())) == [("p/100", "removed"), ("p/7", "changed"), ("p/new", "added")]
    assert compared <= 1 + 16 + 3 * 16
    same, compared = M.changed_paths(a, M.entries(spark.createDataFrame(rows[::-1], "path string, h string, size long").repartition(5), "path", ["h", "size"]), 2)
    assert same.count() == 0 and compared == 1
    assert M.roots(M.hash_tree(a, 2)).first()["n"] == 600 and M.roots(M.hash_tree(a.limit(0), 2)).count() == 0
    assert M.roots(M.hash_tree(a, 2)).first()["hash"] != M.roots(M.hash_tree(b, 2)).first()["hash"]
    assert [M.depth_for(n) for n in (0, 4096, 4097, 65536, 10**12)] == [1, 1, 2, 2, 8]


def test_snapshots_merge_one_to_one(spark):
    index = [("a", None, None, 1), (" ", "b", None, 2), (None, None, "c", 3), ("d", None, None, 4), ("d", None, None, 5), (None, "", " ", 6), ("e", None, None, 7), ("f", None, None, 8)]
    snapshot = [("a", None, None, ["x"], None, None), (None, "b", None, None, None, None), ("d", None, None, None, None, None), ("z", None, None, None, None, None), ("e", None, None, None, ["old"], None), ("f", None, None, ["y"], None, ["bare"]), ("f", None, None, ["y"], None, None)]
    i = spark.createDataFrame(index, "topic_id string, digest_topic_id string, topic_key string, related_topic_refs long")
    s = spark.createDataFrame(snapshot, "topic_id string, digest_topic_id string, topic_key string, related_topic_refs array<string>, old_path_mapping array<string>, related_topic_ids array<string>")
    merged, codes = joins.merge_snapshots(i, s)
    assert sorted((r["name"], r["row"]["related_topic_refs"], r["related_topic_refs"]) for r in merged.collect()) == [("a", 1, ["x"]), ("b", 2, None)]
    assert sorted((r["side"], r["name"] or "", r["code"], r["n"]) for r in codes.collect()) == [
        ("index", "", "NAME_MISSING", 1), ("index", "c", "NOT_IN_SNAPSHOT", 1), ("index", "d", "NAME_REPEATED", 2), ("snapshot", "e", "OLD_PATHS_FOREIGN", 1), ("snapshot", "f", "NAME_REPEATED", 2), ("snapshot", "f", "RELATIONS_WITHOUT_EVIDENCE", 2), ("snapshot", "z", "NOT_IN_INDEX", 1),
    ]
