"""Operators on small inputs: boundaries, order invariance, replay."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import calibrate, clusters, dedup, gates, graph, joins, layout, ledger, similarity, taxonomy
from lexmill.sources import files, sinks


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def jaccard(a, b):
    a, b = set(a.lower().split()), set(b.lower().split())
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.mark.parametrize("seed", range(3))
def test_similar_pairs_equal_brute_force(spark, seed):
    r = random.Random(seed)
    base = [[r.choice("abcdefghijklmnop") + str(r.randint(0, 9)) for _ in range(20)] for _ in range(8)]
    texts = [(i, " ".join(w if r.random() > 0.06 else "z" + w for w in r.choice(base))) for i in range(60)]
    want = {(a, b): round(jaccard(x, y), 9) for a, x in texts for b, y in texts if a < b and jaccard(x, y) >= 0.8}
    got = similarity.similar_pairs(spark.createDataFrame(texts, "k long, t string"), "k", "t", 0.8)
    assert {(x[0], x[1]): round(x[2], 9) for x in rows(got)} == want


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a b c d e")], "k long, t string")
    assert rows(similarity.similar_pairs(df, "k", "t", 0.8)) == [(1, 2, 0.8)]


def test_greedy_clusters_need_all_members(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9)], "a long, b long, score double")
    comps = clusters.smallest_reachable(pairs, spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "k long"), "k")
    assert rows(comps, "k") == [(1, 1), (2, 1), (3, 1), (4, 4)]
    assert rows(clusters.greedy_clusters(pairs, comps, "k"), "k") == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_page_decision_rounds_before_the_threshold(spark):
    m = spark.createDataFrame([("q", "p1", 0.1499996), ("r", "p1", 0.149), ("s", "p1", 0.5), ("s", "p2", 0.2)], "q string, p string, score double")
    out = similarity.page_decision(m, spark.createDataFrame([("q",), ("r",), ("s",), ("t",)], "q string"), "q", "p")
    assert rows(out, "q") == [("q", "revise", 1), ("r", "new", 0), ("s", "merge_multiple", 2), ("t", "new", 0)]


def test_top_k_ties_go_to_the_smaller_key(spark):
    df = spark.createDataFrame([("g", "b", 1.0), ("g", "a", 1.0), ("g", "c", 2.0)], "g string, k string, score double")
    assert [(r["k"], r["rank"]) for r in similarity.top_k(df, "g", 2, "k").orderBy("rank").collect()] == [("c", 1), ("a", 2)]


def test_cosine_of_nought_raises(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="norm 0"):
        df.select(similarity.cosine("a", "b")).collect()


def packed(sizes, limit):
    out, cur, total = [], 1, 0
    for s in sizes:
        if total and total + s > limit:
            cur, total = cur + 1, 0
        out.append(cur)
        total += s
        if s > limit:
            cur, total = cur + 1, 0
    return out


@pytest.mark.parametrize("seed", range(4))
def test_packing_with_reset(spark, seed):
    r = random.Random(seed)
    sizes = [r.randint(1, 14) for _ in range(40)]
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate(sizes)], "g string, pos long, size long").repartition(3)
    assert [x["bin"] for x in layout.pack_groups(df, "g", "pos", "size", 10).orderBy("pos").collect()] == packed(sizes, 10)


def test_parents_take_the_nearest_smaller_level(spark):
    df = spark.createDataFrame([("d", 1, 1), ("d", 2, 3), ("d", 3, 2), ("d", 4, 3), ("d", 5, 1)], "d string, p long, l int")
    assert [r["parent"] for r in layout.parents(df, "d", "p", "l").orderBy("p").collect()] == [None, 1, 1, 3, None]


def test_blank_runs(spark):
    lines = ["a", "", "", "", "b", "", "c"]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "d string, p long, t string")
    assert [r["p"] for r in layout.blank_runs(df, "d", "p", "t").orderBy("p").collect()] == [0, 1, 2, 4, 5, 6]


def test_span_join_spreads_long_spans(spark):
    c = spark.createDataFrame([("d", 5), ("d", 200), ("d", 999)], "d string, s long")
    s = spark.createDataFrame([("d", 1, 300), ("d", 150, 250)], "d string, a long, b long")
    got = joins.span_join(c, s, "d", "s", "a", "b").select("s", "a")
    assert rows(got, "s", "a") == [(5, 1), (200, 1), (200, 150)]


def test_contained_in_one(spark):
    sets = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("z", 9)], "k string, m long")
    groups = spark.createDataFrame([("g", 1), ("g", 2), ("h", 1)], "g string, m long")
    assert rows(joins.contained_in_one(sets, "k", groups, "g", "m"), "k") == [("x", "g"), ("y", None), ("z", None)]


def test_section_impact(spark):
    old = spark.createDataFrame([("p", "a", 1), ("p", "b", 1), ("q", "a", 1), ("q", "b", 2)], "p string, s string, v int")
    new = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("q", "a", 1)], "p string, s string, v int")
    assert rows(joins.section_impact(old, new, "p", "s", "v"), "p", "s") == [("p", "a", "reuse"), ("p", "b", "affected"), ("q", "a", "uncertain"), ("q", "b", "uncertain")]


def test_fold_keeps_older_fields(spark):
    log = spark.createDataFrame([("k", 1, "a", None), ("k", 2, None, "y"), ("k", 3, "c", None)], "k string, seq long, x string, y string")
    assert rows(ledger.fold_latest(log, ["k"], "seq", ["x", "y"])) == [("k", "c", "y")]


def test_replay_of_an_upsert_adds_nothing(spark):
    a = spark.createDataFrame([("k", 1, "x"), ("l", 2, "y")], "k string, seq long, v string")
    once = ledger.upsert(a, a.limit(0), ["k"], "seq")
    twice = ledger.upsert(a, a, ["k"], "seq")
    assert rows(once, "k") == rows(twice, "k")


def test_supersession_needs_another_value(spark):
    log = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 3, "b")], "k string, seq long, v string")
    got = ledger.supersession(log, ["k"], "seq", "v").orderBy("seq").select("supersedes", "superseded_by")
    assert rows(got) == [(None, None), (None, "b"), ("a", None)]


def test_multiset_difference(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "v string")
    assert rows(ledger.multiset_difference(a, spark.createDataFrame([("x",)], "v string")), "v") == [("x", 1), ("y", 1)]


def test_null_sum(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (2, 3)], "g int, v int")
    assert rows(df.groupBy("g").agg(ledger.null_sum("v")), "g") == [(1, None), (2, 3)]


def test_hops_on_a_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 1)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "node long")
    assert rows(graph.hops(e, start), "node") == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert rows(graph.hops(e, start, 1), "node") == [(1, 0), (2, 1)]


def test_routes_prefer_the_first_link(spark):
    e = spark.createDataFrame([("h", "b", 0), ("h", "a", 1), ("a", "t", 0), ("b", "t", 5)], "src string, dst string, pos int")
    assert dict((r["node"], r["route"]) for r in graph.routes(e, "h").collect())["t"] == ["h", "b", "t"]


def test_routes_have_no_hop_limit(spark):
    e = spark.createDataFrame([(i, i + 1, 0) for i in range(23)], "src long, dst long, pos int")
    assert {r["node"]: r["hops"] for r in graph.routes(e, 0).collect()} == {i: i for i in range(24)}


def test_lineage_split_keeps_all_lineages(spark, tmp_path):
    import __spark_entry__ as entry

    rows = spark.range(10_500).selectExpr("id AS vec_id", "id AS label", "array(cast(1 AS float)) AS embedding")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert entry.queries()["sim_15_lineage_split"](spark, str(tmp_path)).count() == 10_500


def test_targets_that_leave_the_tree(spark):
    df = spark.createDataFrame([("a/b.md", "../c.md"), ("a/b.md", "../../c.md"), ("a/b.md", "./x/../y.md")], "s string, t string")
    assert [r[0] for r in df.select(graph.normalized_target(F.col("s"), F.col("t"))).collect()] == ["c.md", None, "a/y.md"]


def test_classification_metrics_with_empty_denominators(spark):
    df = spark.createDataFrame([("g", False, False), ("h", True, True)], "g string, a boolean, p boolean")
    m = calibrate.classification(df, "g", "a", "p")
    assert rows(m.select("g", "precision", "recall"), "g") == [("g", None, None), ("h", 1.0, 1.0)]
    assert rows(calibrate.denominator_gaps(m, "g"), "gap") == [("g", "precision|predicted_positive"), ("g", "recall|gold_positive")]


def test_duplicates_keep_the_first_path(spark):
    df = spark.createDataFrame([("b", "h"), ("a", "h"), ("c", "i")], "path string, content_hash string")
    assert [(r["path"], r["duplicate_of"]) for r in dedup.duplicates(df).collect()] == [("b", "a")]


def test_order_of_input_does_not_matter(spark):
    data = [(i, f"u{i % 3}", f"h{i % 4}") for i in range(30)]
    shuffled = data[:]
    random.Random(1).shuffle(shuffled)
    make = lambda d: rows(dedup.uri_conflicts(spark.createDataFrame(d, "i long, uri string, content_hash string")), "uri")
    assert make(data) == make(shuffled)


def test_tiered_match(spark):
    rec = spark.createDataFrame([(1, "Alpha", None), (2, None, "al"), (3, None, "dup"), (4, None, None)], "k long, x string, y string")
    entries = spark.createDataFrame([("Alpha", "alpha"), ("Alpha", "al"), ("Beta", "dup"), ("Gamma", "dup")], "canonical string, name string")
    got = taxonomy.tiered_match(rec, "k", [("canonical", F.col("x")), ("alias", F.col("y"))], entries)
    assert rows(got, "k") == [(1, "canonical", "Alpha", "matched"), (2, "alias", "Alpha", "matched"), (3, "alias", None, "conflict"), (4, None, None, "unknown")]


def test_supported_by_body(spark):
    df = spark.createDataFrame([("the limit is 5 items per page", "per page the limit of items is 5"), ("limit is 6 items", "limit is 5 items"), ("- short", "a short one")], "c string, b string")
    assert [r[0] for r in df.select(gates.supported_by_body(F.col("c"), F.col("b"))).collect()] == [True, False, True]


def test_jsonl_tolerates_a_torn_tail_only(spark, tmp_path):
    p = tmp_path / "ok.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\n{"a": 3')
    assert sorted(r["a"] for r in files.read_jsonl(spark, str(p), "a int").collect()) == [1, 2]
    q = tmp_path / "bad.jsonl"
    q.write_text('{"a": 1}\n{"a": \n{"a": 3}\n')
    with pytest.raises(Exception, match="corrupt line"):
        files.read_jsonl(spark, str(q), "a int").collect()


def test_tree_scan(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.md").write_text("A")
    (tmp_path / "b.txt").write_text("B")
    (tmp_path / "c.bin").write_text("C")
    got = files.scan_tree(spark, str(tmp_path))
    assert rows(got.select("path", "text"), "path") == [("b.txt", "B"), ("x/a.md", "A")]
    only = spark.createDataFrame([("b.txt",)], "path string")
    assert rows(files.scan_tree(spark, str(tmp_path), allowed=only).select("path")) == [("b.txt",)]


def test_replace_keeps_nulls_and_sorts_keys(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for v in (1, 2):
        sinks.replace_jsonl(spark.createDataFrame([(v, None)], "b int, a string"), path)
    text = "".join(f.read_text() for f in (tmp_path / "ledger").glob("part-*"))
    assert text == '{"a":null,"b":2}\n'
    assert [p.name for p in tmp_path.iterdir()] == ["ledger"]


def test_numbered(spark):
    df = spark.createDataFrame([(x,) for x in (5, 3, 9, 1)], "v long").repartition(3)
    assert rows(files.numbered(df, "v").select("n", "v"), "n") == [(1, 1), (2, 3), (3, 5), (4, 9)]
