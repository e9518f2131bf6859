"""Scans, slugs, links, settings, batches."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import unicode as U
from lexmill.operators import links, scan
from lexmill.plans import runner


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_components_cover_all_lines(spark):
    text = "\n".join(["intro", "", "# H", "text", "why", "```", "x = 1", "```", "note", "", "FAQ: a", "b", "param p: 1", "c", "end"])
    df = spark.createDataFrame([(1, text)], "k long, t string")
    got = rows(scan.components(df, "k", "t"), "component")
    assert [(r[2], r[3], r[4]) for r in got] == [("text", 1, 2), ("heading", 3, 4), ("code", 5, 10), ("faq", 11, 12), ("parameter", 13, 15)]
    assert [r[5] for r in got] == [False, False, True, True, True]


def test_open_fence_runs_to_the_end(spark):
    df = spark.createDataFrame([(1, "a\n```\nx\ny"), (2, "")], "k long, t string")
    assert [(r[0], r[2], r[3], r[4]) for r in rows(scan.components(df, "k", "t"), "k", "component")] == [(1, "code", 1, 4), (2, "text", 1, 1)]


def test_fragments_point_at_their_heading(spark):
    df = spark.createDataFrame([(1, "top\n# A\nx\n## B\ny\n# C")], "k long, t string")
    assert [(r["line_no"], r["parent"]) for r in scan.fragments(df, "k", "t").orderBy("line_no").collect()] == [(1, None), (2, None), (3, 2), (4, 2), (5, 4), (6, None)]


def test_sections_leave_out_ignored_headings(spark):
    df = spark.createDataFrame([(1, "a\n# Revision history\nb\n# Steps 配置\nc\n# Empty")], "k long, t string")
    assert [(r["heading"], r["kind"]) for r in scan.typed_sections(df, "k", "t").orderBy("section_no").collect()] == [("概览", "detail"), ("Steps 配置", "procedure")]


def test_pages_split_before_headings(spark):
    text = "\n".join(["# A"] + ["x"] * 3 + ["# B"] + ["y"] * 3 + ["# C"] + ["z"] * 8)
    df = spark.createDataFrame([(1, text)], "k long, t string")
    assert [(r[2], r[3]) for r in rows(scan.split_pages(df, "k", "t", 6), "page")] == [(1, 4), (5, 8), (9, 14), (15, 17)]


def test_copied_runs(spark):
    s = "One two. Three four. Five six. Seven eight. Nine."
    df = spark.createDataFrame([(s, "One two. Three four. Five six."), (s, "x " + s), (s, "other")], "a string, b string")
    assert [r[0] for r in df.select(scan.copied_run("a", "b")).collect()] == [False, True, False]


def test_safe_prefix(spark):
    df = spark.createDataFrame([([True, False, True],), ([True],), ([],)], "f array<boolean>")
    assert [r[0] for r in df.select(scan.safe_prefix("f")).collect()] == [1, 1, 0]


def test_slugs(spark):
    df = spark.createDataFrame([("Crème Brûlée № 5",), ("Index",), ("中文 x",), (None,)], "x string")
    got = df.select(U.readable_slug("x"), U.strict_slug("x"), U.evidence_slug("x")).collect()
    assert [tuple(r) for r in got] == [("creme-brulee-no-5", "crème-brûlée-no-5", "cr-u00e8-me-br-u00fb-l-u00e9-e-no-5"), ("index", "x-index", "index"), ("x", "中文-x", "u4e2d-u6587-x"), (None, None, None)]


def test_frontmatter(spark):
    df = spark.createDataFrame([("---\nb: 2\na: x\n---\nbody",), ("no block",), ("---\n: [\n---\n",), (None,)], "x string")
    assert [r[0] for r in df.select(U.frontmatter_json("x")).collect()] == ['{"a": "x", "b": 2}', None, None, None]


def test_links_are_repaired_or_lose_their_target(spark):
    pages = spark.createDataFrame([(1, "a [x](old.md#s) b [y](gone.md) c [z](https://h/) d ![i](p.png)"), (2, "none")], "k long, t string")
    targets = spark.createDataFrame([("old.md", "new/old.md")], "target string, path string")
    assert rows(links.rewrite(pages, "k", "t", targets), "k") == [(1, "a [x](new/old.md#s) b y c [z](https://h/) d i"), (2, "none")]


def test_settings():
    assert runner.resolve_settings({"top_k": 3}, {"top_k": None, "high": 0.95}).top_k == 3
    for bad in ({"high": 0.5, "medium": 0.8}, {"top_k": 0}, {"high": True}, {"page_match": 2}):
        with pytest.raises(ValueError):
            runner.resolve_settings(bad)
    with pytest.raises(TypeError):
        runner.resolve_settings({"unknown": 1})


def test_backend_fails_closed():
    full = {"endpoint": "https://h/v1", "model": "m", "dimension": 4, "cached_dimension": 4}
    assert runner.resolve_backend("embedding", **full) == ("embedding", "ready")
    assert runner.resolve_backend("jaccard", **full)[0] == "jaccard"
    for k, v, why in (("endpoint", None, "endpoint_missing"), ("endpoint", "ftp://x", "endpoint_invalid"), ("cached_dimension", 5, "dimension_mismatch")):
        assert runner.resolve_backend("embedding", **{**full, k: v}) == ("jaccard", why)


def test_fallback_restarts_on_the_second_plan(spark):
    good = lambda: spark.range(3)
    bad = lambda: spark.range(3).select(F.raise_error(F.lit("no")))
    assert runner.with_fallback(good, bad)[1] == "first"
    df, said = runner.with_fallback(bad, good, lambda x: x.collect())
    assert df.count() == 3 and said.startswith("fallback")


def test_lineages_cover_both_splits():
    strata = [(f"l{i}", s) for i in range(9) for s in ("a", "b", "c") if (i + ord(s)) % 2]
    chosen = runner.split_lineages(strata)
    for s in "abc":
        assert {chosen[x] for x, y in strata if y == s} == {"calibration", "holdout"}
    assert runner.split_lineages([("one", "x")]).keys() == {"one"}


def test_batches_resume_where_they_failed(spark, tmp_path):
    data, seen, broken = spark.createDataFrame([(i,) for i in range(10)], "k long"), [], {"on": True}

    def work(df):
        keys = sorted(r["k"] for r in df.collect())
        if broken["on"] and 4 in keys:
            raise RuntimeError("x")
        seen.append(keys)

    run = lambda: runner.run_batches(spark, data, work, key="k", size=4, state_path=str(tmp_path / "state"))
    assert run().done == {0: "done", 1: "failed: RuntimeError", 2: "done"}
    broken["on"] = False
    assert run().done == {0: "done", 1: "done", 2: "done"}
    assert seen == [[0, 1, 2, 3], [8, 9], [4, 5, 6, 7]]
    with pytest.raises(ValueError, match="inputs changed"):
        runner.run_batches(spark, data.where("k < 9"), work, key="k", size=4, state_path=str(tmp_path / "state"))


def test_embedding_requests_are_bounded(spark):
    df = spark.createDataFrame([(str(i), "x" * (i + 1)) for i in range(20)], "input_hash string, text string").coalesce(1)

    def client(texts):
        assert len(texts) <= 4 and sum(map(len, texts)) <= 40
        return [[float(len(t))] for t in texts]

    assert {r["input_hash"]: r["vector"] for r in runner.embed(df, client, most_texts=4, most_chars=40).collect()} == {str(i): [i + 1.0] for i in range(20)}
    with pytest.raises(Exception, match="does not fit"):
        runner.embed(df, lambda texts: [[0.0]] * len(texts)).collect()


def test_generator_is_identity_by_default(spark):
    df = spark.range(2)
    assert runner.generate(df, "id long") is df
    assert rows(runner.generate(df, "id long", lambda r: {"id": r["id"] + 1}), "id") == [(1,), (2,)]


def test_preflight_runs_nothing(spark):
    plan = runner.preflight({"a": spark.range(5).select(F.raise_error(F.lit("ran")).alias("x"))})
    assert plan["a"]["columns"] == ["x"] and plan["a"]["bytes"] > 0
