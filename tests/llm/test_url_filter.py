import random

import numpy as np

from lexmill.llm import url_filter as U
from lexmill.llm.bloom import BlockedBloom, build_filter
from tests.oracle import same_rows

SMALL = "/root/testdata/sf0.001"


def test_equals_sql(spark):
    same_rows(U.op8_url_filter(spark, SMALL), U.OP8_SQL, SMALL)


def test_rules(spark):
    rows = [(1, "http://A.net/x"), (2, "http://a.example.net/en/1"), (3, "http://example.net/en"), (4, "https://notexample.com/de/"), (5, "ftp://x.example.com/de/?q"), (6, "http://w.org/fr/"), (7, "http://w.org"), (8, None), (9, "no scheme"), (10, "http://net"), (11, "http://net/"), (12, ""), (12, "")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS verdict", "3 AS listed", "4 AS canonical")
    listed = spark.createDataFrame([("w.org",), (None,), ("w.org",)], "canonical string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(df, listed).collect()}
    assert got == {
        1: ("a.net", "/x", "net/", "block"), 2: ("a.example.net", "/en/1", "example.net/en/", "allow"), 3: ("example.net", "/en", "net/", "block"),
        4: ("notexample.com", "/de/", None, "allow"), 5: ("x.example.com", "/de/", "example.com/de/", "block"), 6: ("w.org", "/fr/", "org/fr/", "allow"),
        7: ("w.org", "", None, "block"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("net", "", None, "allow"), 11: ("net", "/", "net/", "block"), 12: ("", "", None, "allow"),
    }
    assert U.judge(df, listed).count() == len(rows)


def test_canonical_forms(spark):
    urls = ["HTTPS://WWW.A.org:443/x/?utm_source=f&b=1&ref=z#t", "http://a.org/x?b=1", "http://a.org/x/#q"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(U.canonical("url")).collect()] == ["a.org/x?b=1", "a.org/x?b=1", "a.org/x"]


def test_filter_lets_all_listed_pass_at_any_size(spark):
    from pyspark.sql import functions as F

    r = random.Random(1)
    words = ["".join(r.choice("abcdef") for _ in range(12)) for _ in range(5000)]
    listed = spark.createDataFrame([(w,) for w in sorted(set(words[:2500]))], "canonical string")
    tested = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).toPandas()
    inside = tested.w.isin(set(words[:2500])).to_numpy()
    for blocks, most in ((1 << 20, 0.02), (16, 1.0)):
        got = build_filter(listed, max_blocks=blocks).test(tested.h.to_numpy())
        assert got[inside].all() and got[~inside].mean() <= most
    assert not BlockedBloom(np.zeros((0, 8), np.uint32)).test(np.array([1, 2])).any()


def test_empty_tables(spark):
    empty, none = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "canonical string")
    assert U.judge(empty, none).count() == 0
    assert [r["verdict"] for r in U.judge(spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string"), none).collect()] == ["allow"]
