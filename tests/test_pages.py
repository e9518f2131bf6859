import random

import numpy as np
import pytest

from lexmill.operators import pages as P
from lexmill.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("stretch", [3, 4096])
def test_uneven_cover_equals_counting(spark, seed, stretch):
    r = random.Random(seed)
    extents = [(k, r.randrange(1, 4), r.randrange(4, 40)) for k in range(6)]
    spans = [(r.randrange(7), a, a + r.randrange(-1, 9)) for a in (r.randrange(0, 42) for _ in range(45))]
    got = P.uneven_cover(spark.createDataFrame(spans, "k long, a int, b int"), "k", "a", "b", spark.createDataFrame(extents, "k long, lo int, hi int"), "lo", "hi", stretch)
    want = set()
    inside = {k: range(lo, hi + 1) for k, lo, hi in extents}
    for k in range(7):
        owners = {p: sum(a <= p <= b for q, a, b in spans if q == k) for p in range(-1, 60)}
        odd = {p: (n, p in inside.get(k, ())) for p, n in owners.items() if (p in inside.get(k, ()) and n != 1) or (n > 0 and (n > 1 or p not in inside.get(k, ())))}
        for p in sorted(odd):
            if odd.get(p - 1) != odd[p]:
                end = p
                while odd.get(end + 1) == odd[p]:
                    end += 1
                want.add((k, p, end, odd[p][0]))
    assert {tuple(x) for x in got.collect()} == want


def test_pages_hold_components_whole(spark):
    text = "\n".join(["intro", "", "## A", "x", "unsupported: y", "FAQ: q", "answer", "## B"] + ["z"] * 9 + ["## C", "unsupported: only"])
    docs = spark.createDataFrame([(1, text)], "k long, t string")
    at = P.place_components(docs, "k", "t", 5)
    rows = at.orderBy("component").collect()
    assert [(r["line_start"], r["line_end"], r["page"], r["oversized"]) for r in rows] == [(1, 2, 1, False), (3, 5, 1, False), (6, 7, 2, False), (8, 17, 3, True), (18, 19, 4, False)]
    shown = P.rendered_lines(docs, "k", "t", at)
    assert [(r["line_no"], r["place"]) for r in shown.where("page = 1").orderBy("line_no").collect()] == [(1, 1), (3, 3), (4, 4)]
    claims = spark.createDataFrame([(1, "a", 4, 6), (1, "b", 5, 5), (1, "c", 99, 99), (1, "d", 8, 17)], "k long, claim string, line_start int, line_end int")
    assert [tuple(r)[1:] for r in P.claim_places(claims, "k", at, shown).orderBy("claim").collect()] == [("a", 2, 1, 4, 4), ("b", 2, 1, None, None), ("c", None, None, None, None), ("d", 4, 3, 1, 10)]
    assert [(r["component"], r["page"], r["omitted"]) for r in P.component_places(at, "k", shown).orderBy("component").collect()] == [(1, 1, False), (2, 1, False), (3, 2, False), (4, 3, False), (5, 4, False)]
    none = spark.createDataFrame([(1, "unsupported: a\nunsupported: b")], "k long, t string")
    alone = P.place_components(none, "k", "t", 5)
    assert [tuple(r)[2:] for r in P.component_places(alone, "k", P.rendered_lines(none, "k", "t", alone)).collect()] == [(None, None, None, True)] * alone.count()
    exact = P.uneven_cover(at, "k", "line_start", "line_end", docs.selectExpr("k", "1 AS lo", "19 AS hi"), "lo", "hi")
    assert exact.count() == 0


def test_target_paths(spark):
    df = spark.createDataFrame([("p/a.md", 1), ("p/a.md", 3), ("p/a", 2)], "b string, n int")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(P.target_path(F.col("b"), F.col("n"))).collect()] == ["p/a.md", "p/a-part-3.md", "p/a-part-2"]


@pytest.mark.parametrize("seed", range(2))
def test_quantiles_equal_numpy(spark, seed):
    r = random.Random(seed)
    rows = [(g, r.choice([r.gauss(0, 1), float(r.randrange(3)), None, float("nan")])) for g in ("a", "b", None) for _ in range(r.randrange(40, 90))] + [("one", 5.0), ("none", None)]
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {x["g"]: x["q"] for x in exact_quantiles(df, ["g"], "x", shares).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g, q in got.items():
        own = [x for h, x in rows if h == g and x is not None and x == x]
        assert np.allclose(q, np.quantile(own, shares), rtol=0, atol=1e-12)
    own = [x for _, x in rows if x is not None and x == x]
    assert np.allclose(exact_quantiles(df, [], "x", shares).first()["q"], np.quantile(own, shares), rtol=0, atol=1e-12)
    assert exact_quantiles(df.limit(0), [], "x", shares).count() == 0 and exact_quantiles(df.limit(0), ["g"], "x", shares).count() == 0


def test_quantiles_of_one_repeated_value(spark):
    rows = spark.range(200_000).selectExpr("'g' AS g", "CASE WHEN id % 1000 = 0 THEN 2.0D ELSE 1.0D END AS x")
    assert exact_quantiles(rows, ["g"], "x", [0.5, 0.9985, 1.0]).first()["q"] == [1.0, 1.0, 2.0]
