"""Identities, answers, entries, scores and question pages on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import review as V
from lexmill.plans.registry import QUERIES
from tests.oracle import SMALL

TOPIC = "topic_id string, source_ids array<string>, category_id string, published_path string"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_locked_topics_keep_their_place_and_new_ones_do_not_collide(spark):
    lock = spark.createDataFrame([("topic-a", ["s2", "s1"], "c1", "x.md"), ("topic-b", None, "c1", "b.md")], TOPIC)
    topics = [("topic-a", ["s3", "s1", None, ""], "c1", "other.md"), ("topic-b", [], "c2", "b.md"), ("topic-n1", ["s"], "c", "x.md"), ("topic-n222222222", ["s"], "c", "n.md"), ("topic-n3", None, "c", "n.md"), ("topic-n4", ["s"], None, "m.md")]
    assert rows(V.resolve_topics(spark.createDataFrame(topics, TOPIC), lock), "topic_id") == [
        ("topic-a", ["s1", "s2", "s3"], "c1", "x.md", "kept", False),
        ("topic-b", [], "c1", "b.md", "kept", True),
        ("topic-n1", ["s"], "c", "x-n1.md", "new", True),
        ("topic-n222222222", ["s"], "c", "n.md", "new", False),
        ("topic-n3", [], "c", "n-n3.md", "new", True),
        ("topic-n4", ["s"], None, "m.md", "new", False),
    ]
    assert V.resolve_topics(lock.limit(0), lock).count() == 0


def test_each_breach_of_the_answer_contract(spark):
    q = spark.createDataFrame([(i, "positive" if i % 2 else "negative") for i in range(1, 9)], "question_id long, polarity string")
    a = [(1, "positive", True, "t"), (2, "negative", False, None), (3, "positive", True, " "), (4, "negative", True, "t"), (5, "negative", False, None), (6, "negative", False, "t"), (7, "positive", True, "t"), (7, "positive", True, "t"), (9, "positive", True, "t")]
    got = V.answerability_failures(spark.createDataFrame(a, "question_id long, polarity string, answerable boolean, first_hit string"), q)
    assert rows(got, "question_id", "code") == [(3, "FIRST_HIT_MISSING"), (4, "NEGATIVE_ANSWERABLE"), (5, "POLARITY_OR_STATUS"), (6, "FIRST_HIT_UNEXPECTED"), (7, "ANSWER_REPEATED"), (8, "ANSWER_MISSING"), (9, "QUESTION_UNKNOWN")]


def test_one_producer_binds_a_bundle(spark):
    e = [(1, "a", "verified"), (1, "a", "passed"), (2, "a", "verified"), (2, "b", "passed"), (2, "a", "draft"), (3, "a", "verified"), (3, "b", "draft"), (3, None, "verified"), (3, "a", None), (4, None, None)]
    got = V.entry_bindings(spark.createDataFrame(e, "k long, p string, s string"), "k", "p", "s")
    mix, none, bad = "ENTRY_PRODUCER_MISMATCH", "ENTRY_PRODUCER_MISSING", "ENTRY_STATUS_UNSUPPORTED"
    want = [(1, "", "passed")] * 2 + [(2, mix, "blocked")] * 2 + [(2, f"{mix},{bad}", "blocked"), (3, "", "passed")] + [(3, none, "blocked")] + [(3, bad, "blocked")] * 2 + [(4, bad, "blocked")]
    assert sorted((r["k"], r["codes"], r["binding"]) for r in got.collect()) == sorted(want)


def test_scores_need_sound_counts(spark):
    s = [(9, 10, "x"), (8, 10, "x"), (0, 0, "x"), (11, 10, "x"), (-1, 10, "x"), (None, 10, "x"), (9, 10, " "), (9, 10, None)]
    got = [(r["rate"], r["code"]) for r in V.score(spark.createDataFrame(s, "p long, n long, a string").coalesce(1), "p", "n", ["a"]).collect()]
    assert got == [(0.9, None), (0.8, "ACCURACY_BELOW_THRESHOLD")] + [(0.0, "METADATA_INVALID")] * 6


def test_quality_of_nothing_is_cleanliness(spark):
    none = spark.createDataFrame([], "p string, m string, v boolean, r boolean, a boolean, e boolean, x long")
    args = {"product": "p", "module": "m", "valid": "v", "readable": "r", "anchored": "a", "entry": "e", "violations": "x"}
    assert rows(V.quality_proxy(none, **args)) == [(0.0, 0.0, 0.0, 15.0, 0.0, 0.0, 15.0)]
    some = spark.createDataFrame([("p", "m", True, True, True, True, 0), ("q", "m", False, True, True, False, 3)], none.schema)
    assert rows(V.quality_proxy(some, **args)) == [(20.0, 10.0, 7.5, 12.0, 10.0, 10.0, 69.5)]


def folded(questions, pages):
    """Question by question over all pages."""
    used, out = set(), {}
    every = {p for p, _, _, s in pages if s}
    for q, t, k in questions:
        fit = [(p, s) for p, topic, kind, s in pages if (t is None or topic == t) and (t is not None or k is None or kind == k)]
        fresh = sorted(p for p, s in fit if s and p not in used)
        out[q] = fresh[0] if fresh else min(p for p, _ in fit)
        if out[q] in every:
            used.add(out[q])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_question_pages_equal_a_fold_over_all_pages(spark, seed):
    r = random.Random(seed)
    pages = [(f"p{i:03d}", r.choice("abc"), r.choice("xy"), r.choice([True, False, None])) for i in range(60)]
    r.shuffle(pages)
    asked = [(f"q{i}", *r.choice([("a", None), ("b", "x"), (None, "y"), (None, None)])) for i in range(30)]
    assert V.question_pages(asked, spark.createDataFrame(pages, "path string, topic_id string, page_type string, sampled boolean")) == folded(asked, pages)


def test_question_pages_refuse_what_they_cannot_place(spark):
    pages = spark.createDataFrame([("p", "a", "x", True)], "path string, topic_id string, page_type string, sampled boolean")
    for asked, why in (([("q", "z", None)], "no page"), ([("q", "a", None)] * 2, "twice"), ([(str(i), "a", None) for i in range(3)], "more than")):
        with pytest.raises(ValueError, match=why):
            V.question_pages(asked, pages, 2)


@pytest.mark.parametrize(
    "name, column, least",
    [("ext_01_topic_identity", "state", 2), ("ext_01_topic_identity", "needs_review", 2), ("ext_30_answerability_contract", "code", 7), ("ext_33_verdict", "answer_result", 2), ("ext_33_verdict", "failure_reason", 2), ("ext_34_score_threshold", "code", 3), ("ext_36_entry_bindings", "codes", 5), ("gte_14_confirmation_valid", "valid", 2)],
)
def test_every_verdict_occurs(spark, name, column, least):
    assert QUERIES[name](spark, SMALL).select(F.col(column)).distinct().count() >= least
