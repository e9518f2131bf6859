"""Scalar functions against plain Python on awkward inputs."""

import hashlib
import re

from pyspark.sql import functions as F

from lexmill.functions import text as T

TEXTS = ["", " ", "a", "Home  Login", "Größe ß", "x\ty\r\nz\r", "# T\nbody", "Ａ，b ！", None, "é" * 50, "a b c d e f", "https://x.org/a) <http://y>"]


def values(spark, column, rows=TEXTS):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r[1] for r in df.select("i", column).orderBy("i").collect()]


def test_normalize_claim(spark):
    want = [None if x is None else " ".join(x.split()).casefold() for x in TEXTS]
    assert values(spark, T.normalize_claim("x")) == want


def test_tokens(spark):
    got = values(spark, F.sort_array(T.tokens("x")))
    assert got == [None if x is None else sorted(set(re.findall(r"[\w-]+", x.lower()))) for x in TEXTS]


def test_empty_shell(spark):
    got = values(spark, T.is_empty_shell("x", F.lit("ok")), ["", "home login", "home page", "...", "Menu SEARCH"])
    assert got == [True, True, False, False, True]
    assert values(spark, T.is_empty_shell("x", F.lit("Failed")), ["real text here"]) == [True]


def test_normalize_uri(spark):
    got = values(spark, T.normalize_uri("x"), ["HTTPS://Ex.COM", "http://a/B?q=1#f", " plain ", "doc://S/1"])
    assert got == ["https://ex.com/", "http://a/B?q=1", "plain", "doc://s/1"]


def test_source_id(spark):
    got = values(spark, T.source_id("x"), ["http://a/"])
    assert got == ["source-" + hashlib.sha256(b"http://a/").hexdigest()[:20]]


def test_gate_normal_form(spark):
    assert values(spark, T.normalize_for_gate("x"), ["a ， B  c … d", "3 times"]) == ["a,b c...d", "3 times"]


def test_word_grams_of_short_text(spark):
    assert values(spark, T.word_grams("x"), ["a b c d", "a b c d e", ""]) == [[], ["a b c d e"], []]


def test_gram_jaccard_of_nothing_is_one(spark):
    empty = F.array().cast("array<string>")
    assert values(spark, T.gram_jaccard(empty, empty), ["x"]) == [1.0]
    assert values(spark, T.jaccard(empty, empty), ["x"]) == [0.0]


def test_markers(spark):
    rows = ["# h", "FAQ: x", "E42 boom", "param a: b", "```py", "text"]
    assert values(spark, T.marker("x"), rows) == ["heading", "faq", "error_code", "parameter", "code", None]


def test_frontmatter_is_cut_once(spark):
    assert values(spark, T.strip_frontmatter("x"), ["---\na: b\n---\nbody\n---\nmore", "no --- here"]) == ["body\n---\nmore", "no --- here"]


def test_table_cells(spark):
    assert values(spark, T.table_cells("x"), ["| a | b |", "|---|:-:|", "plain"]) == [["a", "b"], [], None]


def test_lifecycle(spark):
    got = values(spark, T.lifecycle(F.lit("ok"), F.col("x"), "2024-05-01"), ["2024-05-01", "2024-05-02", "nonsense", None])
    assert got == ["stale", "current", "unknown", "current"]
    assert values(spark, T.lifecycle(F.lit(" deprecated "), F.col("x"), "2024-05-01"), ["2030-01-01"]) == ["deprecated"]


def test_safe_paths(spark):
    assert values(spark, T.is_safe_path("x"), ["a/b", "/a", "a/../b", "a//b"]) == [True, False, False, False]


def test_slug(spark):
    assert values(spark, T.slug("x"), ["A & B/c", "***", "x" * 90]) == ["a-and-b-c", "item", "x" * 80]
