import hashlib
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import pii as P
from tests.llm.brute import base_pii

SMALL = "/root/testdata/sf0.001"
ALPHABETS = ("a@.", "1.2 +-()", "@ab.c-+_1 é", "0123456789 -.+", "4 -", "+1 ().-x\n")


@settings(max_examples=800, deadline=None)
@given(st.sampled_from(ALPHABETS).flatmap(lambda a: st.text(a, max_size=60)))
def test_base_spans_equal_the_expressions(text):
    assert [s for s in P.find(text) if s[2] in P.BASE_KINDS] == base_pii(text, P.luhn)


def test_whole_table_equals_the_expressions(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in P.op5_pii(spark, SMALL).collect():
        base = base_pii(docs[r["doc_id"]], P.luhn)
        line = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in P.BASE_KINDS] == [sum(s[2] == k for s in base) for k in P.BASE_KINDS]
        assert set(line.split(",")) <= set(r["spans"].split(",")) or not line


def test_added_kinds():
    text = 'x https://bob:pw1@h.org/ IBAN DE89 3704 0044 0532 0130 00 token = "f3ef4d6b2755a36d" passport no: AB1234567 token of love'
    found = [(k, text[a:b]) for a, b, k in P.find(text)]
    assert ("login", "bob:pw1") in found and ("iban", "DE89 3704 0044 0532 0130 00") in found and ("secret", "f3ef4d6b2755a36d") in found
    assert not any("love" in x for _, x in found)


def test_numbers_that_run_into_others():
    text = "a 7536784127813050 4111111111111111 b +1 (826) 555-4081 190.97.51.17 c +44 20 7946 0958 1234567"
    found = [(k, text[a:b]) for a, b, k in P.find(text)]
    assert found == [("pan", "7536784127813050"), ("pan", "4111111111111111"), ("tel", "+1 (826) 555-4081"), ("ip", "190.97.51.17"), ("tel", "+44 20 7946 0958")]


def test_mask_joins_overlaps():
    text = "mail a@b.co or +1 (650) 555-1234."
    assert P.mask(text, P.find(text)) == "mail <EMAIL> or <PHONE>."
    assert P.mask(None, []) is None and P.mask("", []) == ""
    assert P.mask("abcdef", [(0, 4, "ip"), (2, 5, "card")]) == "<IP>f"


def test_odd_rows(spark):
    long = "9" * 200_000 + " " + "1." * 100_000 + "@" * 1000 + " a@b.cd"
    rows = [(1, None), (2, ""), (2, ""), (None, "a@b.cd"), (3, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS pii", "1 AS spans")
    got = {(r["doc_id"], r["n_email"]) for r in P.pii_report(df).collect()}
    assert got == {(1, 0), (2, 0), (None, 1), (3, 1)} and P.pii_report(df).count() == 5
    assert P.pii_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


CUES = [c + mark for c in P.SECRET_CUES + P.ACCOUNT_CUES for mark in ("=", "/", ".", "=x1=")]


@pytest.mark.parametrize("unit", [*CUES, "GB82 ", "1.", "1 ", "+1", "a@", "a@b.", "://a:b@", "token=" + "." * 50])
def test_time_is_in_proportion_to_length(unit):
    P.find(unit)

    def took(n):
        began = time.process_time()
        P.find(unit * (n // len(unit)))
        return time.process_time() - began

    assert took(1_000_000) < 5


def test_values_in_one_run_end_where_the_run_ends():
    text = "token=ab1token=cd secret=efghijkl token/x"
    assert [(k, text[a:b]) for a, b, k in P.find(text)] == [("secret", "ab1token=cd")]


def test_iban_by_modulus():
    def slow(text):
        moved = text[4:] + text[:4]
        return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1

    for k in range(100):
        text = f"DE{k:02d}370400440532013000"
        assert [s[2] for s in P.find(text) if s[2] == "iban"] == ["iban"] * slow(text)


def test_redact_keeps_the_other_columns(spark):
    df = spark.createDataFrame([(1, "to a@b.cd", "x"), (2, None, "y")], "doc_id long, text string, lang string")
    assert sorted(tuple(r) for r in P.redact(df).collect()) == [(1, "to <EMAIL>", "x"), (2, None, "y")]
