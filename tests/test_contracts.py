"""Contracts of drafted pages: every code once, and what passes."""

import json

import pytest
from pyspark.sql import functions as F

from lexmill.operators import contracts as K
from lexmill.plans import drafts as P
from lexmill.plans.base import Tables

DRAFT = "page_id long, page_type string, claims array<struct<claim_id:string,text:string>>, undocumented array<string>"
NEED = K.REQUIRED_SECTIONS["product_overview"]


def answer(**changed):
    sections = {s: {"body": f"On {s}.", "claim_ids": ["c001"]} for s in NEED}
    whole = {"page_type": "product_overview", "sections": sections}
    for k, v in changed.items():
        if k in NEED or k == "version":
            sections[k] = v
        else:
            whole[k] = v
    return json.dumps(whole)


def check(spark, payload, claims=(("a", "Fact."), ("b", "|---|:---:|")), page_type="product_overview", undocumented=()):
    drafts = spark.createDataFrame([(1, page_type, [tuple(c) for c in claims], list(undocumented))], DRAFT)
    answers = spark.createDataFrame([(1, payload)], "page_id long, payload string")
    return K.check_sections(drafts, answers)


def codes(checked):
    return sorted((r["section"] or "", r["code"], r["detail"]) for r in K.code_rows(checked).collect())


@pytest.mark.parametrize(
    "payload, want",
    [
        (None, [("", "ANSWER_EMPTY", None)]),
        (" \n", [("", "ANSWER_EMPTY", None)]),
        ("{bad", [("", "ANSWER_NOT_JSON", None)]),
        ("[1]", [("", "ANSWER_NOT_OBJECT", None)]),
        ('"text"', [("", "ANSWER_NOT_OBJECT", None)]),
        (answer(tone=1, zeal=2), [("", "FIELD_UNKNOWN", "tone, zeal")]),
        (answer(page_type="procedure_or_rule"), [("", "PAGE_TYPE_INVALID", "procedure_or_rule")]),
        (answer(sections=[1]), [("", "SECTIONS_MISSING", None)]),
        (answer(publication=[], summary="x"), [("", "PUBLICATION_NOT_OBJECT", None), ("", "SUMMARY_NOT_OBJECT", None)]),
        (answer(entry=7), [("entry", "SECTION_KIND", "bigint")]),
        (answer(entry="only text"), [("entry", "CLAIMS_MISSING", None)]),
        (answer(entry={"body": "x", "claim_ids": ["c001"], "source": "s"}), [("entry", "SECTION_FIELDS", "source")]),
        (answer(entry={"body": "x", "claim_ids": "c001"}), [("entry", "CLAIMS_INVALID", None)]),
        (answer(entry={"body": "x", "claim_ids": ["c001", " "]}), [("entry", "CLAIMS_INVALID", None)]),
        (answer(entry={"body": "x", "claim_ids": ["c001", 3]}), [("entry", "CLAIMS_INVALID", None)]),
        (answer(entry={"body": "x", "claim_ids": None}), [("entry", "CLAIMS_INVALID", None)]),
        (answer(entry={"body": "x", "claim_ids": ["zz", "c009"]}), [("entry", "CLAIM_UNKNOWN", "c009, zz")]),
        (answer(entry={"body": " ", "claim_ids": ["c001"]}), [("entry", "SECTION_EMPTY", None)]),
        (answer(entry={"body": "x", "claim_ids": []}), [("entry", "CLAIMS_MISSING", None)]),
        (answer(entry={"body": "x"}), [("entry", "CLAIMS_MISSING", None)]),
        (answer(entry={"body": "x", "claim_ids": ["c002"]}), [("entry", "CLAIMS_MISSING", None)]),
        (answer(version={"body": "", "claim_ids": ["c001"]}), [("version", "SECTION_EMPTY", None)]),
        (answer(), []),
        (answer(version={"body": "1.2", "claim_ids": ["b", " a "]}, publication={}, summary={"x": 1}), []),
        ("```json\n" + answer() + "\n```", []),
    ],
)
def test_each_code(spark, payload, want):
    assert codes(check(spark, payload)) == want


def test_missing_and_unknown_sections(spark):
    sections = {s: {"body": "x", "claim_ids": ["a"]} for s in NEED[1:]} | {"surplus": {}}
    payload = json.dumps({"page_type": "product_overview", "sections": sections})
    assert codes(check(spark, payload)) == [("", "SECTION_UNKNOWN", "surplus")]
    del sections["surplus"]
    assert codes(check(spark, json.dumps({"page_type": "product_overview", "sections": sections}))) == [(NEED[0], "SECTION_MISSING", None)]


def test_claims_are_bound_once(spark):
    twice = check(spark, answer(), claims=(("a", "Fact."), ("a", "Other.")))
    assert codes(twice) == [("", "CLAIM_AMBIGUOUS", "a")]
    good = check(spark, answer(entry={"body": "x", "claim_ids": ["c001", "a", "c002"]}))
    assert [(r["section"], r["claim_id"]) for r in K.bound_claims(good).orderBy("section").collect()] == sorted((s, "a") for s in NEED)


def test_undocumented_sections_stay_empty(spark):
    need = K.REQUIRED_SECTIONS["procedure_or_rule"]
    for exceptions, want in (({"body": "", "claim_ids": []}, []), ({"body": "x", "claim_ids": []}, [("exceptions", "UNDOCUMENTED_NOT_EMPTY", None)]), ("", [])):
        sections = {s: {"body": "x", "claim_ids": ["a"]} for s in need} | {"exceptions": exceptions}
        out = check(spark, json.dumps({"page_type": "procedure_or_rule", "sections": sections}), page_type="procedure_or_rule", undocumented=["exceptions"])
        assert codes(out) == want
        if not want:
            assert {s["section"]: s["status"] for s in out.first()["sections"]}["exceptions"] == "source_not_documented"


def test_no_claims_no_drafts_and_unknown_types(spark):
    assert codes(check(spark, answer(), claims=())) == []
    assert codes(check(spark, answer(page_type="other"), page_type="other"))[0][1] == "PAGE_TYPE_INVALID"
    empty = spark.createDataFrame([], DRAFT)
    assert K.check_sections(empty, spark.createDataFrame([], "page_id long, payload string")).count() == 0
    nulls = spark.createDataFrame([(1, None, None, None)], DRAFT)
    assert [c[1] for c in codes(K.check_sections(nulls, spark.createDataFrame([(1, answer())], "page_id long, payload string")))] == ["PAGE_TYPE_INVALID"]


def test_every_code_occurs_over_the_tables(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    found = {r["code"] for r in K.code_rows(P.checked(t)).select("code").distinct().collect()}
    assert found >= {r.code for r in K.ANSWER_RULES + K.SECTION_RULES} - {"CLAIM_AMBIGUOUS"}


FOUR = "One is here. Two is here. Three is here. Four is here."


@pytest.mark.parametrize(
    "source, body, exempt, want",
    [
        (FOUR, f"Before. {FOUR} After.", [], True),
        ("One is here. Two is here. Three is here.", "One is here. Two is here. Three is here.", [], False),
        (FOUR, FOUR, ["Two is here."], False),
        (FOUR + " Five is here.", FOUR + " Five is here.", ["One is here."], True),
        (FOUR + " Five is here.", FOUR + " Five is here.", ["Three is here."], False),
        ("x" * 241, "y " + "x" * 241, [], True),
        ("x" * 240, "y " + "x" * 240, [], False),
        ("x" * 241, "x" * 241, ["xx"], False),
        (FOUR, FOUR.upper().replace(".", "。"), [], True),
        (FOUR, "One is here. Two is here. Four is here. Three is here.", [], False),
        (FOUR, None, [], False),
        (None, FOUR, None, False),
        (FOUR, FOUR, [None, " "], True),
    ],
)
def test_source_blocks(spark, source, body, exempt, want):
    df = spark.createDataFrame([(source, body, exempt)], "s string, b string, e array<string>")
    assert df.select(K.source_block(F.col("s"), F.col("b"), F.col("e"))).first()[0] is want


def test_sections_do_not_add_up(spark):
    sections = spark.createDataFrame([(1, "x", FOUR, ["a", "b"]), (1, "y", FOUR, ["a"]), (1, "z", FOUR, ["d"]), (2, "x", FOUR, ["a", "b"]), (3, "x", FOUR, [])], "page_id long, section string, body string, claim_ids array<string>")
    claims = spark.createDataFrame([(p, c, f"r{c}", "lines:1-2", x) for p in (1, 2) for c, x in (("a", "One is here. Two is here."), ("b", "Three is here. Four is here."), ("d", FOUR))], "page_id long, claim_id string, raw_id string, locator string, text string")
    fragments = spark.createDataFrame([(2, "rb", "lines:1-2", "TABLE", "Three is here."), (1, "rb", "lines:9-9", "code", "Three is here."), (1, "rd", "lines:1-2", "paragraph", "Two is here.")], "page_id long, raw_id string, locator string, content_type string, text string")
    assert sorted(map(tuple, K.source_block_failures(sections, claims, fragments).collect())) == [(1, "x"), (1, "z")]


PAGE = f"page_id long, body string, evidence string, provider_status string, claims {K.CLAIM}, typed_claim_ids array<string>, states {K.STATE}, others array<string>, exempt array<string>"


def gate(spark, body, claims, evidence="", provider=None, typed=None, states=None, others=None):
    out = K.body_gate(spark.createDataFrame([(1, body, evidence, provider, claims, typed, states, others, None)], PAGE)).first()
    return out["status"], [(c["code"], c["detail"]) for c in out["codes"]]


def test_body_gate(spark):
    h = "ab" * 32
    good = ("k1", "Fact one.", "doc://x", "lines:1-1", h, "")
    assert gate(spark, "Fact one. [^k1]", [good]) == ("published", [])
    assert gate(spark, " ", None, provider="timeout") == ("degraded", [("PROVIDER_FAILED", "timeout"), ("BODY_EMPTY", None), ("CLAIMS_MISSING", None)])
    assert gate(spark, "Fact one. [^k1]", [good], evidence="fact  one. [^k1]")[1] == [("EVIDENCE_DUMP", None)]
    assert gate(spark, "Fact one. [^k1]", [good, good])[1] == [("CLAIM_REPEATED", "k1")]
    assert gate(spark, "Other. [^k2]", [good])[1] == [("NOT_FAITHFUL", "k1"), ("FOOTNOTE_MISSING", "k1")]
    assert gate(spark, "Fact one. [^k1]", [good[:3] + ("", "zz", "f" * 64)])[1] == [("FINGERPRINT", "k1"), ("ATTRIBUTION_INCOMPLETE", "k1")]
    assert gate(spark, "Fact one. [^k1]", [good], typed=["k1", ""])[1] == [("CLAIM_IDS_INVALID", None)]
    assert gate(spark, "Fact one. [^k1]", [good], typed=["k2"])[1] == [("CLAIM_IDS_INCOMPLETE", None)]
    assert gate(spark, "It costs 5 and fact is one. [^k1]", [("k1", "one fact costs 5", "doc://x", "lines:1-1", h, "")], typed=["k1"])[1] == []
    long = "Fact one. " + " ".join(f"w{i}" for i in range(40)) + ". [^k1]"
    assert gate(spark, long, [good], others=[long, "x"])[1] == [("NEAR_DUPLICATE", "1")]
    assert gate(spark, "Fact one. Fact one. [^k1]", [good], others=[])[1] == [("SENTENCE_REPEATED", None)]
    assert gate(spark, f"Fact one. [^k1] {FOUR}", [good], evidence=FOUR)[1] == [("SOURCE_BLOCK", None)]
    state = ("purpose", "product_overview", "source_not_documented", "x", ["k1"], True, True, None)
    assert [c for c, _ in gate(spark, "Fact one. [^k1]", [good], states=[state, state[:2] + ("candidate",) + state[3:]])[1]] == ["STATE_SECTION", "STATE_PAGE_TYPE", "STATE_NOT_EMPTY", "STATE_QUESTION"]


def test_candidates_keep_the_old_page(spark):
    drafts = spark.createDataFrame([(i, "draft", None, None, None, None, f"b{i}", f"p{i}") for i in range(5)] + [(5, "draft", True, False, "a", "a", "b", "p"), (6, "draft", None, None, "a", "b", "b", "p"), (7, None, None, None, None, None, "b", "p")], "page_id long, draft_status string, frozen_required boolean, frozen_available boolean, frozen_expected string, frozen_actual string, body string, target_path string")
    code = [(None, "X", None)]
    checked = spark.createDataFrame([(i, "degraded" if i == 1 else "draft", code if i == 1 else []) for i in (0, 1, 2, 3, 5, 6, 7)], f"page_id long, status string, codes {K.CODES}")
    gated = spark.createDataFrame([(0, "published", []), (1, "published", []), (2, "degraded", code), (5, "published", []), (6, "published", []), (7, "published", [])], f"page_id long, status string, codes {K.CODES}")
    old = spark.createDataFrame([(i, "old", f"o{i}") for i in (0, 2, 5)], "page_id long, body string, path string")
    got = {r["page_id"]: (r["status"], r["stage"], r["reader_body"], r["reader_path"], r["kept_old"], [c["code"] for c in r["codes"]]) for r in K.compile_candidates(drafts, checked, gated, old).collect()}
    assert got == {
        0: ("published", None, "b0", "p0", False, []), 1: ("degraded", "sections", "", None, False, ["X"]), 2: ("degraded", "gate", "old", "o2", True, ["X"]), 3: ("degraded", "gate", "", None, False, ["GATE_MISSING"]),
        4: ("degraded", "sections", "", None, False, ["ANSWER_MISSING"]), 5: ("degraded", "frozen", "old", "o5", True, ["FROZEN_MISSING"]), 6: ("degraded", "frozen", "", None, False, ["FROZEN_CHANGED"]), 7: ("degraded", "draft", "", None, False, ["DRAFT_NOT_READY"]),
    }
