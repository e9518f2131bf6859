"""Candidates, layers, reused sections, payloads, source entries and inventories on small cases."""

import pytest

from lexmill.functions import text as T
from lexmill.operators import candidates as C
from lexmill.operators import inventory as I

CLAIMS = "draft long, source_uri string, text string, fingerprint string, raw_id long, locator string"


def gate(spark, source, candidate=None, body="One.\nTwo.", invalid=None, covered=None, structure=()):
    candidate = source if candidate is None else candidate
    covered = [(c[4], c[5]) for c in candidate] if covered is None else covered
    return C.candidate_gate(
        spark.createDataFrame([(1, body, invalid)], "draft long, body string, invalid_reason string"), spark.createDataFrame(source, CLAIMS), spark.createDataFrame(candidate, CLAIMS),
        spark.createDataFrame([(1, r, x, "p") for r, x in covered], "draft long, raw_id long, locator string, page string"), spark.createDataFrame([(1, x) for x in structure], "draft long, line string"),
    ).first()


def test_candidate_gate(spark):
    from pyspark.sql import functions as F

    fp = lambda x: spark.range(1).select(T.claim_fingerprint(F.lit("u"), F.lit(x))).first()[0]
    one, two = (1, "u", "One.", fp("One."), 1, "lines:1-1"), (1, "u", "Two.", fp("Two."), 1, "lines:2-2")
    twice = (1, "u", "One.", fp("One."), 1, "lines:5-5")
    good = gate(spark, [one, two, twice])
    assert tuple(good) == (1, True, None, 1.0, 1.0, 0)
    reason = lambda *a, **k: gate(spark, *a, **k)["reason"]
    assert reason([one], invalid="x") == "marked_invalid"
    assert reason([one], [one[:1] + (None,) + one[2:]]) == "lineage_missing"
    assert reason([one], [one[:3] + ("f",) + one[4:]]) == "fingerprint_differs"
    assert reason([one], [one, two]) == "not_in_source"
    assert reason([one, two], [one, two[:5] + ("lines:9-9",)]) == "lineage_differs"
    dropped = gate(spark, [one, two, twice], [one, two])
    assert (dropped["reason"], dropped["n_missing"]) == ("claim_dropped", 1)
    half = gate(spark, [one, two], covered=[(1, "lines:1-1")])
    assert (half["reason"], half["coverage_ratio"]) == ("coverage_incomplete", 0.5)
    assert reason([one, two], body="One.") == "not_faithful"
    assert reason([one, two], structure=["# H"]) == "structure_dropped" and reason([one, two], body=" # H \nOne. Two.", structure=["# H"]) is None
    assert tuple(gate(spark, []))[1:5] == (True, None, 1.0, 1.0)


def test_layers(spark):
    pages = spark.createDataFrame([(1, "T", "p/a.md"), (2, " ", "x/../a.md"), (3, "T", "p/b.md")], "page_id long, title string, path string")
    sections = spark.createDataFrame([(1, "usage", "s1", ["a"], ["A."]), (1, "rules", "s2", ["b"], ["B."]), (2, "usage", "s", ["a", "q"], ["A."]), (2, "usage", "s", [], None), (2, "rules", None, ["a"], [" "])], "page_id long, layer string, section string, claim_ids array<string>, bullets array<string>")
    claims = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "z"), (2, None)], "page_id long, claim_id string")
    links = spark.createDataFrame([(1, "related", "../b.md"), (1, "source", "s/x.md"), (2, "related", "b.md"), (2, "related", "../raw/b.md"), (2, "source", "Audit.md"), (2, "source", "provider.md")], "page_id long, kind string, href string")
    got = sorted((r["page_id"], r["code"], r["detail"] or "") for r in C.two_layer_codes(pages, sections, claims, links).collect())
    assert got == [
        (2, "CATALOGUE_IDS", ""), (2, "CLAIM_OWNED_TWICE", "a"), (2, "CLAIM_UNKNOWN", "q"), (2, "CLAIM_UNOWNED", "z"), (2, "CONTENT_UNALIGNED", ""), (2, "CONTENT_UNALIGNED", "s"), (2, "IDENTITY_MISSING", ""), (2, "LINK_HIDDEN", "../raw/b.md"), (2, "LINK_HIDDEN", "Audit.md"),
        (2, "LINK_NOT_LOCAL", "b.md"), (2, "PATH_UNSTABLE", ""), (2, "SECTION_IDS", ""), (2, "SECTION_IDS", "s"), (2, "SECTION_WITHOUT_CLAIMS", "s"), (3, "LAYER_MISSING", ""),
    ]


def test_payload_marks_each_claim_once(spark):
    sections = spark.createDataFrame([(1, 0, "entry", "Fact [^a].", ["a", "b", "zz"], "candidate"), (1, 1, "exceptions", "", [], "source_not_documented")], "page_id long, place int, section string, body string, claim_ids array<string>, status string")
    claims = spark.createDataFrame([(1, 2, "a", "late", "u", "lines:9-9", "h", ""), (1, 0, "a", "Fact", "u", "lines:1-1", "h", ""), (1, 1, "b", "Other", "v", "lines:2-2", "h", "")], "page_id long, place int, claim_id string, text string, source_uri string, locator string, content_hash string, fingerprint string")
    fragments = spark.createDataFrame([(1, 1, "second"), (1, 0, "first"), (1, 2, None)], "page_id long, place int, text string")
    got = {r["page_id"]: r for r in C.gate_payloads(sections, claims, fragments, spark.createDataFrame([(1, "procedure_or_rule"), (2, "product_overview")], "page_id long, page_type string")).collect()}
    assert got[1]["body"] == "## entry\nFact [^a].\n[^b]\n## exceptions\n[^a]: u#lines:1-1\n[^b]: v#lines:2-2"
    assert (got[1]["evidence"], got[1]["typed_claim_ids"], [c["text"] for c in got[1]["claims"]]) == ("first\nsecond", ["a", "b"], ["Fact", "Other"])
    assert [(s["section"], s["page_type"], s["status"]) for s in got[1]["states"]] == [("entry", "procedure_or_rule", "candidate"), ("exceptions", "procedure_or_rule", "source_not_documented")]
    assert (got[2]["body"], got[2]["claims"], got[2]["typed_claim_ids"]) == ("", [], [])


def test_source_index_states(spark):
    snapshots = spark.createDataFrame([("u1", "h1", 1), ("u1", "h2", 2), ("u2", "h3", 1), ("u3", "h4", 1), ("u4", "h5", 1), (None, "h", 1)], "source_uri string, content_hash string, seq long")
    duplicates = spark.createDataFrame([("u2", "u9", 1), ("u2", "u1", 2), ("u3", "", 1)], "source_uri string, canonical_uri string, seq long")
    pages = spark.createDataFrame([("u1", "p2", None), ("u1", "p1", False), ("u3", "p3", True)], "source_uri string, target string, degraded boolean")
    history = spark.createDataFrame([("u1", "old", "removed", "ok", False), ("u4", "p4", "active", "Failed", None), ("u1", "p0", None, "Verified", None)], "source_uri string, target string, verification_status string, validation_status string, provider_failed boolean")
    got = sorted(map(tuple, C.source_index(snapshots, duplicates, pages, history).collect()))
    assert got == [("u1", "h2", "published", ["p0", "p1", "p2"]), ("u2", "h3", "duplicate", ["p0", "p1", "p2"]), ("u3", "h4", "needs-review", [])]


@pytest.mark.parametrize(
    "link, want",
    [
        ("[x](b.md)", ("a/b.md", "local")), ("[x](b)", ("a/b.md", "local")), ("[x](../c/d.txt#s)", ("c/d.txt", "local")), ("[x](b%20c.md)", ("a/b c.md", "local")), ("[x](a+b.md)", ("a/a+b.md", "local")),
        ("[x](../../d.md)", (None, "escapes")), ("[x](/etc/d.md)", (None, "escapes")), ("![x](b.md)", None), ("[x](https://h/)", None), ("[x](/wiki/d)", None), ("[x](#s)", None), ("[x](100%)", ("a/100%.md", "local")),
    ],
)
def test_links_of_a_source(spark, link, want):
    files = spark.createDataFrame([("a/p.md", f"one\nsee {link} there")], "path string, text string")
    got = [(r["line_number"], (r["target"], r["state"])) for r in I.source_links(files).collect()]
    assert got == ([] if want is None else [(2, want)])
