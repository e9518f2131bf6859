"""Contracts of drafted pages: typed sections, source blocks, the body gate and the candidates that pass all of them.

A contract is a table of rules. A rule is a code and an expression over the nested record that says, for each part of
it, whether the rule is broken and by what; no rule stops the others' rows. Answers stay JSON (variants) until a
rule asks for a field, so that an answer of any shape gives codes and no error. Nothing here shuffles but the joins by page.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators.gates import supported_by_body

# Fixed values of the contract: the sections of each page type, fields, limits, and kinds of text that may be copied.
REQUIRED_SECTIONS = {
    "product_overview": ("positioning", "use_cases", "capability_boundaries", "entry", "sources"),
    "module_or_capability": ("purpose", "capabilities", "entry_prerequisites", "relationships", "limitations", "version", "sources"),
    "procedure_or_rule": ("prerequisites", "steps_rules", "exceptions", "limitations", "version", "sources"),
}
OPTIONAL_SECTIONS = {"product_overview": ("version",)}
ANSWER_FIELDS = ("page_type", "sections", "publication", "summary")
SECTION_FIELDS = ("body", "claim_ids")
COPY_EXCEPTIONS = ("code", "table", "bilingual", "public_template", "template", "attribution_quote")
FORMAT_ONLY = r"^\s*\|(?:\s*:?-{3,}:?\s*\|)+\s*$"
RUN_SENTENCES, RUN_CHARS = 3, 240
DUPLICATE_CHARS, DUPLICATE_SCORE = 80, 0.92

STRINGS = "array<string>"
CODES = "array<struct<section:string,code:string,detail:string>>"


@dataclass(frozen=True)
class Rule:
    """``broken`` gives, for a record, whether the rule is broken; ``detail`` what by (null: nothing to add)."""

    code: str
    broken: Callable[[Column], Column]
    detail: Callable[[Column], Column] = lambda x: nothing()


def nothing() -> Column:
    return F.lit(None).cast("string")


def codes_of(rules: tuple[Rule, ...], record: Column, section: Column) -> Column:
    """The codes that a record breaks, in the order of the rules. An unknown verdict counts as not broken."""
    found = [F.when(r.broken(record), F.struct(section.alias("section"), F.lit(r.code).alias("code"), r.detail(record).alias("detail"))) for r in rules]
    return F.array_compact(F.array(*found)).cast(CODES)


def _names(values: Column) -> Column:
    return F.array_join(F.array_sort(values), ", ")


def _strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)).cast(STRINGS)


def section_lists(page_type: Column) -> tuple[Column, Column]:
    """Required and optional sections of a page type; null for an unknown one."""
    need, may = F.lit(None).cast(STRINGS), F.when(page_type.isin(*REQUIRED_SECTIONS), _strings())
    for name, sections in REQUIRED_SECTIONS.items():
        need = F.when(page_type == name, _strings(*sections)).otherwise(need)
    for name, sections in OPTIONAL_SECTIONS.items():
        may = F.when(page_type == name, _strings(*sections)).otherwise(may)
    return need, may


def _decoded(payload: Column) -> Column:
    """An answer without the fence that may stand around it, as a variant; null if it is no JSON."""
    bare = T.strip(payload)
    body = F.regexp_replace(bare, r"(?s)^```[^\n]*\n", "")
    return F.try_parse_json(F.when(bare.startswith("```"), F.regexp_replace(body, r"(?s)```\s*$", "")).otherwise(bare))



#: Rules of the answer as a whole. A section's own rules are asked only of answers without a code here.
ANSWER_RULES = (
    Rule("ANSWER_EMPTY", lambda x: x["blank"]),
    Rule("ANSWER_NOT_JSON", lambda x: ~x["blank"] & x["kind"].isNull()),
    Rule("ANSWER_NOT_OBJECT", lambda x: x["kind"].isNotNull() & x["fields"].isNull()),
    Rule("FIELD_UNKNOWN", lambda x: F.size(x["unknown_fields"]) > 0, lambda x: _names(x["unknown_fields"])),
    Rule("PAGE_TYPE_INVALID", lambda x: x["fields"].isNotNull() & ~(x["page_type"].eqNullSafe(x["due_type"]) & x["need"].isNotNull()), lambda x: x["page_type"]),
    Rule("SECTIONS_MISSING", lambda x: x["fields"].isNotNull() & x["present"].isNull()),
    Rule("SECTION_UNKNOWN", lambda x: F.size(x["unknown_sections"]) > 0, lambda x: _names(x["unknown_sections"])),
    Rule("PUBLICATION_NOT_OBJECT", lambda x: x["bad_publication"]),
    Rule("SUMMARY_NOT_OBJECT", lambda x: x["bad_summary"]),
    Rule("CLAIM_AMBIGUOUS", lambda x: F.size(x["repeated_claims"]) > 0, lambda x: _names(x["repeated_claims"])),
)

#: Rules of one section that must be there or is there.
SECTION_RULES = (
    Rule("SECTION_MISSING", lambda s: ~s["given"]),
    Rule("SECTION_KIND", lambda s: s["given"] & ~s["is_text"] & s["fields"].isNull(), lambda s: F.lower(F.regexp_extract(F.coalesce(s["kind"], F.lit("")), "^[A-Za-z]+", 0))),
    Rule("SECTION_FIELDS", lambda s: F.size(s["unknown_fields"]) > 0, lambda s: _names(s["unknown_fields"])),
    Rule("CLAIMS_INVALID", lambda s: s["fields"].isNotNull() & ~s["list_ok"]),
    Rule("CLAIM_UNKNOWN", lambda s: F.size(s["unknown_claims"]) > 0, lambda s: _names(s["unknown_claims"])),
    Rule("UNDOCUMENTED_NOT_EMPTY", lambda s: s["usable"] & s["undocumented"] & ((s["body"] != "") | (F.size(s["claims"]) > 0))),
    Rule("SECTION_EMPTY", lambda s: s["usable"] & ~s["undocumented"] & (s["body"] == "")),
    Rule("CLAIMS_MISSING", lambda s: s["usable"] & ~s["undocumented"] & (F.size(s["claims"]) == 0)),
)


def check_sections(drafts: DataFrame, answers: DataFrame) -> DataFrame:
    """page_id, status (``draft`` if no code, else ``degraded``), codes (section, code, detail), sections (section, body, claim_ids,
    status: ``candidate`` or ``source_not_documented``; none unless the page is a draft).

    ``drafts``: page_id, page_type, claims (array of claim_id, text, in the order in which they were numbered c001, c002, ... for
    the answer), undocumented (sections that the source says nothing about). ``answers``: page_id, payload (JSON text,
    in a fence or bare). Every section binds the claims that its numbers or ids stand for; lines that only format a table are
    bound by none. A draft without an answer has an empty one; null arrays are empty; claims of one id that a draft
    lists twice can be bound by nobody. Several answers of a page are checked each."""
    need, may = section_lists(F.col("page_type"))
    none = F.array().cast(STRINGS)
    claims = F.coalesce("claims", F.array().cast("array<struct<claim_id:string,text:string>>"))
    rows = drafts.join(answers, "page_id", "left").select(
        "page_id", F.col("page_type").alias("due_type"), claims.alias("claims"), F.coalesce("undocumented", none).alias("undocumented"),
        need.alias("need"), may.alias("may"), (T.strip(F.coalesce("payload", F.lit(""))) == "").alias("blank"), _decoded(F.col("payload")).alias("v"),
    )
    of = lambda path, kind: F.try_variant_get("v", path, kind)
    is_object = lambda path: of(path, "map<string,variant>").isNotNull()
    known = F.transform("claims", lambda c: c["claim_id"])
    refs = F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.size("claims")), lambda i: F.concat(F.lit("c"), F.lpad(i.cast("string"), 3, "0"))), known)
    rows = rows.select(
        "*", F.schema_of_variant("v").alias("kind"), F.map_keys(F.expr("try_cast(v AS map<string,variant>)")).alias("fields"), of("$.page_type", "string").alias("page_type"), of("$.sections", "map<string,variant>").alias("given"),
        known.alias("known"), F.when(F.size("claims") > 0, refs).alias("refs"), F.transform(F.filter("claims", lambda c: c["text"].rlike(FORMAT_ONLY)), lambda c: c["claim_id"]).alias("format_only"),
    )
    has = lambda name: F.array_contains("fields", name)
    listed = F.concat("need", "may")
    record = F.struct(
        "blank", "kind", "fields", "page_type", "due_type", "need", F.map_keys("given").alias("present"),
        F.array_except("fields", _strings(*ANSWER_FIELDS)).alias("unknown_fields"), F.array_except(F.map_keys("given"), listed).alias("unknown_sections"),
        (has("publication") & ~is_object("$.publication")).alias("bad_publication"), (has("summary") & ~is_object("$.summary")).alias("bad_summary"),
        F.array_distinct(F.filter("known", lambda c: F.size(F.filter("known", lambda d: d == c)) > 1)).alias("repeated_claims"),
    )
    rows = rows.withColumn("answer_codes", codes_of(ANSWER_RULES, record, nothing()))

    def section(name: Column) -> Column:
        v = F.col("given")[name]
        raw = lambda path, kind: F.try_variant_get(v, path, kind)
        ids, fields, kind = raw("$.claim_ids", STRINGS), F.map_keys(raw("$", "map<string,variant>")), F.schema_of_variant(v)
        listed_kind = F.schema_of_variant(raw("$.claim_ids", "variant"))
        empty_list = listed_kind.startswith("ARRAY<VOID") & (F.coalesce(F.size(ids), F.lit(0)) == 0)
        list_ok = ~F.array_contains(fields, "claim_ids") | empty_list | ((listed_kind == "ARRAY<STRING>") & ~F.exists(ids, lambda x: x.isNull() | (F.trim(x) == "")))
        is_text = F.coalesce(kind == "STRING", F.lit(False))
        body = T.strip(F.coalesce(F.when(is_text, raw("$", "string")).otherwise(raw("$.body", "string")), F.lit("")))
        first = F.struct(name.alias("name"), F.map_contains_key("given", name).alias("given"), kind.alias("kind"), is_text.alias("is_text"), fields.alias("fields"), F.coalesce(list_ok, F.lit(False)).alias("list_ok"), body.alias("body"), F.coalesce(ids, none).alias("ids"))

        def bound(s: Column) -> Column:
            asked = F.when(s["list_ok"] & ~s["is_text"], F.transform(F.filter(s["ids"], lambda x: x.isNotNull()), lambda x: F.coalesce(F.col("refs")[F.trim(x)], F.trim(x)))).otherwise(none)
            unknown = F.when(F.size("known") > 0, F.array_except(asked, F.col("known"))).otherwise(none)
            extra = F.coalesce(F.array_except(s["fields"], _strings(*SECTION_FIELDS)), none)
            usable = s["given"] & (s["is_text"] | (s["fields"].isNotNull() & s["list_ok"] & (F.size(extra) == 0))) & (F.size(unknown) == 0)
            return F.struct(
                s["name"].alias("name"), s["given"].alias("given"), s["kind"].alias("kind"), s["is_text"].alias("is_text"), s["fields"].alias("fields"), s["list_ok"].alias("list_ok"), s["body"].alias("body"),
                extra.alias("unknown_fields"), unknown.alias("unknown_claims"), usable.alias("usable"), F.array_except(asked, F.col("format_only")).alias("claims"), F.array_contains("undocumented", s["name"]).alias("undocumented"),
            )

        return T.let(first, bound)

    wanted = F.concat("need", F.filter("may", lambda x: F.map_contains_key("given", x)))
    rows = rows.withColumn("asked", F.when(F.size("answer_codes") == 0, F.transform(wanted, section)))
    section_codes = F.flatten(F.transform("asked", lambda s: codes_of(SECTION_RULES, s, s["name"])))
    rows = rows.withColumn("codes", F.when(F.size("answer_codes") > 0, F.col("answer_codes")).otherwise(section_codes))
    status = lambda s: F.when(s["undocumented"], "source_not_documented").otherwise("candidate")
    kept = F.transform("asked", lambda s: F.struct(s["name"].alias("section"), s["body"].alias("body"), F.when(s["undocumented"], none).otherwise(s["claims"]).alias("claim_ids"), status(s).alias("status")))
    ok = F.size("codes") == 0
    return rows.select("page_id", F.when(ok, "draft").otherwise("degraded").alias("status"), "codes", F.when(ok, kept).otherwise(F.array().cast("array<struct<section:string,body:string,claim_ids:array<string>,status:string>>")).alias("sections"))


def code_rows(checked: DataFrame) -> DataFrame:
    """page_id, section, code, detail of all codes."""
    return checked.select("page_id", F.explode("codes").alias("c")).select("page_id", "c.section", "c.code", "c.detail")


def bound_claims(checked: DataFrame) -> DataFrame:
    """page_id, section, claim_id: what the sections of drafts rest on, each claim of a section once."""
    return checked.select("page_id", F.explode("sections").alias("s")).select("page_id", "s.section", F.explode("s.claim_ids").alias("claim_id"))


# --- copied source text -----------------------------------------------------


def source_block(source, body, exempt: Column) -> Column:
    """Whether a run of the source's sentences stands verbatim in the body that is longer than three sentences or 240 characters
    and holds none of the ``exempt`` texts (array; null or blank ones count for nothing), all in gate form.

    What is exempt in a run is exempt in all longer ones, and a run of four sentences is too long by itself: runs of one to
    four sentences from each start decide."""

    def run(x: Column, n: int) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(x["parts"]) - n + 1), lambda i: T.normalize_for_gate(F.array_join(F.slice(x["parts"], i, F.lit(n)), " ")))
        free = lambda r: ~F.exists(x["exempt"], lambda e: F.contains(r, e))
        bad = F.exists(parts, lambda r: (r != "") & F.contains(x["body"], r) & (F.lit(n > RUN_SENTENCES) | (F.char_length(r) > RUN_CHARS)) & free(r))
        return F.when(F.size(x["parts"]) >= n, bad).otherwise(F.lit(False))

    def any_run(x: Column) -> Column:
        out = run(x, 1)
        for n in range(2, RUN_SENTENCES + 2):
            out = out | run(x, n)
        return out

    kept = F.filter(F.transform(F.coalesce(exempt, F.array().cast(STRINGS)), lambda e: T.normalize_for_gate(e)), lambda e: e != "")
    both = F.struct(F.coalesce(T.sentences(source), F.array().cast(STRINGS)).alias("parts"), F.coalesce(T.normalize_for_gate(body), F.lit("")).alias("body"), kept.alias("exempt"))
    return T.let(both, any_run)


def source_block_failures(sections: DataFrame, claims: DataFrame, fragments: DataFrame) -> DataFrame:
    """page_id, section: sections that copy too much of the claims that they cite.

    ``sections``: page_id, section, body, claim_ids. ``claims``: page_id, claim_id, raw_id, locator, text. ``fragments``: page_id, raw_id,
    locator, content_type, text. A section is compared with its own claims, in the order in which it cites them, so that
    sections don't add up to one run; a cited claim's fragment at the same place may be copied if its type is one of
    ``COPY_EXCEPTIONS``. Claims and fragments are joined by page and place; a section's own are gathered, which its
    list of claims bounds."""
    cited = sections.select("page_id", "section", F.posexplode("claim_ids").alias("at", "claim_id"))
    found = cited.join(claims.select("page_id", "claim_id", "raw_id", "locator", "text"), ["page_id", "claim_id"])
    free = fragments.where(F.lower("content_type").isin(*COPY_EXCEPTIONS)).groupBy("page_id", "raw_id", "locator").agg(F.collect_set("text").alias("exempt"))
    each = found.join(free, ["page_id", "raw_id", "locator"], "left")
    texts = F.transform(F.filter(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: T.strip(x["text"]) != ""), lambda x: x["text"])
    evidence = each.groupBy("page_id", "section").agg(F.array_join(texts, "\n").alias("evidence"), F.flatten(F.collect_list(F.coalesce("exempt", F.array().cast(STRINGS)))).alias("exempt"))
    return sections.join(evidence, ["page_id", "section"]).where(source_block(F.col("evidence"), F.col("body"), F.col("exempt"))).select("page_id", "section")


def claim_support_failures(sections: DataFrame, claims: DataFrame) -> DataFrame:
    """page_id, section, claim_id: cited claims that the page's whole body does not carry (``supported_by_body``).

    ``sections``: page_id, section, body, claim_ids; ``claims``: page_id, claim_id, text. A page's body is the bodies of its sections, by
    section, a line feed between. Claims that only format a table are left out, and so are cited ids of no claim, which the
    section contract names. A page's body is joined to its claims once and in one row, as pages are bounded."""
    texts = F.sort_array(F.collect_list(F.struct("section", F.coalesce("body", F.lit("")).alias("body"))))
    bodies = sections.groupBy("page_id").agg(F.array_join(F.transform(texts, lambda x: x["body"]), "\n").alias("whole"))
    cited = sections.select("page_id", "section", F.explode(F.array_distinct("claim_ids")).alias("claim_id"))
    own = claims.where(~F.col("text").rlike(FORMAT_ONLY)).join(bodies, "page_id")
    failed = own.where(~supported_by_body(F.col("text"), F.col("whole"))).select("page_id", "claim_id")
    return cited.join(failed, ["page_id", "claim_id"]).select("page_id", "section", "claim_id")


# --- the body gate ----------------------------------------------------------


def _claim_rules(body: Column, typed: Column) -> tuple[Rule, ...]:
    whole = lambda c: (F.coalesce(c["text"], F.lit("")) != "") & (F.coalesce(c["source_uri"], F.lit("")) != "") & (F.coalesce(c["locator"], F.lit("")) != "") & F.coalesce(c["content_hash"].rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
    literal = lambda c: F.contains(T.normalize_for_gate(body), T.normalize_for_gate(c["text"]))
    held = lambda c: F.when(typed, supported_by_body(c["text"], body)).otherwise(literal(c))
    due = lambda c: T.claim_fingerprint(c["source_uri"], c["text"])
    name = lambda c: c["claim_id"]
    return (
        Rule("FINGERPRINT", lambda c: (c["source_uri"] != "") & (c["text"] != "") & (c["fingerprint"] != "") & (c["fingerprint"] != due(c)), name),
        Rule("ATTRIBUTION_INCOMPLETE", lambda c: ~whole(c), name),
        Rule("NOT_FAITHFUL", lambda c: whole(c) & ~held(c), name),
        Rule("FOOTNOTE_MISSING", lambda c: whole(c) & ~F.contains(body, F.concat(F.lit("[^"), c["claim_id"], F.lit("]"))), name),
    )


#: Fields of a section state that rests on an audit of the source.
STATE = "array<struct<section:string,page_type:string,status:string,body:string,claim_ids:array<string>,audited:boolean,bound:boolean,question_status:string>>"
CLAIM = "array<struct<claim_id:string,text:string,source_uri:string,locator:string,content_hash:string,fingerprint:string>>"
STATE_RULES = (
    Rule("STATE_SECTION", lambda s: s["section"] != "exceptions"),
    Rule("STATE_PAGE_TYPE", lambda s: s["page_type"] != "procedure_or_rule"),
    Rule("STATE_NOT_EMPTY", lambda s: (T.strip(F.coalesce(s["body"], F.lit(""))) != "") | (F.size(s["claim_ids"]) > 0)),
    Rule("STATE_NOT_AUDITED", lambda s: ~F.coalesce(s["audited"], F.lit(False))),
    Rule("STATE_NOT_BOUND", lambda s: F.coalesce(s["audited"], F.lit(False)) & ~F.coalesce(s["bound"], F.lit(False))),
    Rule("STATE_QUESTION", lambda s: F.coalesce(s["audited"] & s["bound"], F.lit(False)) & ~s["question_status"].eqNullSafe(F.lit("not_answerable"))),
)


def body_gate(pages: DataFrame) -> DataFrame:
    """page_id, status (``published`` or ``degraded``), codes (section, code, detail) for each page.

    ``pages``: page_id, body, evidence, provider_status (null: ok), claims (CLAIM), typed_claim_ids (null: the answer was not
    typed), states (STATE), others (texts of the same and of other pages; null: not compared), exempt (texts that may be
    copied). Repeated claims of one id are checked once. All lists belong to one page."""
    body, evidence = (F.coalesce(F.col(c), F.lit("")) for c in ("body", "evidence"))
    rows = pages.select(
        "page_id", body.alias("body"), evidence.alias("evidence"), F.coalesce("provider_status", F.lit("ok")).alias("provider"), "typed_claim_ids", "others", F.coalesce("exempt", F.array().cast(STRINGS)).alias("exempt"),
        F.coalesce("claims", F.array().cast(CLAIM)).cast(CLAIM).alias("claims"), F.coalesce("states", F.array().cast(STATE)).cast(STATE).alias("states"),
    )
    b, ids = F.col("body"), F.transform("claims", lambda c: c["claim_id"])
    repeated = F.array_distinct(F.filter(ids, lambda c: F.size(F.filter(ids, lambda d: d == c)) > 1))
    once = F.filter("claims", lambda c, i: F.array_position(ids, c["claim_id"]) == i + 1)
    typed = F.col("typed_claim_ids")
    blank_id = F.exists(typed, lambda x: x.isNull() | (F.trim(x) == ""))
    trimmed = F.transform(typed, lambda x: F.trim(x))
    grams = lambda x: T.word_grams(T.normalize_for_gate(x))
    near = F.size(F.filter("others", lambda o: T.gram_jaccard(grams(b), grams(o)) >= DUPLICATE_SCORE))
    parts = F.filter(F.transform(F.split(b, r"(?<=[.!?])\s+"), lambda s: T.normalize_for_gate(s)), lambda s: s != "")
    page = F.struct("provider", "body", "evidence")
    own = (
        Rule("PROVIDER_FAILED", lambda x: x["provider"] != "ok", lambda x: x["provider"]),
        Rule("BODY_EMPTY", lambda x: T.strip(x["body"]) == ""),
        Rule("EVIDENCE_DUMP", lambda x: (T.strip(x["evidence"]) != "") & (T.normalize_for_gate(x["body"]) == T.normalize_for_gate(x["evidence"]))),
        Rule("CLAIM_IDS_INVALID", lambda x: blank_id),
        Rule("CLAIM_IDS_INCOMPLETE", lambda x: ~blank_id & ((F.size(F.array_except(trimmed, ids)) > 0) | (F.size(F.array_except(ids, trimmed)) > 0))),
        Rule("CLAIMS_MISSING", lambda x: F.size("claims") == 0),
        Rule("CLAIM_REPEATED", lambda x: F.size(repeated) > 0, lambda x: _names(repeated)),
        Rule("NEAR_DUPLICATE", lambda x: (F.char_length(x["body"]) > DUPLICATE_CHARS) & (near > 0), lambda x: near.cast("string")),
        Rule("SENTENCE_REPEATED", lambda x: F.col("others").isNotNull() & (F.size(F.array_distinct(parts)) < F.size(parts))),
        Rule("SOURCE_BLOCK", lambda x: source_block(x["evidence"], x["body"], F.col("exempt"))),
    )
    undocumented = F.filter("states", lambda s: s["status"] == "source_not_documented")
    of_states = F.flatten(F.transform(undocumented, lambda s: codes_of(STATE_RULES, s, s["section"])))
    of_claims = F.flatten(F.transform(once, lambda c: codes_of(_claim_rules(b, typed.isNotNull()), c, nothing())))
    codes = F.concat(codes_of(own, page, nothing()), of_states, of_claims)
    return rows.select("page_id", codes.alias("codes")).select("page_id", F.when(F.size("codes") == 0, "published").otherwise("degraded").alias("status"), "codes")


# --- candidates -------------------------------------------------------------


def compile_candidates(drafts: DataFrame, checked: DataFrame, gated: DataFrame, old: DataFrame) -> DataFrame:
    """page_id, status, stage, reader_body, reader_path, kept_old, codes: every draft, published or degraded, in one pass.

    ``drafts``: page_id, draft_status, frozen_required, frozen_available, frozen_expected, frozen_actual, body, target_path. ``checked``: of
    ``check_sections``; ``gated``: of ``body_gate``; ``old``: page_id, body, path of the pages that readers see now. ``stage`` is the
    first one that rejects (``frozen``, ``draft``, ``sections``, ``gate``; null: none), and codes are its codes. A published
    page shows its body; a degraded one leaves the old page as it is, or shows nothing where there is none."""
    one = lambda df, name: df.groupBy("page_id").agg(F.min("status").alias(f"{name}_status"), F.flatten(F.collect_list("codes")).alias(f"{name}_codes"))
    rows = drafts.join(one(checked, "section"), "page_id", "left").join(one(gated, "gate"), "page_id", "left").join(old.select("page_id", F.col("body").alias("old_body"), F.col("path").alias("old_path")), "page_id", "left")
    missing = F.coalesce("frozen_required", F.lit(False)) & ~F.coalesce("frozen_available", F.lit(False))
    changed = F.coalesce(F.col("frozen_expected") != F.col("frozen_actual"), F.lit(False))
    unready = ~F.col("draft_status").eqNullSafe(F.lit("draft"))
    broken = F.coalesce(F.col("section_status") != "draft", F.lit(True))
    code = lambda name, detail=None: F.array(F.struct(nothing().alias("section"), F.lit(name).alias("code"), (nothing() if detail is None else detail).alias("detail"))).cast(CODES)
    steps = [
        (missing, "frozen", code("FROZEN_MISSING")),
        (changed, "frozen", code("FROZEN_CHANGED")),
        (unready, "draft", code("DRAFT_NOT_READY", F.col("draft_status"))),
        (broken, "sections", F.coalesce("section_codes", code("ANSWER_MISSING"))),
        (F.col("gate_status").isNull(), "gate", code("GATE_MISSING")),
        (F.col("gate_status") != "published", "gate", F.col("gate_codes")),
    ]
    stage, codes = F.lit(None).cast("string"), F.array().cast(CODES)
    for fails, name, found in reversed(steps):
        stage, codes = F.when(fails, name).otherwise(stage), F.when(fails, found).otherwise(codes)
    rows = rows.withColumn("stage", stage).withColumn("codes", codes)
    good = F.col("stage").isNull()
    return rows.select(
        "page_id", F.when(good, "published").otherwise("degraded").alias("status"), "stage", F.when(good, F.col("body")).otherwise(F.coalesce("old_body", F.lit(""))).alias("reader_body"),
        F.when(good, F.col("target_path")).otherwise(F.col("old_path")).alias("reader_path"), (~good & F.col("old_path").isNotNull()).alias("kept_old"), "codes",
    )
