"""Drafted pages under their contracts: conversations as pages, turns as their claims, answers with every kind of fault."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import contracts as K
from lexmill.plans.base import Tables, query
from lexmill.plans.bodies import grams_sql, support_sql
from lexmill.plans.scalars import GATE

TYPES = tuple(K.REQUIRED_SECTIONS)


def _list_sql(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: One draft for each conversation, and its answer with the fault that its number stands for.
NEED_SQL = "CASE conv_id % 3 " + " ".join(f"WHEN {i} THEN {_list_sql(K.REQUIRED_SECTIONS[t])}" for i, t in enumerate(TYPES)) + " END"
DRAFT_SQL = f"""c AS (SELECT conv_id, conv_id % 17 AS k, count(*) AS n, list('k' || conv_id || '-' || turn ORDER BY turn) AS claims, list(turn % 5 = 4 ORDER BY turn) AS format_only, {_list_sql(TYPES)}[conv_id % 3 + 1] AS page_type, {NEED_SQL} AS need, conv_id % 6 = 2 AS undocumented FROM conversations GROUP BY conv_id),
x AS (SELECT *, list_transform(need, lambda s, i: '"' || s || '":' || CASE WHEN i = 1 AND k = 9 THEN '7' WHEN i = 1 AND k = 15 THEN '"only text"'
  WHEN s = 'exceptions' AND undocumented AND k <> 16 THEN '{{"body":"","claim_ids":[]}}'
  ELSE '{{"body":"' || CASE WHEN i = 1 AND k = 13 THEN '  ' ELSE 'On ' || s || ' of ' || conv_id END || '","claim_ids":' || CASE WHEN i = 1 AND k = 11 THEN '"c001"' WHEN i = 1 AND k = 12 THEN '["zz"]' WHEN i = 1 AND k = 14 THEN '[]' ELSE '["c' || lpad(((i - 1) % n + 1)::VARCHAR, 3, '0') || '"]' END || CASE WHEN i = 1 AND k = 10 THEN ',"source":"x"' ELSE '' END || '}}' END) AS parts FROM c),
a AS (SELECT *, CASE k WHEN 1 THEN NULL WHEN 2 THEN '{{bad' WHEN 3 THEN '[1]' ELSE CASE WHEN k = 0 THEN '```json' || chr(10) ELSE '' END || '{{"page_type":"' || CASE WHEN k = 5 THEN 'other' ELSE page_type END || '"' || CASE WHEN k = 4 THEN ',"tone":1' WHEN k = 7 THEN ',"publication":[]' WHEN k = 6 THEN ',"summary":"x"' ELSE '' END || ',"sections":' ||
  CASE WHEN k = 6 THEN '[1]' ELSE '{{' || array_to_string(CASE WHEN k = 8 THEN parts[2:] WHEN k = 7 THEN list_append(parts, '"surplus":{{}}') ELSE parts END, ',') || '}}' END || '}}' || CASE WHEN k = 0 THEN chr(10) || '```' ELSE '' END END AS payload FROM x)"""


def drafts(t: Tables):
    """page_id, page_type, claims, undocumented, k (the fault of its answer)."""
    text = F.when(F.col("turn") % 5 == 4, "|---|---|").otherwise(F.col("text"))
    claim = F.struct(F.concat(F.lit("k"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("claim_id"), text.alias("text"))
    rows = t.conversations.groupBy(F.col("conv_id").alias("page_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", claim.alias("c")))), lambda x: x["c"]).alias("claims"))
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("page_id") % 3 + 1).cast("int"))
    undocumented = F.when(F.col("page_id") % 6 == 2, F.array(F.lit("exceptions"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("page_type", kind).withColumn("undocumented", undocumented).withColumn("k", F.col("page_id") % 17)


def answers(pages):
    """page_id, payload: JSON text; no row where nothing was answered."""
    k, lit = F.col("k"), F.lit
    need, _ = K.section_lists(F.col("page_type"))

    def part(s, i):
        first = i == 0
        ref = F.concat(lit('["c'), F.lpad((i % F.size("claims") + 1).cast("string"), 3, "0"), lit('"]'))
        ids = F.when(first & (k == 11), '"c001"').when(first & (k == 12), '["zz"]').when(first & (k == 14), "[]").otherwise(ref)
        body = F.when(first & (k == 13), "  ").otherwise(F.concat(lit("On "), s, lit(" of "), F.col("page_id").cast("string")))
        whole = F.concat(lit('{"body":"'), body, lit('","claim_ids":'), ids, F.when(first & (k == 10), ',"source":"x"').otherwise(""), lit("}"))
        silent = (s == "exceptions") & (F.size("undocumented") > 0) & (k != 16)
        return F.concat(lit('"'), s, lit('":'), F.when(first & (k == 9), "7").when(first & (k == 15), '"only text"').when(silent, '{"body":"","claim_ids":[]}').otherwise(whole))

    parts = F.transform(need, part)
    given = F.when(k == 8, F.slice(parts, 2, 100)).when(k == 7, F.concat(parts, F.array(lit('"surplus":{}')))).otherwise(parts)
    sections = F.when(k == 6, "[1]").otherwise(F.concat(lit("{"), F.array_join(given, ","), lit("}")))
    more = F.when(k == 4, ',"tone":1').when(k == 7, ',"publication":[]').when(k == 6, ',"summary":"x"').otherwise("")
    whole = F.concat(lit('{"page_type":"'), F.when(k == 5, "other").otherwise(F.col("page_type")), lit('"'), more, lit(',"sections":'), sections, lit("}"))
    payload = F.when(k == 2, "{bad").when(k == 3, "[1]").when(k == 0, F.concat(lit("```json\n"), whole, lit("\n```"))).otherwise(whole)
    return pages.where("k <> 1").select("page_id", payload.alias("payload"))


def checked(t: Tables):
    pages = drafts(t)
    return K.check_sections(pages.drop("k"), answers(pages))


#: The contract again, with JSON functions: codes of answers, then of the sections of answers without one.
CODES_SQL = f"""{DRAFT_SQL},
j AS (SELECT *, CASE WHEN json_valid(bare) THEN bare::JSON END AS v FROM (SELECT *, regexp_replace(regexp_replace(payload, '^```[a-z]*\\n', ''), '\\n```$', '') AS bare FROM a)),
o AS (SELECT *, json_type(v) = 'OBJECT' AS is_object, json_type(v, '$.sections') AS sections_kind, CASE WHEN page_type = 'product_overview' THEN ['version'] ELSE [] END AS may FROM j),
answer_codes AS (
  SELECT conv_id, 'ANSWER_EMPTY' AS code, NULL::VARCHAR AS detail FROM o WHERE payload IS NULL
  UNION ALL SELECT conv_id, 'ANSWER_NOT_JSON', NULL FROM o WHERE payload IS NOT NULL AND v IS NULL
  UNION ALL SELECT conv_id, 'ANSWER_NOT_OBJECT', NULL FROM o WHERE NOT is_object
  UNION ALL SELECT conv_id, 'FIELD_UNKNOWN', array_to_string(list_sort(f), ', ') FROM (SELECT conv_id, list_filter(json_keys(v), lambda f: f NOT IN ('page_type', 'sections', 'publication', 'summary')) AS f FROM o WHERE is_object) WHERE len(f) > 0
  UNION ALL SELECT conv_id, 'PAGE_TYPE_INVALID', v ->> '$.page_type' FROM o WHERE is_object AND v ->> '$.page_type' IS DISTINCT FROM page_type
  UNION ALL SELECT conv_id, 'SECTIONS_MISSING', NULL FROM o WHERE is_object AND sections_kind IS DISTINCT FROM 'OBJECT'
  UNION ALL SELECT conv_id, 'SECTION_UNKNOWN', array_to_string(list_sort(f), ', ') FROM (SELECT conv_id, list_filter(json_keys(v, '$.sections'), lambda f: NOT list_contains(need, f) AND NOT list_contains(may, f)) AS f FROM o WHERE is_object AND sections_kind = 'OBJECT') WHERE len(f) > 0
  UNION ALL SELECT conv_id, 'PUBLICATION_NOT_OBJECT', NULL FROM o WHERE is_object AND json_type(v, '$.publication') <> 'OBJECT'
  UNION ALL SELECT conv_id, 'SUMMARY_NOT_OBJECT', NULL FROM o WHERE is_object AND json_type(v, '$.summary') <> 'OBJECT'),
s AS (SELECT conv_id, n, claims, format_only, section, undocumented AND section = 'exceptions' AS silent, json_extract(v, '$.sections.' || section) AS r FROM (SELECT *, unnest(need) AS section FROM o WHERE conv_id NOT IN (SELECT conv_id FROM answer_codes))),
r AS (SELECT *, json_type(r) AS kind, list_filter(json_keys(r), lambda f: f NOT IN ('body', 'claim_ids')) AS extra, trim(CASE json_type(r) WHEN 'VARCHAR' THEN r ->> '$' ELSE r ->> '$.body' END) AS body, json_type(r, '$.claim_ids') AS ids_kind,
  CASE WHEN json_type(r, '$.claim_ids') = 'ARRAY' THEN CAST(json_extract(r, '$.claim_ids') AS VARCHAR[]) ELSE [] END AS ids FROM s),
b AS (SELECT *, list_transform(ids, lambda c: CASE WHEN regexp_full_match(c, 'c[0-9]{{3}}') AND CAST(substr(c, 2) AS INTEGER) <= n THEN claims[CAST(substr(c, 2) AS INTEGER)] ELSE c END) AS asked FROM r),
u AS (SELECT *, list_filter(asked, lambda c: NOT list_contains(claims, c)) AS unknown, list_filter(asked, lambda c: NOT coalesce(format_only[list_position(claims, c)], false)) AS bound FROM b),
z AS (SELECT *, kind IS NOT NULL AND (kind = 'VARCHAR' OR (kind = 'OBJECT' AND ids_kind = 'ARRAY' AND len(extra) = 0)) AND len(unknown) = 0 AS usable FROM u),
section_codes AS (
  SELECT conv_id, section, 'SECTION_MISSING' AS code, NULL::VARCHAR AS detail FROM z WHERE kind IS NULL
  UNION ALL SELECT conv_id, section, 'SECTION_KIND', 'bigint' FROM z WHERE kind NOT IN ('VARCHAR', 'OBJECT')
  UNION ALL SELECT conv_id, section, 'SECTION_FIELDS', array_to_string(list_sort(extra), ', ') FROM z WHERE len(extra) > 0
  UNION ALL SELECT conv_id, section, 'CLAIMS_INVALID', NULL FROM z WHERE kind = 'OBJECT' AND ids_kind <> 'ARRAY'
  UNION ALL SELECT conv_id, section, 'CLAIM_UNKNOWN', array_to_string(list_sort(unknown), ', ') FROM z WHERE len(unknown) > 0
  UNION ALL SELECT conv_id, section, 'UNDOCUMENTED_NOT_EMPTY', NULL FROM z WHERE usable AND silent AND (body <> '' OR len(bound) > 0)
  UNION ALL SELECT conv_id, section, 'SECTION_EMPTY', NULL FROM z WHERE usable AND NOT silent AND body = ''
  UNION ALL SELECT conv_id, section, 'CLAIMS_MISSING', NULL FROM z WHERE usable AND NOT silent AND len(bound) = 0),
codes AS (SELECT conv_id, NULL::VARCHAR AS section, code, detail FROM answer_codes UNION ALL SELECT conv_id, section, code, detail FROM section_codes)"""


@query("cls_12_section_codes", f"WITH {CODES_SQL} SELECT conv_id AS page_id, section, code, detail FROM codes")
def _(spark, d):
    return K.code_rows(checked(Tables(spark, d)))


@query("cls_12_bound_claims", f"WITH {CODES_SQL} SELECT conv_id AS page_id, section, unnest(bound) AS claim_id FROM z WHERE NOT silent AND conv_id NOT IN (SELECT conv_id FROM codes)")
def _(spark, d):
    return K.bound_claims(checked(Tables(spark, d)))


#: Sections that cite their own turn and the one before; every third turn's first sentence may be copied.
BLOCK_SQL = rf"""t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prior, turn % 3 = 0 AS free, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) % 3 = 0 AS prior_free FROM conversations),
e AS (SELECT *, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN 'Before. ' || text || ' After.' WHEN 2 THEN coalesce(prior, '') || chr(10) || text ELSE upper(substr(text, 1, 30)) END AS body,
  CASE WHEN trim(text) = '' THEN '' ELSE text END || CASE WHEN prior IS NULL OR trim(prior) = '' THEN '' ELSE chr(10) || prior END AS evidence,
  list_filter([CASE WHEN free THEN {GATE.format("split_part(text, '. ', 1)")} END, CASE WHEN prior_free THEN {GATE.format("split_part(prior, '. ', 1)")} END], lambda v: coalesce(v, '') <> '') AS exempt FROM t),
s AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(evidence, '([.!?。！？；;])\s+', '\1' || chr(10), 'g'), '\n+'), lambda v: trim(v) <> '') AS ss FROM e),
r AS (SELECT conv_id, turn, body, exempt, n, {GATE.format("array_to_string(ss[i : i + n - 1], ' ')")} AS run FROM s, unnest(range(1, 5)) a(n), unnest(range(1, len(ss) - n + 2)) b(i))"""


def cited_turns(t: Tables):
    """sections (page_id, section, body, claim_ids) and claims (page_id, claim_id, raw_id, locator, text): turns that cite themselves and the one before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.select("conv_id", "turn", "text", F.lag("text").over(w).alias("prior"), F.lag("turn").over(w).alias("before"))
    k = F.col("turn") % 4
    body = F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.lit("Before. "), "text", F.lit(" After."))).when(k == 2, F.concat(F.coalesce("prior", F.lit("")), F.lit("\n"), "text")).otherwise(F.upper(F.substring("text", 1, 30)))
    ids = F.array_compact(F.array("turn", "before"))
    sections = rows.select(F.col("conv_id").alias("page_id"), F.col("turn").alias("section"), body.alias("body"), ids.alias("claim_ids"))
    return sections, t.conversations.select(F.col("conv_id").alias("page_id"), F.col("turn").alias("claim_id"), F.col("turn").alias("raw_id"), F.lit("lines:1-1").alias("locator"), "text")


@query("ext_43_source_blocks", f"WITH {BLOCK_SQL} SELECT DISTINCT conv_id AS page_id, turn AS section FROM r WHERE contains({GATE.format('body')}, run) AND run <> '' AND (n > 3 OR length(run) > 240) AND len(list_filter(exempt, lambda x: contains(run, x))) = 0")
def _(spark, d):
    sections, own = cited_turns(Tables(spark, d))
    kind = F.when(F.col("raw_id") % 3 == 0, F.when(F.col("raw_id") % 2 == 0, "Code").otherwise("template")).otherwise("paragraph")
    return K.source_block_failures(sections, own, own.select("page_id", "raw_id", "locator", kind.alias("content_type"), F.split_part("text", F.lit(". "), F.lit(1)).alias("text")))


@query("ext_44_support_failures", f"""WITH {BLOCK_SQL}, whole AS (SELECT conv_id, string_agg(body, chr(10) ORDER BY turn) AS body FROM e GROUP BY 1), claim AS (SELECT conv_id, turn, text AS claim FROM conversations),
bad AS (SELECT c.conv_id, c.turn FROM claim c JOIN whole w ON w.conv_id = c.conv_id WHERE NOT {support_sql('claim', 'body')}), cited AS (SELECT conv_id, turn AS section, turn AS claim_id FROM t UNION ALL SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) FROM t)
SELECT c.conv_id AS page_id, section, claim_id FROM cited c JOIN bad ON bad.conv_id = c.conv_id AND bad.turn = c.claim_id""")
def _(spark, d):
    sections, own = cited_turns(Tables(spark, d))
    return K.claim_support_failures(sections, own)


#: A page for each turn, with one claim; what is wrong follows from the turn's number and the conversation's.
GATE_SQL = f"""p AS (SELECT conv_id, turn, conv_id || ':' || turn AS page_id, text, split_part(text, '. ', 1) AS claim, (conv_id * 7 + turn) AS k FROM conversations),
q AS (SELECT *, CASE k % 7 WHEN 1 THEN text WHEN 2 THEN '' WHEN 3 THEN 'Other words. [^k1]' WHEN 4 THEN text || ' ' || text || ' [^k1]' ELSE text || ' [^k1]' END AS body, CASE WHEN k % 11 = 4 THEN 'timeout' ELSE 'ok' END AS provider,
  CASE WHEN k % 13 = 3 THEN '' ELSE 'lines:1-1' END AS locator, CASE WHEN k % 13 = 5 THEN 'xyz' ELSE sha256(text) END AS content_hash, k % 13 = 7 AS false_print, CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN ['k2'] WHEN 2 THEN ['k1', ' '] ELSE ['k1'] END AS typed, k % 3 > 0 AS compared FROM p),
g AS (SELECT *, CASE WHEN k % 17 = 5 THEN body ELSE claim END AS evidence, {grams_sql("body")} AS bg, {grams_sql("text")} AS tg, {GATE.format("body")} AS b, {GATE.format("claim")} AS c FROM q),
w AS (SELECT *, claim <> '' AND locator <> '' AND length(content_hash) = 64 AS whole, list_filter(list_transform(regexp_split_to_array(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(10) || chr(10), 'g'), '\\n\\n'), lambda v: {GATE.format("v")}), lambda v: v <> '') AS parts FROM g),
ss AS (SELECT page_id, body, list_filter(regexp_split_to_array(regexp_replace(evidence, '([.!?。！？；;])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda v: trim(v) <> '') AS ss FROM g),
runs AS (SELECT page_id, n, {GATE.format("body")} AS b, {GATE.format("array_to_string(ss[i : i + n - 1], ' ')")} AS run FROM ss, unnest(range(1, 5)) x(n), unnest(range(1, len(ss) - n + 2)) y(i)),
gate_codes AS (
  SELECT page_id, NULL::VARCHAR AS section, 'PROVIDER_FAILED' AS code, provider AS detail FROM w WHERE provider <> 'ok'
  UNION ALL SELECT page_id, NULL, 'BODY_EMPTY', NULL FROM w WHERE trim(body) = ''
  UNION ALL SELECT page_id, NULL, 'EVIDENCE_DUMP', NULL FROM w WHERE trim(evidence) <> '' AND b = {GATE.format("evidence")}
  UNION ALL SELECT page_id, NULL, 'CLAIM_IDS_INVALID', NULL FROM w WHERE list_contains(typed, ' ')
  UNION ALL SELECT page_id, NULL, 'CLAIM_IDS_INCOMPLETE', NULL FROM w WHERE typed = ['k2']
  UNION ALL SELECT page_id, NULL, 'NEAR_DUPLICATE', '1' FROM w WHERE compared AND length(body) > 80 AND CASE WHEN len(bg) = 0 AND len(tg) = 0 THEN 1.0 ELSE len(list_intersect(bg, tg)) / greatest(1, len(list_distinct(list_concat(bg, tg)))) END >= 0.92
  UNION ALL SELECT page_id, NULL, 'SENTENCE_REPEATED', NULL FROM w WHERE compared AND len(list_distinct(parts)) < len(parts)
  UNION ALL SELECT DISTINCT page_id, NULL, 'SOURCE_BLOCK', NULL FROM runs WHERE run <> '' AND contains(b, run) AND (n > 3 OR length(run) > 240)
  UNION ALL SELECT page_id, 'exceptions', 'STATE_QUESTION', NULL FROM w WHERE k % 19 = 1
  UNION ALL SELECT page_id, 'purpose', x, NULL FROM w, unnest(['STATE_SECTION', 'STATE_PAGE_TYPE', 'STATE_NOT_EMPTY', 'STATE_NOT_AUDITED']) y(x) WHERE k % 19 = 2
  UNION ALL SELECT page_id, 'exceptions', 'STATE_NOT_BOUND', NULL FROM w WHERE k % 19 = 3
  UNION ALL SELECT page_id, NULL, 'FINGERPRINT', 'k1' FROM w WHERE false_print AND claim <> ''
  UNION ALL SELECT page_id, NULL, 'ATTRIBUTION_INCOMPLETE', 'k1' FROM w WHERE NOT whole
  UNION ALL SELECT page_id, NULL, 'NOT_FAITHFUL', 'k1' FROM w WHERE whole AND NOT CASE WHEN typed IS NULL THEN contains(b, c) ELSE {support_sql("claim", "body")} END
  UNION ALL SELECT page_id, NULL, 'FOOTNOTE_MISSING', 'k1' FROM w WHERE whole AND NOT contains(body, '[^k1]'))"""


def gate_pages(t: Tables):
    k, text = F.col("k"), F.col("text")
    rows = t.conversations.select(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("page_id"), "text", F.split_part("text", F.lit(". "), F.lit(1)).alias("claim"), (F.col("conv_id") * 7 + F.col("turn")).alias("k"))
    note = F.lit(" [^k1]")
    body = F.when(k % 7 == 1, text).when(k % 7 == 2, "").when(k % 7 == 3, "Other words. [^k1]").when(k % 7 == 4, F.concat(text, F.lit(" "), text, note)).otherwise(F.concat(text, note))
    rows = rows.withColumn("body", body)
    claim = F.struct(
        F.lit("k1").alias("claim_id"), F.col("claim").alias("text"), F.lit("doc://x").alias("source_uri"), F.when(k % 13 == 3, "").otherwise("lines:1-1").alias("locator"),
        F.when(k % 13 == 5, "xyz").otherwise(F.sha2(text, 256)).alias("content_hash"), F.when(k % 13 == 7, "f" * 64).otherwise(T.claim_fingerprint(F.lit("doc://x"), F.col("claim"))).alias("fingerprint"),
    )
    typed = F.when(k % 5 == 1, F.array(F.lit("k2"))).when(k % 5 == 2, F.array(F.lit("k1"), F.lit(" "))).when(k % 5 > 2, F.array(F.lit("k1")))
    state = lambda section, kind, body, audited, bound, question: F.array(F.struct(F.lit(section).alias("section"), F.lit(kind).alias("page_type"), F.lit("source_not_documented").alias("status"), F.lit(body).alias("body"), F.array().cast("array<string>").alias("claim_ids"), F.lit(audited).alias("audited"), F.lit(bound).alias("bound"), F.lit(question).alias("question_status"))).cast(K.STATE)
    states = F.when(k % 19 == 1, state("exceptions", "procedure_or_rule", "", True, True, "open")).when(k % 19 == 2, state("purpose", "product_overview", "x", False, False, None)).when(k % 19 == 3, state("exceptions", "procedure_or_rule", "", True, False, "not_answerable")).when(k % 19 == 4, state("exceptions", "procedure_or_rule", "", True, True, "not_answerable"))
    return rows.select(
        "page_id", "body", F.when(k % 17 == 5, F.col("body")).otherwise(F.col("claim")).alias("evidence"), F.when(k % 11 == 4, "timeout").alias("provider_status"), F.array(claim).alias("claims"), typed.alias("typed_claim_ids"),
        states.alias("states"), F.when(k % 3 > 0, F.array(text)).alias("others"), F.lit(None).cast("array<string>").alias("exempt"),
    )


@query("gte_03_gate_codes", f"WITH {GATE_SQL} SELECT * FROM gate_codes")
def _(spark, d):
    return K.code_rows(K.body_gate(gate_pages(Tables(spark, d))))


def compiled(t: Tables):
    pages = drafts(t)
    k = F.col("page_id")
    text = F.coalesce(F.element_at("claims", F.when(F.size("claims") > 1, 2).otherwise(1))["text"], F.lit(""))
    rows = pages.select("page_id", F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("body"), F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".md")).alias("target_path"), F.when(k % 23 == 5, "degraded").otherwise("draft").alias("draft_status"), (k % 19 == 2).alias("frozen_required"), (k % 38 == 2).alias("frozen_available"), F.lit("a").alias("frozen_expected"), F.when(k % 29 == 4, "b").otherwise("a").alias("frozen_actual"), text.alias("text"))
    gate = rows.where("page_id % 13 <> 6").select(
        "page_id", F.when(k % 4 == 1, F.col("body")).otherwise(F.concat("body", F.lit(" [^k1]"))).alias("body"), F.lit("").alias("evidence"), F.when(k % 31 == 7, "refused").alias("provider_status"),
        F.array(F.struct(F.lit("k1").alias("claim_id"), F.col("body").alias("text"), F.lit("doc://x").alias("source_uri"), F.lit("lines:1-1").alias("locator"), F.sha2("text", 256).alias("content_hash"), F.lit("").alias("fingerprint"))).alias("claims"),
        F.lit(None).cast("array<string>").alias("typed_claim_ids"), F.lit(None).cast(K.STATE).alias("states"), F.lit(None).cast("array<string>").alias("others"), F.lit(None).cast("array<string>").alias("exempt"),
    )
    old = rows.where("page_id % 3 = 1").select("page_id", F.lit("Old").alias("body"), F.concat(F.lit("old/"), F.col("page_id").cast("string")).alias("path"))
    return K.compile_candidates(rows, K.check_sections(pages.drop("k"), answers(pages)), K.body_gate(gate), old)


COMPILE_SQL = f"""WITH {CODES_SQL},
g0 AS (SELECT conv_id, list_filter([CASE WHEN conv_id % 31 = 7 THEN 'PROVIDER_FAILED' END, CASE WHEN conv_id % 4 = 1 THEN 'FOOTNOTE_MISSING' END], lambda v: v IS NOT NULL) AS gc FROM c WHERE conv_id % 13 <> 6),
sc AS (SELECT conv_id, list(code) AS sc FROM codes GROUP BY 1),
st AS (SELECT c.conv_id, CASE WHEN (c.conv_id % 19 = 2 AND c.conv_id % 38 <> 2) OR c.conv_id % 29 = 4 THEN 'frozen' WHEN c.conv_id % 23 = 5 THEN 'draft' WHEN sc IS NOT NULL THEN 'sections' WHEN gc IS NULL OR len(gc) > 0 THEN 'gate' END AS stage,
  CASE WHEN c.conv_id % 19 = 2 AND c.conv_id % 38 <> 2 THEN ['FROZEN_MISSING'] WHEN c.conv_id % 29 = 4 THEN ['FROZEN_CHANGED'] WHEN c.conv_id % 23 = 5 THEN ['DRAFT_NOT_READY'] WHEN sc IS NOT NULL THEN sc WHEN gc IS NULL THEN ['GATE_MISSING'] ELSE gc END AS codes FROM c LEFT JOIN sc USING (conv_id) LEFT JOIN g0 USING (conv_id))
SELECT conv_id AS page_id, CASE WHEN stage IS NULL THEN 'published' ELSE 'degraded' END AS status, stage, CASE WHEN stage IS NULL THEN 'Page ' || conv_id WHEN conv_id % 3 = 1 THEN 'Old' ELSE '' END AS reader_body,
  CASE WHEN stage IS NULL THEN 'pages/' || conv_id || '.md' WHEN conv_id % 3 = 1 THEN 'old/' || conv_id END AS reader_path, stage IS NOT NULL AND conv_id % 3 = 1 AS kept_old, array_to_string(list_sort(codes), ',') AS codes FROM st"""


@query("gte_04_candidates", COMPILE_SQL)
def _(spark, d):
    out = compiled(Tables(spark, d))
    return out.withColumn("codes", F.array_join(F.array_sort(F.transform("codes", lambda c: c["code"])), ","))
