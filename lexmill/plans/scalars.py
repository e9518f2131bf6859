"""Scalar functions, filters and classifiers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.plans.base import CLAIMS, SOURCES, Tables, query

TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
SQUEEZE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
FOLD = "replace(lower({0}), 'ß', 'ss')"
#: Markdown made from conversations: a heading for each turn, then its text.
MD_SQL = "md AS (SELECT conv_id, '# Conversation ' || conv_id || chr(10) || string_agg('## ' || role || ' ' || turn || chr(10) || text, chr(10) ORDER BY turn) AS md FROM conversations GROUP BY conv_id)"


def markdown(t: Tables):
    """conv_id, md: each conversation as one Markdown page."""
    turn = F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), "text")
    parts = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", turn.alias("s")))).alias("p"))
    return parts.select("conv_id", F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n"), F.array_join(F.transform("p", lambda x: x["s"]), "\n")).alias("md"))


@query("scl_01_fingerprint", "SELECT doc_id, sha256(text) AS fingerprint FROM documents")
def _(spark, d):
    return Tables(spark, d).documents.select("doc_id", T.fingerprint("text").alias("fingerprint"))


@query("scl_02_normalize_uri", r"""
SELECT page_id, regexp_replace(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)) || CASE WHEN regexp_extract(url, '^[^:]*://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[^:]*://[^/?#]+([^?#]*)', 1) END || regexp_extract(url, '(\?[^#]*)', 1), '#.*$', '') AS uri FROM pages""")
def _(spark, d):
    return Tables(spark, d).pages.select("page_id", T.normalize_uri("url").alias("uri"))


@query("scl_03_source_id", f"WITH {SOURCES} SELECT doc_id, 'source-' || substr(sha256(uri), 1, 20) AS source_id FROM src")
def _(spark, d):
    return Tables(spark, d).sources().select("doc_id", T.source_id(F.lower("uri")).alias("source_id"))


@query("scl_04_snapshot_id", f"WITH {SOURCES} SELECT doc_id, 'snapshot-' || substr(sha256(uri || chr(10) || path || chr(10) || content_hash), 1, 24) AS snapshot_id FROM src")
def _(spark, d):
    return Tables(spark, d).sources().select("doc_id", T.snapshot_id("uri", "path", "text").alias("snapshot_id"))


@query("scl_05_normalize_claim", f"WITH {CLAIMS} SELECT doc_id, line_no, {FOLD.format(SQUEEZE.format('claim'))} AS normal FROM claims")
def _(spark, d):
    return Tables(spark, d).claims().select("doc_id", "line_no", T.normalize_claim("claim").alias("normal"))


@query("scl_06_claim_fingerprint", f"WITH {CLAIMS} SELECT doc_id, line_no, sha256(uri || chr(10) || {FOLD.format(SQUEEZE.format('claim'))}) AS claim_fingerprint FROM claims")
def _(spark, d):
    return Tables(spark, d).claims().select("doc_id", "line_no", T.claim_fingerprint("uri", "claim").alias("claim_fingerprint"))


GATE = r"regexp_replace(" + FOLD.format(SQUEEZE.format("replace(translate({0}, '" + T.WIDE_MARKS.replace("'", "''") + "', '" + T.PLAIN_MARKS.replace("'", "''") + "'), '…', '...')")) + r", '\s*([!-/:-@\[-`{{-~])\s*', '\1', 'g')"


@query("scl_07_normalize_for_gate", f"WITH {CLAIMS} SELECT doc_id, line_no, {GATE.format('claim')} AS normal FROM claims")
def _(spark, d):
    return Tables(spark, d).claims().select("doc_id", "line_no", T.normalize_for_gate("claim").alias("normal"))


@query("scl_08_normalize_newlines", r"SELECT page_id, sha256(regexp_replace(html, '\r\n?', chr(10), 'g')) AS h, len(string_split(regexp_replace(html, '\r\n?', chr(10), 'g'), chr(10))) AS n_lines FROM pages")
def _(spark, d):
    x = T.normalize_newlines("html")
    return Tables(spark, d).pages.select("page_id", F.sha2(x, 256).alias("h"), F.size(F.split(x, "\n", -1)).cast("long").alias("n_lines"))


@query("scl_09_web_references", r"SELECT page_id, array_to_string(regexp_extract_all(html, '(https?://[^\s)>]+)', 1), ' ') AS refs FROM pages")
def _(spark, d):
    return Tables(spark, d).pages.select("page_id", F.array_join(T.web_references("html"), " ").alias("refs"))


@query("scl_12_slug", r"SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_name || ' & ' || p_type || '/' || p_brand), '&', ' and '), '[^0-9a-z]+', '-', 'g'), 1, 80) AS slug FROM part")
def _(spark, d):
    return Tables(spark, d).part.select("p_partkey", T.slug(F.concat("p_name", F.lit(" & "), "p_type", F.lit("/"), "p_brand")).alias("slug"))


@query("scl_14_unique_slug", """
WITH s AS (SELECT p_partkey, replace(lower(p_name), ' ', '-') AS base FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS n FROM s)
SELECT p_partkey, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM r""")
def _(spark, d):
    from lexmill.operators.layout import unique_slugs

    return unique_slugs(Tables(spark, d).part.select("p_partkey", T.slug("p_name").alias("base")), "base", "p_partkey").select("p_partkey", "slug")


@query("scl_15_topic_key", "SELECT p_partkey, lower(p_type) || '/' || replace(lower(p_brand), '#', '-') || '/' || replace(lower(p_name), ' ', '-') AS topic_key FROM part")
def _(spark, d):
    return Tables(spark, d).part.select("p_partkey", F.concat_ws("/", T.slug("p_type"), T.slug("p_brand"), T.slug("p_name")).alias("topic_key"))


@query("scl_16_part_path", "SELECT conv_id, turn, CASE WHEN turn + 1 = 1 THEN printf('pages/topic-%d.md', conv_id) ELSE printf('pages/topic-%d.part-%03d.md', conv_id, turn + 1) END AS path FROM conversations")
def _(spark, d):
    return Tables(spark, d).conversations.select("conv_id", "turn", T.part_path(F.lit("pages"), F.concat(F.lit("topic-"), F.col("conv_id").cast("string")), F.col("turn") + 1).alias("path"))


@query("scl_17_first_heading", f"WITH {MD_SQL} SELECT conv_id, 'Conversation ' || conv_id AS h1 FROM md")
def _(spark, d):
    return markdown(Tables(spark, d)).select("conv_id", T.first_heading("md").alias("h1"))


@query("scl_18_structure_features", rf"""
WITH {SOURCES} SELECT doc_id, true AS parent_child, regexp_matches(text, '\|[^\n]*\|') AS "table", regexp_matches(lower(text), '\b(?:faq|frequently asked|常见问题|问答)\b') AS faq,
  regexp_matches(text, '(?i)!\[[^]]*\]\([^)]*\)|<img\b') AS image, regexp_matches(text, '[一-鿿]') AND regexp_matches(text, '[A-Za-z]') AS bilingual,
  regexp_matches(text, '(?i)\bv?[0-9]+\.[0-9]+(?:\.[0-9]+)?\b') AS version, regexp_matches(lower(text), '(?:todo|draft|lorem ipsum|噪声)') AS noise FROM src""")
def _(spark, d):
    return Tables(spark, d).sources().select("doc_id", T.structure_features("text", "path", F.col("path"), F.lit(None).cast("string")).alias("f")).select("doc_id", "f.*")


@query("scl_19_line_marker", rf"""
WITH {MD_SQL}, l AS (SELECT conv_id, generate_subscripts(string_split(md, chr(10)), 1) AS line_no, unnest(string_split(md, chr(10))) AS line FROM md)
SELECT conv_id, CASE WHEN regexp_matches(line, '^\s*#{{1,6}}\s+') THEN 'heading' WHEN regexp_matches(line, '(?i)^\s*(?:FAQ|Q(?:uestion)?)[\s:：]') THEN 'faq'
  WHEN regexp_matches(line, '(?i)^\s*(?:Error\s+)?[A-Z][A-Z0-9_-]*[0-9]+[\s:：-]') THEN 'error_code'
  WHEN regexp_matches(line, '(?i)^\s*(?:[-*]\s*)?(?:parameter|param|argument)\b[^:：]*[:：]') THEN 'parameter' WHEN starts_with(trim(line), '```') THEN 'code' END AS marker, count(*) AS n_lines
FROM l GROUP BY ALL""")
def _(spark, d):
    rows = markdown(Tables(spark, d)).select("conv_id", F.explode(F.split("md", "\n", -1)).alias("line"))
    return rows.groupBy("conv_id", T.marker("line").alias("marker")).agg(F.count("*").alias("n_lines"))


@query("scl_24_clean_line", rf"""
WITH {CLAIMS}, a AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(claim, 'https?://\S+', '', 'g'), '[*_`~]', '', 'g') AS x FROM claims),
b AS (SELECT doc_id, line_no, {SQUEEZE.format(r"regexp_replace(x, '^(?:[-*+]\s+|[0-9]+[.)、]\s+)', '')")} AS x FROM a)
SELECT doc_id, line_no, trim(regexp_replace(x, '[；;、,，]\s*$', '')) AS line FROM b""")
def _(spark, d):
    return Tables(spark, d).claims().select("doc_id", "line_no", T.clean_line("claim").alias("line"))


@query("scl_25_table_cells", rf"""
WITH {CLAIMS} SELECT doc_id, line_no, CAST(len(string_split(regexp_replace(claim, '^\|+|\|+$', '', 'g'), '|')) AS INTEGER) AS n_cells FROM claims WHERE len(claim) - len(replace(claim, '|', '')) >= 2""")
def _(spark, d):
    rows = Tables(spark, d).claims().withColumn("cells", T.table_cells("claim")).where("cells IS NOT NULL")
    return rows.select("doc_id", "line_no", F.size("cells").alias("n_cells"))


@query("scl_27_summary_line", rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
p AS (SELECT doc_id, i, {SQUEEZE.format("line")} AS v FROM l WHERE {TRIM.format("line")} <> '' AND NOT regexp_matches({TRIM.format("line")}, '^(#|- |\* |> |\|)')),
f AS (SELECT doc_id, arg_min(v, i) AS v FROM p WHERE length(v) >= 8 GROUP BY doc_id)
SELECT d.doc_id, coalesce(regexp_replace(substr(v, 1, 180), '[。；;，,]+$', '') || CASE WHEN length(v) > 180 THEN '……' ELSE '。' END, '本页整理 ' || source || ' 的操作、规则或背景资料。') AS summary FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id""")
def _(spark, d):
    return Tables(spark, d).documents.select("doc_id", T.summary_line("text", "source").alias("summary"))


@query("scl_28_code_signatures", r"SELECT page_id, 1 * 2 AS code_fence_markers, CAST(len(regexp_extract_all(url, '(?i)(?:https?://|mailto:)[^\s)]+')) AS INTEGER) AS code_urls FROM pages")
def _(spark, d):
    x = F.concat(F.lit("```\n"), "url", F.lit("\n```"))
    return Tables(spark, d).pages.select("page_id", T.code_signatures(x).alias("s")).select("page_id", "s.code_fence_markers", "s.code_urls")


@query("scl_29_code_integrity", r"SELECT page_id, CASE WHEN url LIKE 'https%' THEN 'passed' ELSE 'failed' END AS integrity FROM pages")
def _(spark, d):
    from lexmill.operators.gates import code_integrity

    fence = lambda x: F.concat(F.lit("```\n"), x, F.lit("\n```"))
    kept = F.when(F.col("url").startswith("https"), F.col("url")).otherwise("")
    return code_integrity(Tables(spark, d).pages.select("page_id", fence("url").alias("raw"), fence(kept).alias("candidate")), "raw", "candidate").select("page_id", "integrity")


@query("scl_30_version_literal", r"SELECT page_id, regexp_extract(html, '(?i)\b(v?[0-9]+(?:\.[0-9]+){1,3})\b', 1) AS version, regexp_matches(regexp_extract(html, '(?i)\b(v?[0-9]+(?:\.[0-9]+){1,3})\b', 1), '(?i)^v?[0-9]+(?:\.[0-9]+){1,3}$') AS valid FROM pages")
def _(spark, d):
    v = F.regexp_extract("html", r"(?i)\b(v?[0-9]+(?:\.[0-9]+){1,3})\b", 1)
    return Tables(spark, d).pages.select("page_id", v.alias("version"), v.rlike(r"(?i)^v?[0-9]+(?:\.[0-9]+){1,3}$").alias("valid"))


@query("scl_32_sentences", r"""
WITH x AS (SELECT doc_id, regexp_replace(text, '([.!?。！？；;])\s+', '\1' || chr(10), 'g') AS t FROM documents),
s AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS s FROM x) SELECT doc_id, count(*) AS n_sentences, CAST(sum(length(regexp_replace(s, '^\s+|\s+$', '', 'g'))) AS BIGINT) AS n_chars FROM s WHERE trim(s) <> '' GROUP BY doc_id""")
def _(spark, d):
    rows = Tables(spark, d).documents.select("doc_id", F.explode(T.sentences("text")).alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.char_length("s")).alias("n_chars"))


@query("scl_33_word_grams", r"""
WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM documents)
SELECT doc_id, CAST(count(DISTINCT array_to_string(ws[i : i + 4], ' ')) AS INTEGER) AS n_grams FROM w LEFT JOIN unnest(range(1, len(ws) - 3)) t(i) ON len(ws) >= 5 GROUP BY doc_id""")
def _(spark, d):
    return Tables(spark, d).documents.select("doc_id", F.size(T.word_grams(F.regexp_replace("text", r"\s+", " "))).alias("n_grams"))


@query("scl_36_retention_deadline", "SELECT event_id, ts + INTERVAL 90 DAY AS retain_until FROM events")
def _(spark, d):
    return Tables(spark, d).events.select("event_id", T.retention_deadline("ts").alias("retain_until"))


@query("scl_37_lifecycle", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'deprecated' WHEN DATE '1998-01-01' >= CAST(o_orderdate AS DATE) THEN 'stale' ELSE 'current' END AS lifecycle FROM orders""")
def _(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "deprecated").otherwise("published")
    return Tables(spark, d).orders.select("o_orderkey", T.lifecycle(status, F.date_format("o_orderdate", "yyyy-MM-dd"), "1998-01-01").alias("lifecycle"))


@query("scl_38_canonical_json", """SELECT p_partkey, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || '}') AS h FROM part""")
def _(spark, d):
    from lexmill.operators.ledger import canonical_hash

    return Tables(spark, d).part.select("p_partkey", canonical_hash({"brand": F.col("p_brand"), "name": F.col("p_name"), "size": F.col("p_size")}).alias("h"))


@query("scl_40_comparison_key", """SELECT p_partkey, 'ck1:' || sha256('["' || lower(p_type) || '","' || lower(p_brand) || '","' || lower(p_name) || '"]') AS comparison_key FROM part""")
def _(spark, d):
    parts = F.to_json(F.array(*[F.lower(c) for c in ("p_type", "p_brand", "p_name")]))
    return Tables(spark, d).part.select("p_partkey", F.concat(F.lit("ck1:"), F.sha2(parts, 256)).alias("comparison_key"))


@query("scl_41_term_coverage", "SELECT doc_id, (CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'que') AS INT) + CAST(contains(lower(text), 'keit') AS INT)) / 3 AS coverage FROM documents")
def _(spark, d):
    return Tables(spark, d).documents.select("doc_id", T.term_coverage("text", ["the", "que", "keit"]).alias("coverage"))


@query("scl_42_source_anchor", f"WITH {MD_SQL} SELECT conv_id, conv_id % 2 = 0 AS anchored FROM md")
def _(spark, d):
    page = F.when(F.col("conv_id") % 2 == 0, F.concat("md", F.lit("\n## Sources\n- a"))).otherwise(F.col("md"))
    return markdown(Tables(spark, d)).select("conv_id", T.has_source_anchor(page).alias("anchored"))


@query("scl_44_boundary_terms", "SELECT doc_id, array_to_string(list_filter(['nicht', 'pas', 'not', 'no'], lambda m: contains(lower(text), m))[1:2], ',') AS terms FROM documents")
def _(spark, d):
    found = F.filter(F.array(*map(F.lit, ("nicht", "pas", "not", "no"))), lambda m: F.contains(F.lower("text"), m))
    return Tables(spark, d).documents.select("doc_id", F.array_join(F.slice(found, 1, 2), ",").alias("terms"))


@query("scl_47_provenance_text", f"""WITH {CLAIMS} SELECT doc_id, line_no, 'lines:' || line_no || '-' || line_no AS locator FROM claims""")
def _(spark, d):
    from lexmill.operators.ledger import provenance_text, read_provenance

    rows = Tables(spark, d).claims().withColumn("p", provenance_text("uri", F.format_string("lines:%d-%d", "line_no", "line_no")))
    return rows.select("doc_id", "line_no", read_provenance("p")["locator"].alias("locator"))


@query("scl_49_vector_valid", "SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS valid FROM embeddings")
def _(spark, d):
    from lexmill.operators.similarity import vector_valid

    return Tables(spark, d).embeddings.select("vec_id", vector_valid("embedding", 64).alias("valid"))


# --- filters ---------------------------------------------------------------------


@query("flt_01_empty_shell", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) = '' OR source = 'src1' AS shell FROM documents")
def _(spark, d):
    status = F.when(F.col("source") == "src1", "failed").otherwise("ok")
    return Tables(spark, d).documents.select("doc_id", T.is_empty_shell("text", status).alias("shell"))


@query("flt_02_validation_router", rf"""
WITH {SOURCES}, x AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'other' END AS declared, CASE WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN doc_id % 13 = 0 THEN '' ELSE uri END AS uri, text FROM src)
SELECT doc_id, CASE WHEN declared IS NOT NULL THEN 'fingerprint_mismatch' WHEN status = 'failed' OR trim(text) = '' THEN 'empty_shell' WHEN uri = '' THEN 'missing_uri' ELSE 'passed' END AS validation_reason,
  CASE WHEN declared IS NULL AND status = 'ok' AND trim(text) <> '' AND uri <> '' THEN 'passed' ELSE 'failed' END AS validation_status FROM x""")
def _(spark, d):
    from lexmill.operators.dedup import route_validation

    rows = Tables(spark, d).sources().withColumns({"declared_hash": F.when(F.col("doc_id") % 7 == 0, "other"), "source_status": F.when(F.col("doc_id") % 11 == 0, "failed").otherwise("ok"), "uri": F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("uri"))})
    return route_validation(rows).select("doc_id", "validation_reason", "validation_status")


@query("flt_03_claim_lines", f"WITH {CLAIMS} SELECT doc_id, line_no, claim FROM claims")
def _(spark, d):
    return Tables(spark, d).claims().select("doc_id", "line_no", "claim")


@query("flt_04_unsupported", f"WITH {CLAIMS} SELECT doc_id, line_no, starts_with({FOLD.format('claim')}, 'unsupported:') AS unsupported FROM claims")
def _(spark, d):
    return Tables(spark, d).claims().select("doc_id", "line_no", T.is_unsupported("claim").alias("unsupported"))


@query("flt_05_active_history", "SELECT event_id, user_id FROM events WHERE event_type NOT IN ('error', 'login') AND user_id IN (SELECT c_custkey FROM customer)")
def _(spark, d):
    from lexmill.operators.ledger import active_history

    t = Tables(spark, d)
    return active_history(t.events, "event_type", ("error", "login"), t.customer.select(F.col("c_custkey").alias("user_id")), "user_id").select("event_id", "user_id")


@query("flt_06_reader_eligible", "SELECT doc_id, quality = 1 AND toxic = 0 AS eligible FROM labels")
def _(spark, d):
    return Tables(spark, d).labels.select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("eligible"))


@query("flt_07_safe_path", "SELECT page_id, NOT contains(p, '//') AS safe FROM (SELECT page_id, replace(url, 'http:', 'x') AS p FROM pages)")
def _(spark, d):
    return Tables(spark, d).pages.select("page_id", T.is_safe_path(F.replace("url", F.lit("http:"), F.lit("x"))).alias("safe"))


@query("flt_08_reader_target", f"WITH {SOURCES} SELECT doc_id, source IN ('src0', 'src1') AS is_target FROM src")
def _(spark, d):
    from lexmill.operators.gates import is_reader_target

    path = F.when(F.col("source") == "src0", "README.md").when(F.col("source") == "src1", F.concat(F.lit("pages/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))).otherwise(F.col("path"))
    return Tables(spark, d).sources().select("doc_id", is_reader_target(path).alias("is_target"))


@query("flt_10_format_only", rf"WITH {CLAIMS} SELECT doc_id, line_no, regexp_matches(claim, '^\|?[\s:|-]+\|?$') AS format_only FROM claims")
def _(spark, d):
    return Tables(spark, d).claims().select("doc_id", "line_no", F.col("claim").rlike(r"^\|?[\s:|-]+\|?$").alias("format_only"))


@query("flt_14_growth_records", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) WHERE n > 100")
def _(spark, d):
    from lexmill.operators.ledger import growth

    return growth(Tables(spark, d).events, "event_type", "event_id", 100).select("event_id", "event_type")


@query("flt_15_negative_referent", "SELECT item_id, NOT EXISTS (SELECT 1 FROM pages p WHERE contains(lower(p.html), lower(split_part(b.text, ' ', 1) || ' ' || split_part(b.text, ' ', 2)))) AS absent FROM benchmark b")
def _(spark, d):
    t = Tables(spark, d)
    terms = t.benchmark.select("item_id", F.lower(F.concat(F.split_part("text", F.lit(" "), F.lit(1)), F.lit(" "), F.split_part("text", F.lit(" "), F.lit(2)))).alias("term"))
    from lexmill.operators.terms import absent_terms

    return absent_terms(terms, "item_id", t.pages.select("html"), "html")


@query("flt_16_managed_conflicts", "SELECT s.s_suppkey, s.s_nationkey FROM supplier s JOIN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) > 1) c ON s.s_nationkey = c.s_nationkey WHERE s_acctbal > 0")
def _(spark, d):
    from lexmill.operators.joins import shared_targets

    return shared_targets(Tables(spark, d).supplier, "s_nationkey", ~(F.col("s_acctbal") > 0)).select("s_suppkey", "s_nationkey")


# --- classification ---------------------------------------------------------------

MODULE_RULES = [("identity", ("sso", "login", "user")), ("data", ("tion", "data")), ("policy", ("keit", "regla"))]
TYPE_RULES = [("pitfalls", ("bug", "retro", "error")), ("standards", ("policy", "the "))]


@query("cls_01_module_rules", "SELECT doc_id, CASE WHEN regexp_matches(h, 'sso|login|user') THEN 'identity' WHEN regexp_matches(h, 'tion|data') THEN 'data' WHEN regexp_matches(h, 'keit|regla') THEN 'policy' ELSE 'general' END AS module FROM (SELECT doc_id, lower(source || chr(10) || substr(text, 1, 3000)) AS h FROM documents)")
def _(spark, d):
    return Tables(spark, d).documents.select("doc_id", T.first_rule(F.concat("source", F.lit("\n"), F.substring("text", 1, 3000)), MODULE_RULES, "general").alias("module"))


@query("cls_02_knowledge_type_rules", "SELECT doc_id, CASE WHEN regexp_matches(h, 'bug|retro|error') THEN 'pitfalls' WHEN regexp_matches(h, 'policy|the ') THEN 'standards' ELSE 'module-manual' END AS knowledge_type FROM (SELECT doc_id, lower(source || chr(10) || array_to_string(string_split(text, chr(10))[1:8], chr(10))) AS h FROM documents)")
def _(spark, d):
    opening = F.array_join(F.slice(F.split("text", "\n", -1), 1, 8), "\n")
    return Tables(spark, d).documents.select("doc_id", T.first_rule(F.concat("source", F.lit("\n"), opening), TYPE_RULES, "module-manual").alias("knowledge_type"))


@query("cls_03_taxonomy_rules", """
WITH r(pos, id, root, anys, alls) AS (VALUES (1, 'small', NULL, ['small', 'tiny'], []::VARCHAR[]), (2, 'eco-red', 'ECONOMY', ['red', 'blue'], ['widget']), (3, 'eco', 'ECONOMY', []::VARCHAR[], []::VARCHAR[])),
m AS (SELECT p_partkey, min(pos) AS pos FROM part JOIN r ON (root IS NULL OR root = p_type) AND (len(anys) = 0 OR len(list_filter(anys, lambda t: contains(p_name, t))) > 0) AND len(list_filter(alls, lambda t: NOT contains(p_name, t))) = 0 GROUP BY 1)
SELECT p.p_partkey, coalesce(r.id, 'unmatched') AS rule_id FROM part p LEFT JOIN m ON p.p_partkey = m.p_partkey LEFT JOIN r ON r.pos = m.pos""")
def _(spark, d):
    from lexmill.operators.taxonomy import Rule, classify

    rules = [Rule("small", None, ("small", "tiny"), ()), Rule("eco-red", "ECONOMY", ("red", "blue"), ("widget",)), Rule("eco", "ECONOMY", (), ())]
    return Tables(spark, d).part.select("p_partkey", classify("p_type", "p_name", rules).alias("rule_id"))


@query("cls_05_product_label", "SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'household-goods' WHEN 'BUILDING' THEN 'building-site' ELSE lower(c_mktsegment) END AS product FROM customer")
def _(spark, d):
    from lexmill.operators.taxonomy import labelled

    return Tables(spark, d).customer.select("c_custkey", labelled("c_mktsegment", {"HOUSEHOLD": "household-goods", "BUILDING": "building-site"}).alias("product"))


@query("cls_09_topic_row_adapter", "SELECT p_partkey, CASE WHEN p_size IS NULL OR p_size < 5 THEN 'degraded' WHEN p_type = 'ECONOMY' THEN 'product_overview' ELSE 'module' END AS row_kind FROM part")
def _(spark, d):
    kind = F.when(F.col("p_size").isNull() | (F.col("p_size") < 5), "degraded").when(F.col("p_type") == "ECONOMY", "product_overview").otherwise("module")
    return Tables(spark, d).part.select("p_partkey", kind.alias("row_kind"))


@query("cls_11_object_candidates", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN 'managed' END, CASE WHEN c_acctbal > 0 THEN 'metadata' END, 'title') AS tier FROM customer")
def _(spark, d):
    tier = F.coalesce(F.when(F.col("c_acctbal") > 5000, "managed"), F.when(F.col("c_acctbal") > 0, "metadata"), F.lit("title"))
    return Tables(spark, d).customer.select("c_custkey", tier.alias("tier"))
