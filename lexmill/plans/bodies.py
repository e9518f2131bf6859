"""Bodies against their evidence: support, copies, near duplicates, facts, gates, pages.

A body meets evidence of another row, or an edited copy of its own, so that every verdict occurs
and an operator that says the same of all rows fails.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import gates as G
from lexmill.operators import graph
from lexmill.operators import ledger as R
from lexmill.operators import scan as S
from lexmill.plans.base import CLAIMS, SOURCES, Tables, query
from lexmill.plans.scalars import GATE, MD_SQL, markdown

#: Turns with evidence: the turn itself, the turn without its last word, or the next turn of the conversation.
TURNS_SQL = r"""t AS (SELECT conv_id, turn, text AS body, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN regexp_replace(text, '\S+$', '') ELSE coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') END AS evidence FROM conversations)"""


def turns(t: Tables):
    after = F.coalesce(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    evidence = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.regexp_replace("text", r"\S+$", "")).otherwise(after)
    return t.conversations.select("conv_id", "turn", F.col("text").alias("body"), evidence.alias("evidence"))


def support_sql(claim: str, body: str) -> str:
    """The rule of ``supported_by_body`` over two columns, for texts without numbers next to letters."""
    x, y = GATE.format(f"regexp_replace({claim}, '^\\s*(?:[-*+]\\s+|[0-9]+\\s*[.)、]\\s*)', '')"), GATE.format(body)
    token, number, name = "([a-z0-9]+%?|[一-鿿])", "\\b([0-9]+(?:\\.[0-9]+)?%?)", "\\b([A-Z][A-Z0-9_-]{2,})\\b"
    a, b = (f"list_distinct(regexp_extract_all({v}, '{token}', 1))" for v in (x, y))
    inside = lambda p, v, w: f"len(list_filter(regexp_extract_all({v}, '{p}', 1), lambda z: NOT list_contains(regexp_extract_all({w}, '{p}', 1), z))) = 0"
    return f"(({x} <> '' AND contains({y}, {x})) OR ({inside(number, x, y)} AND {inside(name, claim, body)} AND len({a}) >= 3 AND len(list_intersect({a}, {b})) >= greatest(3, (len({a}) + 1) // 2)))"


def grams_sql(x: str) -> str:
    words = f"list_filter(string_split({GATE.format(x)}, ' '), lambda v: v <> '')"
    return f"list_distinct([array_to_string(({words})[i : i + 4], ' ') FOR i IN range(1, len({words}) - 3)])"


NEAR_SQL = f"g AS (SELECT *, {grams_sql('body')} AS p, {grams_sql('evidence')} AS q FROM t), near AS (SELECT *, length(body) > 80 AND CASE WHEN len(p) = 0 AND len(q) = 0 THEN 1.0 ELSE len(list_intersect(p, q)) / greatest(1, len(list_distinct(list_concat(p, q)))) END >= 0.92 AS duplicate FROM g)"
#: Runs of one to four sentences of the evidence that stand in the body; four are too many, fewer if over 240 characters.
COPIED_SQL = rf"""s AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(evidence, '([.!?。！？；;])\s+', '\1' || chr(10), 'g'), '\n+'), lambda v: trim(v) <> '') AS ss FROM t),
r AS (SELECT conv_id, turn, body, n, {GATE.format("array_to_string(ss[i : i + n - 1], ' ')")} AS run FROM s, unnest(range(1, 5)) a(n), unnest(range(1, len(ss) - n + 2)) b(i)),
copied AS (SELECT conv_id, turn, bool_or(contains({GATE.format("body")}, run) AND (n > 3 OR length(run) > 240)) AS copied FROM r GROUP BY ALL)"""


def near_duplicate() -> Column:
    g = lambda c: T.word_grams(T.normalize_for_gate(c))
    return (F.char_length("body") > 80) & (T.gram_jaccard(g("body"), g("evidence")) >= 0.92)


@query("sim_07_near_duplicate_gate", f"WITH {TURNS_SQL}, {NEAR_SQL} SELECT conv_id, turn, duplicate FROM near")
def _(spark, d):
    return turns(Tables(spark, d)).select("conv_id", "turn", near_duplicate().alias("duplicate"))


@query("sim_08_copied_run", f"WITH {TURNS_SQL}, {COPIED_SQL} SELECT t.conv_id, t.turn, coalesce(copied, false) AS copied FROM t LEFT JOIN copied c ON c.conv_id = t.conv_id AND c.turn = t.turn")
def _(spark, d):
    return turns(Tables(spark, d)).select("conv_id", "turn", S.copied_run("evidence", "body").alias("copied"))


@query("gte_03_body_gate", f"WITH {TURNS_SQL}, {NEAR_SQL}, {COPIED_SQL} SELECT n.conv_id, n.turn, CASE WHEN length(n.body) <= 80 THEN 'short' WHEN copied THEN 'copied' WHEN duplicate THEN 'near_duplicate' ELSE 'passed' END AS verdict FROM near n LEFT JOIN copied c ON c.conv_id = n.conv_id AND c.turn = n.turn")
def _(spark, d):
    v = F.when(F.char_length("body") <= 80, "short").when(S.copied_run("evidence", "body"), "copied").when(near_duplicate(), "near_duplicate").otherwise("passed")
    return turns(Tables(spark, d)).select("conv_id", "turn", v.alias("verdict"))


@query("sim_19_claim_support", f"WITH {TURNS_SQL}, f AS (SELECT conv_id, turn, body, string_split(evidence, chr(10))[1] AS claim FROM t) SELECT conv_id, turn, {support_sql('claim', 'body')} AS supported FROM f")
def _(spark, d):
    claim = F.split("evidence", "\n")[0]
    return turns(Tables(spark, d)).select("conv_id", "turn", G.supported_by_body(claim, F.col("body")).alias("supported"))


@query("ext_44_claim_support", f"WITH f AS (SELECT item_id, b.text AS claim, d.text AS body FROM benchmark b JOIN documents d ON d.doc_id % 40 = b.item_id % 40 WHERE d.text IS NOT NULL) SELECT item_id, count(*) AS n, count(*) FILTER ({support_sql('claim', 'body')}) AS supported FROM f GROUP BY item_id")
def _(spark, d):
    t = Tables(spark, d)
    b = t.benchmark.select("item_id", F.col("text").alias("claim"), (F.col("item_id") % 40).alias("k"))
    docs = t.documents.where("text IS NOT NULL").select((F.col("doc_id") % 40).alias("k"), F.col("text").alias("body"))
    return b.join(docs, "k").groupBy("item_id").agg(F.count("*").alias("n"), F.count_if(G.supported_by_body(F.col("claim"), F.col("body"))).alias("supported"))


@query("gte_02_faithfulness", f"WITH {CLAIMS}, b AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE substr(text, strpos(text, chr(10)) + 1) END AS body FROM documents) SELECT doc_id, CASE WHEN bool_and(contains(body, claim)) THEN 'faithful' ELSE 'fallback_claim_concat' END AS status FROM claims JOIN b USING (doc_id) GROUP BY doc_id")
def _(spark, d):
    # every other body has lost its first line
    t = Tables(spark, d)
    body = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.expr("substr(text, instr(text, '\n') + 1)"))
    return G.faithful(t.claims().select("doc_id", "claim"), t.documents.select("doc_id", body.alias("body")), "doc_id")


@query("scl_34_facts_kept", "SELECT o_orderkey, o_orderkey % 3 <> 0 AS kept FROM orders")
def _(spark, d):
    line = lambda price: F.concat(F.lit("ORDER-"), F.col("o_orderkey").cast("string"), F.lit(" costs "), price.cast("decimal(18,2)").cast("string"))
    other = F.col("o_totalprice") + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)
    return Tables(spark, d).orders.select("o_orderkey", T.facts_kept(line(F.col("o_totalprice")), line(other)).alias("kept"))


@query("scl_35_summary_valid", "SELECT p_partkey, p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AS valid FROM part")
def _(spark, d):
    # a summary refers to two claims and names the part; every fifth refers to one, every seventh names another part
    name = lambda k: F.concat(F.lit("PART-"), k.cast("string"), F.lit(" in stock"))
    key = F.col("p_partkey")
    refers = F.when(key % 5 == 0, F.array(key)).otherwise(F.array(key, key + 1))
    return Tables(spark, d).part.select("p_partkey", G.summary_valid(name(key + F.when(key % 7 == 0, 1).otherwise(0)), name(key), refers, F.array(key + 1, key)).alias("valid"))


@query("scl_22_strip_frontmatter", "SELECT doc_id, sha256(CASE doc_id % 3 WHEN 2 THEN 'head' || chr(10) || '---' || chr(10) || 'x: y' || chr(10) || '---' || chr(10) || text ELSE text END) AS body_hash FROM documents")
def _(spark, d):
    # front matter with either line end, or a rule in the middle, which stays
    front = F.when(F.col("doc_id") % 3 == 0, "---\ntitle: a\nsource: b\n---\n").when(F.col("doc_id") % 3 == 1, "---\r\ntitle: a\r\n---\r\n").otherwise("head\n---\nx: y\n---\n")
    return Tables(spark, d).documents.select("doc_id", F.sha2(T.strip_frontmatter(F.concat(front, "text")), 256).alias("body_hash"))


@query("scl_26_section_kind", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'usage' WHEN 1 THEN 'diagnostic' WHEN 2 THEN 'boundary' WHEN 3 THEN 'procedure' WHEN 4 THEN 'ignored' ELSE 'detail' END AS kind FROM part")
def _(spark, d):
    heads = F.array(*map(F.lit, ("Overview of ", "FAQ: ", "Limits of ", "配置 ", "Revision of ", "About ")))
    heading = F.concat(F.element_at(heads, (F.col("p_partkey") % 6 + 1).cast("int")), F.col("p_partkey").cast("string"))
    return Tables(spark, d).part.select("p_partkey", T.section_kind(heading).alias("kind"))


@query("flt_12_reader_leaks", r"""WITH x AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' source_id: doc' WHEN 1 THEN ' sha256:' || substr(sha256(text), 1, 20) WHEN 2 THEN ' Source ID 12' ELSE ' source_id: ' || substr(sha256(text), 1, 16) END AS text FROM documents)
SELECT doc_id, 'INTERNAL_FIELD' AS code FROM x WHERE contains(text, 'source_id:') UNION ALL SELECT doc_id, 'HASH_OR_INTERNAL_METADATA' FROM x WHERE regexp_matches(text, '(?i)(?:sha256|content[_-]?fingerprint|digest[_-]?topic|source[_-]?id)\s*[:=]?[`''"]?[0-9a-f]{16,}')""")
def _(spark, d):
    h = F.sha2("text", 256)
    k = F.col("doc_id") % 4
    tail = F.when(k == 0, F.lit(" source_id: doc")).when(k == 1, F.concat(F.lit(" sha256:"), F.substring(h, 1, 20))).when(k == 2, F.lit(" Source ID 12")).otherwise(F.concat(F.lit(" source_id: "), F.substring(h, 1, 16)))
    return G.reader_leaks(Tables(spark, d).documents.select("doc_id", F.concat("text", tail).alias("text")), "doc_id", "text")


@query("flt_13_sensitive_lines", f"WITH {CLAIMS}, x AS (SELECT DISTINCT doc_id, claim FROM claims WHERE length(claim) >= 12), c AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM documents WHERE lang = 'en') SELECT doc_id, count(*) AS n_lines FROM x WHERE claim IN (SELECT line FROM c) GROUP BY doc_id")
def _(spark, d):
    # the protected corpus is the English one
    t = Tables(spark, d)
    return G.sensitive_lines(t.claims(), t.documents.where("lang = 'en'").select(F.explode(F.split("text", "\n", -1)).alias("line")))


@query("gte_09_trust_signals", f"WITH {SOURCES} SELECT source, count(*) AS n, count(*) FILTER (doc_id % 10 = 0) AS drifted FROM src GROUP BY 1")
def _(spark, d):
    # every tenth source was captured before its last sentence was added
    s = Tables(spark, d).sources()
    captured = F.sha2(F.concat("text", F.when(F.col("doc_id") % 10 == 0, "x").otherwise("")), 256)
    return s.groupBy("source").agg(F.count("*").alias("n"), F.count_if(captured != F.col("content_hash")).alias("drifted"))


@query("gte_07_source_index_valid", r"SELECT x AS url, count(*) AS n FROM (SELECT CASE WHEN page_id % 50 = 7 THEN regexp_replace(url, '^[a-z]+', 'ftp') WHEN page_id % 50 = 8 THEN regexp_extract(url, '^[^:]*://[^/?#]*', 0) ELSE url END AS x FROM pages) GROUP BY 1 HAVING count(*) > 1 OR NOT bool_and(starts_with(x, 'http'))")
def _(spark, d):
    k = F.col("page_id") % 50
    url = F.when(k == 7, F.regexp_replace("url", "^[a-z]+", "ftp")).when(k == 8, F.regexp_extract("url", "^[^:]*://[^/?#]*", 0)).otherwise(F.col("url"))
    return Tables(spark, d).pages.select(url.alias("url")).groupBy("url").agg(F.count("*").alias("n"), F.bool_and(F.col("url").startswith("http")).alias("ok")).where("n > 1 OR NOT ok").select("url", "n")


@query("lay_04_evidence_lines", "SELECT conv_id, text AS evidence FROM conversations WHERE turn = 1")
def _(spark, d):
    # the section of one turn out of a page that holds them all
    section = F.regexp_extract(F.concat("md", F.lit("\n## ")), r"(?s)\n## [a-z]+ 1\n(.*?)\n## ", 1)
    return markdown(Tables(spark, d)).where(F.col("md").rlike(r"\n## [a-z]+ 1\n")).select("conv_id", section.alias("evidence"))


@query("lay_06_split_pages", f"""WITH RECURSIVE {MD_SQL}, l AS (SELECT conv_id, generate_subscripts(string_split(md, chr(10)), 1) AS p, unnest(string_split(md, chr(10))) AS line FROM md),
s AS (SELECT *, sum(CAST(regexp_matches(line, '^#{{1,6}}\\s+') AS INT)) OVER (PARTITION BY conv_id ORDER BY p) AS sec FROM l), c AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, sec ORDER BY p) - 1) // 6 AS chunk FROM s),
u AS (SELECT conv_id, min(p) AS a, max(p) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY min(p)) AS n FROM c GROUP BY conv_id, sec, chunk),
k AS (SELECT conv_id, n, a, b, 1 AS page, b - a + 1 AS run FROM u WHERE n = 1 UNION ALL SELECT u.conv_id, u.n, u.a, u.b, CASE WHEN k.run + u.b - u.a + 1 > 6 THEN k.page + 1 ELSE k.page END, CASE WHEN k.run + u.b - u.a + 1 > 6 THEN u.b - u.a + 1 ELSE k.run + u.b - u.a + 1 END FROM k JOIN u ON u.conv_id = k.conv_id AND u.n = k.n + 1)
SELECT conv_id, page, min(a) AS line_start, max(b) AS line_end FROM k GROUP BY ALL""")
def _(spark, d):
    return S.split_pages(markdown(Tables(spark, d)), "conv_id", "md", 6)


@query("lay_06_split_documents", "WITH n AS (SELECT doc_id, len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS n FROM documents) SELECT doc_id, CAST(i AS INTEGER) AS page, (i - 1) * 10 + 1 AS line_start, least(i * 10, n) AS line_end FROM n, unnest(range(1, (n - 1) // 10 + 2)) t(i)")
def _(spark, d):
    return S.split_pages(Tables(spark, d).documents, "doc_id", "text", 10)


@query("set_01_manifest_difference", "WITH f AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), p AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') SELECT DISTINCT k, 'missing' AS side FROM f WHERE k NOT IN (SELECT k FROM p) UNION ALL SELECT DISTINCT k, 'extra' FROM p WHERE k NOT IN (SELECT k FROM f)")
def _(spark, d):
    # declared: customers with closed orders; found: customers with orders in part
    by = lambda status: Tables(spark, d).orders.where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("k"))
    return R.set_difference(by("F"), by("P"), "k")


@query("set_05_symmetric_difference", "WITH a AS (SELECT user_id, event_type FROM events WHERE value < 5), b AS (SELECT user_id, event_type FROM events WHERE value >= 5) SELECT user_id, event_type FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION (SELECT * FROM b EXCEPT SELECT * FROM a))")
def _(spark, d):
    e = Tables(spark, d).events.withColumn("k", F.struct("user_id", "event_type"))
    return R.set_difference(e.where("value < 5").select("k"), e.where("value >= 5").select("k"), "k").select("k.user_id", "k.event_type")


@query("grf_11_path_relations", "WITH m AS (SELECT DISTINCT p_name AS old_path, p_brand || ' ' || p_size AS new_path FROM part), a AS (SELECT old_path, count(*) AS nn FROM m GROUP BY 1), b AS (SELECT new_path, count(*) AS no FROM m GROUP BY 1) SELECT old_path, new_path, CASE WHEN nn > 1 AND no > 1 THEN 'split_merge' WHEN nn > 1 THEN 'split' WHEN no > 1 THEN 'merge' ELSE 'rename' END AS relation FROM m JOIN a USING (old_path) JOIN b USING (new_path)")
def _(spark, d):
    m = Tables(spark, d).part.select(F.col("p_name").alias("old_path"), F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("new_path"))
    return graph.path_relations(m, "old_path", "new_path")
