"""Sources, manifests and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.plans.base import SOURCES, Tables, query
from lexmill.sources import files as S
from lexmill.sources import merkle as M
from lexmill.sources import sinks as K


@query("src_01_scan", f"WITH {SOURCES} SELECT path, length(text) AS n_chars FROM src WHERE source NOT IN ('src3', 'src4')")
def _(spark, d):
    s = Tables(spark, d).sources()
    allowed = s.where("source NOT IN ('src3', 'src4')").select("path")
    return s.join(allowed, "path", "left_semi").select("path", F.char_length("text").cast("long").alias("n_chars"))


@query("src_03_declaration_lookup", "SELECT DISTINCT key FROM (SELECT 'items/' || url AS key FROM pages UNION ALL SELECT url FROM pages UNION ALL SELECT regexp_replace(url, '^.*/', '') FROM pages)")
def _(spark, d):
    variants = F.array("p", F.regexp_replace("p", "^items/", ""), F.regexp_replace("p", "^.*/", ""))
    return Tables(spark, d).pages.select(F.concat(F.lit("items/"), "url").alias("p")).select(F.explode(variants).alias("key")).distinct()


@query("src_04_declaration_attach", f"WITH {SOURCES} SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN uri WHEN source = 'src2' THEN uri END AS declared FROM src")
def _(spark, d):
    s = Tables(spark, d).sources()
    declared = s.where("source IN ('src0', 'src1')").select(F.col("path").alias("content_path"), "uri", F.lit(1).alias("seq")).unionByName(s.where("source = 'src2'").select(F.regexp_replace("path", "^.*/", "").alias("content_path"), "uri", F.lit(2).alias("seq")))
    return S.declared_sources(s.select("doc_id", "path"), declared).select("doc_id", F.col("uri").alias("declared"))


@query("src_05_fixed_manifest", "SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'undeclared' ELSE 'declared' END AS state FROM documents LEFT JOIN labels l USING (doc_id)")
def _(spark, d):
    t = Tables(spark, d)
    return t.documents.select("doc_id").join(t.labels.select("doc_id", F.lit(True).alias("x")), "doc_id", "left").select("doc_id", F.when(F.col("x"), "declared").otherwise("undeclared").alias("state"))


@query("src_06_input_manifest", f"WITH {SOURCES}, f AS (SELECT content_hash, min(path) AS first FROM src GROUP BY 1) SELECT source, sha256(string_agg(s.path || '|' || s.content_hash || '|' || f.first, chr(10) ORDER BY s.path || '|' || s.content_hash || '|' || f.first)) AS manifest_hash FROM src s JOIN f ON f.content_hash = s.content_hash GROUP BY source")
def _(spark, d):
    s = Tables(spark, d).sources()
    rows = s.join(s.groupBy("content_hash").agg(F.min("path").alias("first")), "content_hash")
    return rows.groupBy("source").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws("|", "path", "content_hash", "first"))), "\n"), 256).alias("manifest_hash"))


@query("src_07_inventory", f"WITH {SOURCES} SELECT doc_id, 'source-' || substr(sha256(uri), 1, 20) AS source_id, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines, contains(text, '|') AS has_table FROM src")
def _(spark, d):
    from lexmill.functions import text as T

    return Tables(spark, d).sources().select("doc_id", T.source_id("uri").alias("source_id"), F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.contains("text", F.lit("|")).alias("has_table"))


TREE_SQL = "e AS (SELECT substr(sha256(path), 1, 2) AS shelf, path || ':' || content_hash{0} AS entry FROM src{1}), s AS (SELECT shelf, sha256(string_agg(entry, chr(10) ORDER BY entry)) AS h FROM e GROUP BY 1) SELECT sha256(string_agg(h, chr(10) ORDER BY shelf)) AS tree_hash FROM s"


@query("src_08_tree_manifest", f"WITH {SOURCES}, " + TREE_SQL.format(" || ':' || length(text)", ""))
def _(spark, d):
    return S.tree_hash(Tables(spark, d).sources().withColumn("size", F.char_length("text")), size="size")


@query("src_09_baseline_tree", f"WITH {SOURCES}, " + TREE_SQL.format("", " WHERE NOT starts_with(source, 'src1')"))
def _(spark, d):
    return S.tree_hash(Tables(spark, d).sources().where("NOT startswith(source, 'src1')"))


@query("ext_31_snapshot_hash", f"WITH {SOURCES}, " + TREE_SQL.format("", ""))
def _(spark, d):
    return S.tree_hash(Tables(spark, d).sources())


@query("src_10_copy_proof", "SELECT 0::BIGINT AS missing, count(*) AS added FROM events WHERE event_type = 'error'")
def _(spark, d):
    from lexmill.operators.ledger import multiset_difference

    e = Tables(spark, d).events.select("event_id", "event_type")
    copy = e.unionByName(e.where("event_type = 'error'"))
    lost, more = multiset_difference(e, copy), multiset_difference(copy, e)
    n = lambda df, name: df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))
    return n(lost, "missing").crossJoin(n(more, "added"))


@query("src_12_managed_pages", "SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS topic FROM pages WHERE regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) <> ''")
def _(spark, d):
    topic = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    return Tables(spark, d).pages.select("page_id", topic.alias("topic")).where("topic <> ''")


@query("src_13_page_records", "SELECT page_id, sha256(html) AS content_hash, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def _(spark, d):
    return Tables(spark, d).pages.select("page_id", F.sha2("html", 256).alias("content_hash"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("src_14_captured_failures", "SELECT event_id, TRY_CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS INTEGER) AS k, TRY_CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS INTEGER) IS NULL AS failed FROM events")
def _(spark, d):
    k = F.from_json("props", "k int")["k"]
    return Tables(spark, d).events.select("event_id", k.alias("k"), k.isNull().alias("failed"))


@query("src_16_candidate_load", "WITH x AS (SELECT o_orderkey, unnest([o_orderstatus, o_orderpriority]) AS uri FROM orders) SELECT uri, min(o_orderkey) AS o_orderkey FROM x GROUP BY uri")
def _(spark, d):
    return S.first_per_uri(Tables(spark, d).orders.withColumn("sources", F.array("o_orderstatus", "o_orderpriority")), "sources", "o_orderkey")


@query("src_17_table_parse", "SELECT p_partkey, p_name AS a, p_brand || '|' || p_type AS b FROM part")
def _(spark, d):
    table = F.concat(F.lit("| x | y |\n| --- | --- |\n| "), "p_name", F.lit(" | "), "p_brand", F.lit("\\|"), "p_type", F.lit(" |"))
    rows = S.parse_table(Tables(spark, d).part.select("p_partkey", table.alias("t")), "t", "p_partkey").where("row = 2")
    return rows.select("p_partkey", F.col("cells")[0].alias("a"), F.col("cells")[1].alias("b"))


@query("src_19_fenced_json", "SELECT event_id, CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS INTEGER) AS k FROM events")
def _(spark, d):
    doc = F.concat(F.lit("# Registry\n```json\n"), "props", F.lit("\n```\n"))
    return Tables(spark, d).events.select("event_id", F.from_json(F.regexp_extract(doc, r"(?s)```json\n(.*?)\n```", 1), "k int")["k"].alias("k"))


@query("src_22_memory_upsert", "SELECT DISTINCT event_type || '/' || user_id AS identity FROM events WHERE event_type || '/' || user_id NOT IN (SELECT event_type || '/' || user_id FROM events WHERE value > 50)")
def _(spark, d):
    e = Tables(spark, d).events.withColumn("identity", F.concat_ws("/", "event_type", F.col("user_id").cast("string")))
    return K.remember(e, e.where("value > 50")).select("identity")


@query("snk_04_ledger_upsert", "SELECT user_id, arg_max(event_type, event_id) AS event_type, min(event_id) AS first_seq FROM events GROUP BY user_id")
def _(spark, d):
    from lexmill.operators.ledger import upsert

    e = Tables(spark, d).events.select("user_id", "event_id", "event_type")
    return upsert(e.where("event_type = 'error'"), e.where("event_type <> 'error'"), ["user_id"], "event_id").select("user_id", "event_type", "first_seq")


@query("snk_05_queue_upsert", "SELECT user_id || ': ' || arg_max(event_type, event_id) AS entry FROM events GROUP BY user_id")
def _(spark, d):
    from lexmill.operators.dedup import latest_by_key

    return K.queue_lines(latest_by_key(Tables(spark, d).events, ["user_id"], "event_id"), "user_id", "event_type")


@query("snk_06_writeback_plan", "SELECT l_partkey AS target, count(*) AS n_drafts, CASE WHEN p_size > 25 THEN 'revise' ELSE 'new' END AS action FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 3")
def _(spark, d):
    t = Tables(spark, d)
    n = t.lineitem.groupBy(F.col("l_partkey").alias("target")).agg(F.count("*").alias("n_drafts"))
    return n.join(t.part, F.col("p_partkey") == F.col("target")).select("target", "n_drafts", F.when(F.col("p_size") > 25, "revise").otherwise("new").alias("action"))


@query("snk_07_archive_claims", "SELECT event_id, 'remove' AS operation, 'stale' AS reason, 'run-1' AS run_id FROM events WHERE event_type = 'error'")
def _(spark, d):
    rows = Tables(spark, d).events.where("event_type = 'error'").select("event_id", "value")
    return K.archive_rows(rows, operation="remove", reason="stale", run_id="run-1").select("claim.event_id", "operation", "reason", "run_id")


@query("snk_08_archive_pages", "SELECT l_partkey, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS sources, max(l_quantity) AS before_size FROM lineitem GROUP BY 1")
def _(spark, d):
    return Tables(spark, d).lineitem.groupBy("l_partkey").agg(F.array_join(F.sort_array(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("sources"), F.max("l_quantity").alias("before_size"))


@query("snk_10_render_index", "SELECT page_id, '| ' || replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '|', '\\|') || ' | [open](' || url || ') |' AS line FROM pages")
def _(spark, d):
    title = F.replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("|"), F.lit("\\|"))
    return Tables(spark, d).pages.select("page_id", F.concat(F.lit("| "), title, F.lit(" | [open]("), "url", F.lit(") |")).alias("line"))


@query("ext_06_write_plan", "WITH t AS (SELECT DISTINCT unnest([l_partkey, l_suppkey]) AS k FROM lineitem) SELECT k AS target, CASE WHEN s_suppkey IS NULL THEN 'new' ELSE 'revise' END AS action, s_suppkey IS NOT NULL AS archive_required FROM t LEFT JOIN supplier ON s_suppkey = k")
def _(spark, d):
    t = Tables(spark, d)
    return K.write_plan(t.lineitem.select(F.array("l_partkey", "l_suppkey").alias("targets")), "targets", t.supplier.select(F.col("s_suppkey").alias("path")))


@query("gte_16_source_freeze", f"WITH {SOURCES}, f AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'x' ELSE content_hash END AS frozen FROM src) SELECT s.doc_id, 'hash_drift' AS code FROM src s JOIN f ON f.doc_id = s.doc_id WHERE frozen <> content_hash")
def _(spark, d):
    t = Tables(spark, d)
    toxic = t.labels.where("toxic = 1").select("doc_id", F.lit("x").alias("x"))
    frozen = t.sources().join(toxic, "doc_id", "left").withColumn("frozen", F.coalesce("x", "content_hash"))
    return frozen.where("frozen <> content_hash").select("doc_id", F.lit("hash_drift").alias("code"))


@query("gte_17_claim_evidence", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS evidence FROM documents WHERE len(string_split(text, chr(10))) >= 2")
def _(spark, d):
    parts = F.split("text", "\n", -1)
    return Tables(spark, d).documents.where(F.size(parts) >= 2).select("doc_id", F.array_join(F.slice(parts, 2, 3), "\n").alias("evidence"))


#: A tree of hashes over all sources, as deep as their number asks for, and the same by source.
MERKLE_SQL = """dep AS (SELECT CASE WHEN count(*) <= 4096 THEN 1 WHEN count(*) <= 65536 THEN 2 WHEN count(*) <= 1048576 THEN 3 ELSE 4 END AS depth FROM src),
lf AS (SELECT {g}, substr(sha256(path), 1, (SELECT depth FROM dep)) AS prefix, sha256(string_agg(path || '|' || content_hash, chr(10) ORDER BY path || '|' || content_hash)) AS hash, count(*) AS n FROM src GROUP BY ALL),
up AS (SELECT {g}, (SELECT depth FROM dep) AS level, prefix, hash, n FROM lf UNION ALL
  SELECT * FROM (SELECT {g}, level - 1 AS level, substr(prefix, 1, level - 1) AS prefix, sha256(string_agg(prefix || ':' || hash, chr(10) ORDER BY prefix)) AS hash, CAST(sum(n) AS BIGINT) AS n FROM up WHERE level > 0 GROUP BY ALL))"""


@query("src_08_hash_tree", f"WITH RECURSIVE {SOURCES}, {MERKLE_SQL.format(g='1 AS one')} SELECT CAST(level AS INTEGER) AS level, prefix, hash, n FROM up")
def _(spark, d):
    s = Tables(spark, d).sources()
    return M.hash_tree(M.entries(s, "path", ["content_hash"]), M.depth_for(s.count()))


@query("src_06_manifest_roots", f"WITH RECURSIVE {SOURCES}, {MERKLE_SQL.format(g='source')} SELECT source, hash, n FROM up WHERE level = 0")
def _(spark, d):
    s = Tables(spark, d).sources()
    return M.roots(M.hash_tree(M.entries(s, "path", ["content_hash"], ["source"]), M.depth_for(s.count()), ["source"]), ["source"])


@query("src_08_changed_paths", f"WITH {SOURCES} SELECT path, CASE doc_id % 100 WHEN 7 THEN 'changed' WHEN 13 THEN 'removed' ELSE 'added' END AS change FROM src WHERE doc_id % 100 IN (7, 13, 17)")
def _(spark, d):
    # since the first manifest, some sources were edited, some taken away, and some are new
    s = Tables(spark, d).sources()
    k = F.col("doc_id") % 100
    old = s.where(k != 17)
    new = s.where(k != 13).withColumn("content_hash", F.when(k == 7, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.col("content_hash")))
    return M.changed_paths(M.entries(old, "path", ["content_hash"]), M.entries(new, "path", ["content_hash"]), M.depth_for(s.count()))[0]
