"""Validators, gates and second-tier operators over ledgers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import ledger as R
from lexmill.plans.base import CLAIMS, Tables, query


@query("gte_01_candidate_gate", "SELECT l_orderkey, CASE WHEN max(l_discount) > 0.09 THEN 'lineage' WHEN count(*) < 3 THEN 'coverage' WHEN bool_or(l_tax = 0) THEN 'faithfulness' ELSE 'passed' END AS reason FROM lineitem GROUP BY 1")
def _(spark, d):
    g = Tables(spark, d).lineitem.groupBy("l_orderkey").agg(F.max("l_discount").alias("x"), F.count("*").alias("n"), F.bool_or(F.col("l_tax") == 0).alias("z"))
    return g.select("l_orderkey", F.when(F.col("x") > 0.09, "lineage").when(F.col("n") < 3, "coverage").when(F.col("z"), "faithfulness").otherwise("passed").alias("reason"))


@query("gte_05_topic_index_valid", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1 OR bool_or(p_brand IS NULL)")
def _(spark, d):
    return Tables(spark, d).part.groupBy("p_name").agg(F.count("*").alias("n"), F.bool_or(F.col("p_brand").isNull()).alias("b")).where("n > 1 OR b").select("p_name", "n")


@query("gte_06_index_migration", "SELECT p_partkey, '2.0' AS schema_version, lower(p_type) AS knowledge_type, CASE WHEN p_size >= 5 THEN p_brand END AS module FROM part")
def _(spark, d):
    return Tables(spark, d).part.select("p_partkey", F.lit("2.0").alias("schema_version"), F.lower("p_type").alias("knowledge_type"), F.when(F.col("p_size") >= 5, F.col("p_brand")).alias("module"))


@query("gte_08_semantic_evidence", "SELECT doc_id, array_to_string(list_filter([CASE WHEN quality = 0 THEN 'LOW_QUALITY' END, CASE WHEN toxic = 1 THEN 'TOXIC' END], lambda x: x IS NOT NULL), ',') AS codes FROM labels")
def _(spark, d):
    codes = F.array_compact(F.array(F.when(F.col("quality") == 0, "LOW_QUALITY"), F.when(F.col("toxic") == 1, "TOXIC")))
    return Tables(spark, d).labels.select("doc_id", F.array_join(codes, ",").alias("codes"))


@query("gte_12_release_decision", "SELECT source, CASE WHEN bool_or(toxic = 1) THEN 'blocked' WHEN avg(quality) < 0.9 THEN 'review' ELSE 'release' END AS decision FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def _(spark, d):
    t = Tables(spark, d)
    g = t.documents.select("doc_id", "source").join(t.labels, "doc_id").groupBy("source").agg(F.bool_or(F.col("toxic") == 1).alias("t"), F.avg("quality").alias("q"))
    return g.select("source", F.when(F.col("t"), "blocked").when(F.col("q") < 0.9, "review").otherwise("release").alias("decision"))


@query("gte_20_artifact_valid", "SELECT doc_id, regexp_matches(sha256(text), '^[0-9a-f]{64}$') AND source LIKE 'src%' AS valid FROM documents")
def _(spark, d):
    return Tables(spark, d).documents.select("doc_id", (F.sha2("text", 256).rlike("^[0-9a-f]{64}$") & F.col("source").startswith("src")).alias("valid"))


@query("ext_02_pending_merge", "WITH r AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), x AS (SELECT user_id, event_id, value FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM r) UNION ALL SELECT user_id, event_id, value FROM events WHERE event_type = 'view') SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM x GROUP BY 1")
def _(spark, d):
    e = Tables(spark, d).events.select("user_id", "event_id", "value", "event_type")
    part = lambda k: e.where(F.col("event_type") == k).drop("event_type")
    return R.pending_merge(part("error"), part("view"), part("purchase").select("user_id"), ["user_id"], "event_id")


@query("ext_07_growth_audit", "SELECT event_type, count(*) - 50 AS growth, CASE WHEN count(*) - 50 > 100 THEN 'over_budget' ELSE 'within' END AS status FROM events GROUP BY 1")
def _(spark, d):
    g = Tables(spark, d).events.groupBy("event_type").agg((F.count("*") - 50).alias("growth"))
    return g.withColumn("status", F.when(F.col("growth") > 100, "over_budget").otherwise("within"))


@query("ext_09_section_reuse", "SELECT a.l_orderkey, a.l_linenumber, coalesce(b.l_quantity, a.l_quantity) AS body FROM lineitem a LEFT JOIN (SELECT l_orderkey, l_linenumber + 1 AS n, max(l_quantity) AS l_quantity FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.n")
def _(spark, d):
    li = Tables(spark, d).lineitem
    old = li.where("l_returnflag = 'A'").groupBy("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber")).agg(F.max("l_quantity").alias("q"))
    return li.join(old, ["l_orderkey", "l_linenumber"], "left").select("l_orderkey", "l_linenumber", F.coalesce("q", "l_quantity").alias("body"))


@query("ext_10_gate_payload", f"WITH {CLAIMS} SELECT claim, min(doc_id) AS doc_id FROM claims GROUP BY claim")
def _(spark, d):
    return Tables(spark, d).claims().groupBy("claim").agg(F.min("doc_id").alias("doc_id"))


@query("ext_12_page_shell", "SELECT p_name, count(DISTINCT p_size) AS n_versions, CASE WHEN count(DISTINCT p_size) > 1 THEN 'degraded' ELSE 'draft' END AS status FROM part GROUP BY 1")
def _(spark, d):
    g = Tables(spark, d).part.groupBy("p_name").agg(F.count_distinct("p_size").alias("n_versions"))
    return g.withColumn("status", F.when(F.col("n_versions") > 1, "degraded").otherwise("draft"))


@query("ext_14_merge_responses", "SELECT conv_id, role, sha256(string_agg(text, chr(10) ORDER BY turn)) AS body FROM conversations GROUP BY ALL")
def _(spark, d):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return Tables(spark, d).conversations.groupBy("conv_id", "role").agg(F.sha2(F.array_join(parts, "\n"), 256).alias("body"))


@query("ext_15_summary_repair", r"SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(regexp_replace(text, '[À-ÖØ-öø-ÿ]', 'a', 'g'), '\b([A-Z][A-Z0-9_-]{2,})\b', 1))) AS INTEGER) AS n_missing FROM documents")
def _(spark, d):
    return Tables(spark, d).documents.select("doc_id", F.size(F.array_except(T.identifiers("text"), F.array().cast("array<string>"))).alias("n_missing"))


@query("ext_17_round_record", "SELECT l_orderkey, round(sum(l_discount) / count(*), 6) AS coverage_ratio, round(sum(l_tax) / count(*), 6) AS retained_ratio, count(*) FILTER (l_tax = 0) AS unsupported FROM lineitem GROUP BY 1")
def _(spark, d):
    return Tables(spark, d).lineitem.groupBy("l_orderkey").agg(F.round(F.sum("l_discount") / F.count("*"), 6).alias("coverage_ratio"), F.round(F.sum("l_tax") / F.count("*"), 6).alias("retained_ratio"), F.count_if(F.col("l_tax") == 0).alias("unsupported"))


@query("ext_22_manifest_hash", "SELECT o_custkey, sha256(string_agg('{\"k\":' || o_orderkey || ',\"s\":\"' || o_orderstatus || '\"}', ',' ORDER BY o_orderkey)) AS h FROM orders GROUP BY 1")
def _(spark, d):
    row = F.struct("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))).alias("j"))
    return Tables(spark, d).orders.groupBy("o_custkey").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["j"]), ","), 256).alias("h"))


@query("ext_24_product_pages", "SELECT p_type, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS modules, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS pages FROM part GROUP BY 1")
def _(spark, d):
    join = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return Tables(spark, d).part.groupBy("p_type").agg(join("p_brand").alias("modules"), join("p_name").alias("pages"))


@query("ext_26_nested_sections", "SELECT a.o_orderkey, (SELECT min(b.o_orderkey) FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey > a.o_orderkey AND b.o_orderpriority <= a.o_orderpriority) AS stop FROM orders a")
def _(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(1, Window.unboundedFollowing)
    later = F.collect_list(F.struct("o_orderkey", "o_orderpriority")).over(w)
    stop = F.array_min(F.transform(F.filter(later, lambda x: x["o_orderpriority"] <= F.col("o_orderpriority")), lambda x: x["o_orderkey"]))
    return Tables(spark, d).orders.select("o_orderkey", stop.alias("stop"))


@query("ext_27_reader_pages", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0")
def _(spark, d):
    t = Tables(spark, d)
    return t.documents.select("doc_id").join(t.labels.where("quality = 1 AND toxic = 0"), "doc_id", "left_semi")


@query("ext_38_attribution", "SELECT l_suppkey AS k, 'missing' AS side FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity >= 49 EXCEPT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) UNION ALL SELECT s_suppkey, 'extra' FROM (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 EXCEPT SELECT l_suppkey FROM lineitem WHERE l_quantity >= 49)")
def _(spark, d):
    t = Tables(spark, d)
    return R.set_difference(t.lineitem.where("l_quantity >= 49").select(F.col("l_suppkey").alias("k")), t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("k")), "k")


@query("ext_49_expanded_pages", "SELECT conv_id, CAST(i - 1 AS INTEGER) AS pos, CASE i WHEN 1 THEN role ELSE 'turn-' || turn END AS target FROM conversations, range(1, 3) t(i)")
def _(spark, d):
    targets = F.array("role", F.concat(F.lit("turn-"), F.col("turn").cast("string")))
    return Tables(spark, d).conversations.select("conv_id", F.posexplode(targets).alias("pos", "target"))


@query("ext_50_incoming_entries", f"WITH {CLAIMS} SELECT doc_id, claim, min(line_no) AS line_no FROM claims WHERE claim NOT IN (SELECT unnest(string_split(text, chr(10))) FROM benchmark) GROUP BY ALL")
def _(spark, d):
    t = Tables(spark, d)
    old = t.benchmark.select(F.explode(F.split("text", "\n", -1)).alias("claim")).distinct()
    return t.claims().join(old, "claim", "left_anti").groupBy("doc_id", "claim").agg(F.min("line_no").alias("line_no"))


@query("ext_51_protect_old", "SELECT p_partkey, CASE WHEN p_size >= 10 THEN p_name ELSE p_brand END AS page FROM part")
def _(spark, d):
    ok = F.when(F.col("p_size") >= 10, F.col("p_name"))
    return Tables(spark, d).part.select("p_partkey", F.coalesce(ok, "p_brand").alias("page"))


@query("ext_52_over_limit", "SELECT doc_id, length(text) > 9000 AS diverted, CASE WHEN length(text) <= 9000 THEN (row_number() OVER (PARTITION BY source, length(text) > 9000 ORDER BY doc_id) - 1) // 4 END AS batch FROM documents")
def _(spark, d):
    big = F.char_length("text") > 9000
    n = F.row_number().over(Window.partitionBy("source", big).orderBy("doc_id"))
    return Tables(spark, d).documents.select("doc_id", big.alias("diverted"), F.when(~big, F.floor((n - 1) / 4).cast("long")).alias("batch"))


@query("ext_60_memory_receipt", "SELECT count(*) FILTER (s_suppkey IS NOT NULL) AS valid, count(*) FILTER (s_suppkey IS NULL) AS invalid FROM (SELECT DISTINCT c_custkey FROM customer) LEFT JOIN supplier ON s_suppkey = c_custkey")
def _(spark, d):
    t = Tables(spark, d)
    j = t.customer.select("c_custkey").distinct().join(t.supplier, F.col("s_suppkey") == F.col("c_custkey"), "left")
    return j.agg(F.count_if(F.col("s_suppkey").isNotNull()).alias("valid"), F.count_if(F.col("s_suppkey").isNull()).alias("invalid"))
