"""Aggregation, de-duplication and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import calibrate as C
from lexmill.operators import dedup as D
from lexmill.operators import ledger as R
from lexmill.operators.quantiles import exact_quantiles
from lexmill.plans.base import CLAIMS, SOURCES, Tables, query

#: Cases: each vector's first component as a score, its label's parity as the class.
CASES_SQL = "cases AS (SELECT vec_id, label, label % 2 = 0 AS positive, CAST(embedding[1] AS DOUBLE) AS score, embedding[2] > 0 AS predicted, embedding[3] > 0 AS baseline, CASE WHEN vec_id % 3 = 0 THEN 'holdout' ELSE 'calibration' END AS split FROM embeddings)"


def cases(t: Tables):
    e = F.col("embedding")
    return t.embeddings.select("vec_id", "label", (F.col("label") % 2 == 0).alias("positive"), e[0].cast("double").alias("score"), (e[1] > 0).alias("predicted"), (e[2] > 0).alias("baseline"), F.when(F.col("vec_id") % 3 == 0, "holdout").otherwise("calibration").alias("split"))


@query("agg_01_exact_dedup", f"WITH {SOURCES}, k AS (SELECT doc_id, path, min(path) OVER (PARTITION BY content_hash) AS duplicate_of FROM src) SELECT doc_id, duplicate_of FROM k WHERE path <> duplicate_of")
def _(spark, d):
    return D.duplicates(Tables(spark, d).sources()).select("doc_id", "duplicate_of")


@query("agg_02_uri_conflicts", "SELECT source AS uri, count(DISTINCT sha256(text)) AS n_contents FROM documents GROUP BY 1 HAVING count(DISTINCT sha256(text)) > 1")
def _(spark, d):
    return D.uri_conflicts(Tables(spark, d).sources().select(F.col("source").alias("uri"), "content_hash"))


@query("agg_03_claim_dedup", f"WITH {CLAIMS} SELECT doc_id, uri, claim, min(line_no) AS line_no FROM claims GROUP BY ALL")
def _(spark, d):
    return D.first_by_key(Tables(spark, d).claims(), ["doc_id", "uri", "claim"], "line_no").select("doc_id", "uri", "claim", "line_no")


@query("agg_04_claim_merge", "SELECT user_id, arg_max(event_type, event_id) FILTER (event_type <> 'error') AS event_type, arg_max(value, event_id) FILTER (value > 10) AS value, min(event_id) AS first_seq FROM events GROUP BY user_id")
def _(spark, d):
    e = Tables(spark, d).events.withColumns({"event_type": F.when(F.col("event_type") != "error", F.col("event_type")), "value": F.when(F.col("value") > 10, F.col("value"))})
    first = e.groupBy("user_id").agg(F.min("event_id").alias("first_seq"))
    return R.fold_latest(e, ["user_id"], "event_id", ["event_type", "value"]).join(first, "user_id")


@query("agg_05_fold_history", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def _(spark, d):
    return R.fold_latest(Tables(spark, d).events, ["user_id"], "event_id", ["event_type", "value"])


@query("agg_06_fold_layout", "SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def _(spark, d):
    return R.fold_latest(Tables(spark, d).orders, ["o_custkey"], "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("agg_07_topic_layout", "SELECT l_partkey, count(*) AS n_parts, CAST(sum(l_quantity) AS DOUBLE) AS n_lines, CAST(ceil(sum(l_quantity) / 300) AS BIGINT) AS n_pages FROM lineitem GROUP BY 1")
def _(spark, d):
    return Tables(spark, d).lineitem.groupBy("l_partkey").agg(F.count("*").alias("n_parts"), F.sum("l_quantity").alias("n_lines"), F.ceil(F.sum("l_quantity") / 300).alias("n_pages"))


@query("agg_08_topic_plan", "SELECT lower(p_type) AS product, p_brand AS module, p_name AS object, count(*) AS n_members, min(p_partkey) AS first_member, CASE WHEN count(*) = 1 THEN 'single' ELSE 'merge' END AS merge_mode FROM part GROUP BY ALL")
def _(spark, d):
    g = Tables(spark, d).part.groupBy(F.lower("p_type").alias("product"), F.col("p_brand").alias("module"), F.col("p_name").alias("object"))
    return g.agg(F.count("*").alias("n_members"), F.min("p_partkey").alias("first_member")).withColumn("merge_mode", F.when(F.col("n_members") == 1, "single").otherwise("merge"))


@query("agg_09_gazetteer", "SELECT lower(p_name) AS seed, arg_min(p_name, p_partkey) AS canonical, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS aliases, count(*) AS n_refs FROM part GROUP BY 1")
def _(spark, d):
    return Tables(spark, d).part.groupBy(F.lower("p_name").alias("seed")).agg(F.min_by("p_name", "p_partkey").alias("canonical"), F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("aliases"), F.count("*").alias("n_refs"))


@query("agg_10_type_registry", "SELECT p_type, count(DISTINCT p_brand) AS n_brands, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM part GROUP BY 1")
def _(spark, d):
    return Tables(spark, d).part.groupBy("p_type").agg(F.count_distinct("p_brand").alias("n_brands"), F.array_join(F.sort_array(F.collect_set("p_brand")), ",").alias("brands"))


@query("agg_11_run_metrics", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean_price, count(*) FILTER (o_orderstatus = 'F') AS n_final, round(count(*) FILTER (o_orderstatus = 'P') / count(*), 6) AS fallback_ratio, bool_or(o_totalprice > 499000) AS any_large FROM orders GROUP BY 1")
def _(spark, d):
    g = Tables(spark, d).orders.groupBy("o_orderpriority")
    s = F.col("o_orderstatus")
    return g.agg(F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.count_if(s == "F").alias("n_final"), F.round(F.count_if(s == "P") / F.count("*"), 6).alias("fallback_ratio"), F.bool_or(F.col("o_totalprice") > 499000).alias("any_large"))


@query("agg_12_cost_rollup", "WITH x AS (SELECT l_suppkey, CASE WHEN l_tax > 0 THEN l_quantity END AS calls, l_discount AS r, l_quantity AS w FROM lineitem) SELECT l_suppkey, CASE WHEN count(calls) = count(*) THEN sum(calls) END AS calls, round(sum(r * w) / sum(w), 6) AS fallback_ratio FROM x GROUP BY 1")
def _(spark, d):
    x = Tables(spark, d).lineitem.withColumn("calls", F.when(F.col("l_tax") > 0, F.col("l_quantity")))
    return x.groupBy("l_suppkey").agg(R.null_sum("calls").alias("calls"), F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("fallback_ratio"))


@query("agg_13_business_counts", "SELECT 'documents' AS ledger, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'events', count(*) FROM events")
def _(spark, d):
    t = Tables(spark, d)
    one = lambda name: getattr(t, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("ledger"), "n")
    return one("documents").unionByName(one("pages")).unionByName(one("events"))


@query("agg_14_coverage_audit", f"WITH {CASES_SQL}, g AS (SELECT * FROM (SELECT DISTINCT label FROM cases), (SELECT DISTINCT predicted FROM cases), (VALUES ('calibration'), ('holdout'), ('blind')) s(split)) SELECT label, predicted, split FROM g EXCEPT SELECT label, predicted, split FROM cases")
def _(spark, d):
    return C.missing_cells(cases(Tables(spark, d)), ["label", "predicted"], "split", ["calibration", "holdout", "blind"])


@query("agg_15_distribution", f"WITH {CASES_SQL} SELECT label, count(*) AS n, round(min(score), 6) AS min, round(max(score), 6) AS max, round(quantile_cont(score, 0.25), 6) AS p25, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.75), 6) AS p75 FROM cases GROUP BY label")
def _(spark, d):
    out = C.distribution(cases(Tables(spark, d)), ["label"], "score")
    return out.select("label", "n", *[F.round(c, 6).alias(c) for c in ("min", "max", "p25", "p50", "p75")])


@query("agg_16_quantile", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY 1")
def _(spark, d):
    return exact_quantiles(Tables(spark, d).orders, ["o_orderpriority"], "o_totalprice", [0.9]).select("o_orderpriority", F.round(F.col("q")[0], 4).alias("p90"))


@query("agg_17_separation", f"WITH {CASES_SQL}, e AS (SELECT split, min(score) FILTER (positive) AS a, max(score) FILTER (NOT positive) AS b FROM cases GROUP BY 1) SELECT split, count(*) FILTER ((positive AND score <= b) OR (NOT positive AND score >= a)) AS overlap_count, round(count(*) FILTER ((positive AND score <= b) OR (NOT positive AND score >= a)) / count(*), 6) AS overlap_rate, round(any_value(a) - any_value(b), 6) AS margin FROM cases JOIN e USING (split) GROUP BY split")
def _(spark, d):
    s = C.separation(cases(Tables(spark, d)), "split", "positive", "score")
    return s.select("split", "overlap_count", F.round("overlap_rate", 6).alias("overlap_rate"), F.round("margin", 6).alias("margin"))


METRICS_SQL = "m AS (SELECT label, count(*) FILTER (positive AND predicted) AS tp, count(*) FILTER (NOT positive AND predicted) AS fp, count(*) FILTER (positive AND NOT predicted) AS fn FROM (SELECT split AS label, positive, predicted FROM cases) GROUP BY 1)"


@query("agg_18_classification", f"WITH {CASES_SQL}, {METRICS_SQL} SELECT label AS split, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM m")
def _(spark, d):
    m = C.classification(cases(Tables(spark, d)), "split", "positive", "predicted")
    return m.select("split", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("agg_19_denominator_gaps", f"WITH {CASES_SQL}, m AS (SELECT label, count(*) FILTER (positive AND predicted) AS tp, count(*) FILTER (NOT positive AND predicted) AS fp, count(*) FILTER (positive AND NOT predicted) AS fn FROM cases GROUP BY 1) SELECT label, 'precision|predicted_positive' AS gap FROM m WHERE tp + fp = 0 UNION ALL SELECT label, 'recall|gold_positive' FROM m WHERE tp + fn = 0")
def _(spark, d):
    return C.denominator_gaps(C.classification(cases(Tables(spark, d)), "label", "positive", "predicted"), "label")


@query("agg_20_query_accuracy", "SELECT o_orderpriority, avg(CAST(lo AS INT)) AS accuracy, count(*) FILTER (lo <> hi) AS conflicts FROM (SELECT o_orderpriority, o_custkey, bool_and(o_orderstatus = 'F') AS lo, bool_or(o_orderstatus = 'F') AS hi FROM orders GROUP BY ALL) GROUP BY 1")
def _(spark, d):
    rows = Tables(spark, d).orders.withColumn("ok", F.col("o_orderstatus") == "F")
    return C.query_accuracy(rows, "o_orderpriority", "o_custkey", "ok")


@query("agg_21_thresholds", f"WITH {CASES_SQL}, s AS (SELECT quantile_cont(score, 0.5) FILTER (positive) AS high, (min(score) FILTER (positive) + max(score) FILTER (NOT positive)) / 2 AS mid FROM cases) SELECT round(high, 6) AS high, round(least(high, mid), 6) AS medium FROM s")
def _(spark, d):
    return C.thresholds(cases(Tables(spark, d)), "positive", "score").select(F.round("high", 6).alias("high"), F.round("medium", 6).alias("medium"))


@query("agg_22_tier_distribution", f"WITH {CASES_SQL} SELECT split, CASE WHEN score >= 0.1 THEN 'auto' WHEN score >= 0 THEN 'needs_review' ELSE 'insufficient_signal' END AS tier, count(DISTINCT label) AS n_clusters, count(*) AS n_pairs FROM cases GROUP BY ALL")
def _(spark, d):
    tier = F.when(F.col("score") >= 0.1, "auto").when(F.col("score") >= 0, "needs_review").otherwise("insufficient_signal")
    return cases(Tables(spark, d)).groupBy("split", tier.alias("tier")).agg(F.count_distinct("label").alias("n_clusters"), F.count("*").alias("n_pairs"))


@query("agg_23_new_errors", f"WITH {CASES_SQL} SELECT vec_id FROM cases WHERE predicted <> positive AND baseline = positive")
def _(spark, d):
    return cases(Tables(spark, d)).where("predicted <> positive AND baseline = positive").select("vec_id")


@query("agg_24_adoption", f"WITH {CASES_SQL}, m AS (SELECT split, count(*) FILTER (predicted = positive) / count(*) AS n, count(*) FILTER (baseline = positive) / count(*) AS o FROM cases GROUP BY 1) SELECT (SELECT count(*) FROM cases WHERE predicted <> positive AND baseline = positive) = 0 AND (SELECT bool_and(n >= o) FROM m) AND (SELECT bool_or(n > o) FROM m) AS allowed")
def _(spark, d):
    c = cases(Tables(spark, d))
    m = c.groupBy("split").agg((F.count_if(F.col("predicted") == F.col("positive")) / F.count("*")).alias("n"), (F.count_if(F.col("baseline") == F.col("positive")) / F.count("*")).alias("o"))
    return C.adoption(m, "o", "n", c.where("predicted <> positive AND baseline = positive"))


@query("agg_25_document_frequency", r"SELECT tok, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '([\p{L}\p{N}_-]+)', 1))) AS tok FROM documents) GROUP BY tok")
def _(spark, d):
    from lexmill.operators.similarity import token_frequency, token_sets

    return token_frequency(token_sets(Tables(spark, d).documents, "doc_id", "text"))


@query("agg_26_axis_deltas", f"WITH {CASES_SQL}, m AS (SELECT label, avg(CAST(predicted = positive AS INT)) - avg(CAST(baseline = positive AS INT)) AS d FROM cases GROUP BY 1) SELECT label, round(d, 6) AS delta, CASE WHEN d > 0 THEN 'better' WHEN d < 0 THEN 'worse' ELSE 'equal' END AS verdict FROM m")
def _(spark, d):
    hit = lambda c: F.avg((F.col(c) == F.col("positive")).cast("int"))
    m = cases(Tables(spark, d)).groupBy("label").agg((hit("predicted") - hit("baseline")).alias("d"))
    return m.select("label", F.round("d", 6).alias("delta"), F.when(F.col("d") > 0, "better").when(F.col("d") < 0, "worse").otherwise("equal").alias("verdict"))


@query("agg_27_axis_fraction", "SELECT l_returnflag, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS fraction FROM lineitem GROUP BY 1")
def _(spark, d):
    return Tables(spark, d).lineitem.groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity"), 6).alias("fraction"))


@query("agg_28_win_loss_tie", "WITH p AS (SELECT a.l_orderkey, (a.l_returnflag, -a.l_quantity) AS x, (b.l_returnflag, -b.l_quantity) AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber) SELECT count(*) FILTER (x > y) AS wins, count(*) FILTER (x < y) AS losses, count(*) FILTER (x = y) AS ties FROM p")
def _(spark, d):
    li = Tables(spark, d).lineitem
    rank = F.struct("l_returnflag", (-F.col("l_quantity")).alias("q"))
    a = li.select("l_orderkey", (F.col("l_linenumber") + 1).alias("n"), rank.alias("x"))
    j = a.join(li.select("l_orderkey", F.col("l_linenumber").alias("n"), rank.alias("y")), ["l_orderkey", "n"])
    return j.agg(F.count_if(F.col("x") > F.col("y")).alias("wins"), F.count_if(F.col("x") < F.col("y")).alias("losses"), F.count_if(F.col("x") == F.col("y")).alias("ties"))


@query("agg_30_reader_metrics", "SELECT p_type AS product, count(*) AS n_sources, count(DISTINCT p_brand) AS n_modules, count(DISTINCT p_name) AS n_pages FROM part GROUP BY 1")
def _(spark, d):
    return Tables(spark, d).part.groupBy(F.col("p_type").alias("product")).agg(F.count("*").alias("n_sources"), F.count_distinct("p_brand").alias("n_modules"), F.count_distinct("p_name").alias("n_pages"))


@query("agg_31_machine_evidence", "SELECT count(*) AS n_pages, max(n) AS max_lines, bool_and(n <= 300) AS all_short FROM (SELECT len(string_split(text, chr(10))) AS n FROM documents)")
def _(spark, d):
    n = Tables(spark, d).documents.select(F.size(F.split("text", "\n", -1)).cast("long").alias("n"))
    return n.agg(F.count("*").alias("n_pages"), F.max("n").alias("max_lines"), F.bool_and(F.col("n") <= 300).alias("all_short"))


@query("agg_32_claim_grains", f"WITH {CLAIMS} SELECT count(DISTINCT (uri, line_no, claim)) AS n_entities, count(DISTINCT claim) AS n_fingerprints FROM claims")
def _(spark, d):
    return Tables(spark, d).claims().agg(F.count_distinct("uri", "line_no", "claim").alias("n_entities"), F.count_distinct("claim").alias("n_fingerprints"))


@query("agg_33_question_policy", "SELECT o_custkey, coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') AS codes FROM (SELECT o_custkey, CASE WHEN o_totalprice > 450000 THEN 'large' END AS code FROM orders UNION ALL SELECT o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'pending' END FROM orders) GROUP BY 1")
def _(spark, d):
    codes = F.array_compact(F.array(F.when(F.col("o_totalprice") > 450000, "large"), F.when(F.col("o_orderstatus") == "P", "pending")))
    rows = Tables(spark, d).orders.select("o_custkey", F.explode_outer(codes).alias("code"))
    return rows.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes"))


@query("agg_34_category_coverage", "SELECT c_mktsegment, count(*) AS n, CASE WHEN count(*) FILTER (c_acctbal > 0) = count(*) THEN 'complete' WHEN count(*) FILTER (c_acctbal > 0) = 0 THEN 'missing' ELSE 'partial' END AS status FROM customer GROUP BY 1")
def _(spark, d):
    ok = F.count_if(F.col("c_acctbal") > 0)
    g = Tables(spark, d).customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"), ok.alias("ok"))
    return g.select("c_mktsegment", "n", F.when(F.col("ok") == F.col("n"), "complete").when(F.col("ok") == 0, "missing").otherwise("partial").alias("status"))


@query("agg_35_answerability", "SELECT n_nationkey, min(s_suppkey) FILTER (s_acctbal > 1000) AS concept FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def _(spark, d):
    t = Tables(spark, d)
    ok = t.supplier.where("s_acctbal > 1000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_suppkey").alias("concept"))
    return t.nation.select("n_nationkey").join(ok, "n_nationkey", "left")


@query("agg_36_node_status", "SELECT l_partkey, CASE WHEN bool_or(l_tax > 0.07) THEN 'conflict' WHEN count(DISTINCT (l_orderkey, l_suppkey)) < 2 THEN 'pending' ELSE 'supported' END AS status FROM lineitem GROUP BY 1")
def _(spark, d):
    g = Tables(spark, d).lineitem.groupBy("l_partkey").agg(F.bool_or(F.col("l_tax") > 0.07).alias("c"), F.count_distinct("l_orderkey", "l_suppkey").alias("n"))
    return g.select("l_partkey", F.when(F.col("c"), "conflict").when(F.col("n") < 2, "pending").otherwise("supported").alias("status"))


@query("agg_37_merge_content", f"WITH {CLAIMS}, f AS (SELECT doc_id, claim, min(line_no) AS p FROM claims GROUP BY ALL) SELECT doc_id, sha256(string_agg(claim, chr(10) ORDER BY p)) AS merged FROM f GROUP BY doc_id")
def _(spark, d):
    f = Tables(spark, d).claims().groupBy("doc_id", "claim").agg(F.min("line_no").alias("p"))
    return f.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "claim"))), lambda x: x["claim"]), "\n"), 256).alias("merged"))


@query("agg_38_root_causes", "SELECT 'large' AS cause, count(*) AS n FROM orders WHERE o_totalprice > 450000 UNION ALL SELECT 'pending', count(*) FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'negative', count(*) FROM customer WHERE c_acctbal < 0")
def _(spark, d):
    t = Tables(spark, d)
    c = lambda df, cond, name: df.agg(F.count_if(F.expr(cond)).alias("n")).select(F.lit(name).alias("cause"), "n")
    return c(t.orders, "o_totalprice > 450000", "large").unionByName(c(t.orders, "o_orderstatus = 'P'", "pending")).unionByName(c(t.customer, "c_acctbal < 0", "negative"))


@query("agg_39_delivery_codes", "SELECT DISTINCT unnest(list_filter([CASE WHEN l_discount > 0.09 THEN 'DISCOUNT' END, CASE WHEN l_tax = 0 THEN 'NO_TAX' END, CASE WHEN l_quantity > 50 THEN 'TOO_MANY' END], lambda x: x IS NOT NULL)) AS code FROM lineitem")
def _(spark, d):
    codes = F.array_compact(F.array(F.when(F.col("l_discount") > 0.09, "DISCOUNT"), F.when(F.col("l_tax") == 0, "NO_TAX"), F.when(F.col("l_quantity") > 50, "TOO_MANY")))
    return Tables(spark, d).lineitem.select(F.explode(codes).alias("code")).distinct()


@query("agg_40_rollup_extension", "SELECT p_type, p_brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY ROLLUP (p_type, p_brand)")
def _(spark, d):
    return Tables(spark, d).part.rollup("p_type", "p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("total"))


@query("ext_18_partial_separation", f"WITH {CASES_SQL}, g AS (SELECT * FROM (SELECT DISTINCT label FROM cases), (VALUES ('calibration'), ('blind')) s(split)) SELECT g.label, g.split, count(c.vec_id) AS n FROM g LEFT JOIN cases c ON c.label = g.label AND c.split = g.split GROUP BY ALL")
def _(spark, d):
    c = cases(Tables(spark, d))
    grid = c.select("label").distinct().withColumn("split", F.explode(F.array(F.lit("calibration"), F.lit("blind"))))
    return grid.join(c.groupBy("label", "split").agg(F.count("*").alias("k")), ["label", "split"], "left").select("label", "split", F.coalesce("k", F.lit(0)).alias("n"))


@query("ext_19_stratum_valid", f"WITH {CASES_SQL} SELECT vec_id, positive = (label IN (0, 2, 4, 6, 8)) AS valid FROM cases")
def _(spark, d):
    return cases(Tables(spark, d)).select("vec_id", (F.col("positive") == F.col("label").isin(0, 2, 4, 6, 8)).alias("valid"))


@query("ext_20_outcome_error", f"WITH {CASES_SQL} SELECT vec_id, coalesce(CASE WHEN score > 0.2 THEN true END, CASE WHEN score > 0 THEN NOT baseline END, predicted <> positive) AS error FROM cases")
def _(spark, d):
    e = F.coalesce(F.when(F.col("score") > 0.2, F.lit(True)), F.when(F.col("score") > 0, ~F.col("baseline")), F.col("predicted") != F.col("positive"))
    return cases(Tables(spark, d)).select("vec_id", e.alias("error"))


@query("ext_23_rare_modules", "SELECT p_type, p_name, count(*) AS n FROM part GROUP BY ALL HAVING count(*) >= 2")
def _(spark, d):
    return Tables(spark, d).part.groupBy("p_type", "p_name").agg(F.count("*").alias("n")).where("n >= 2")


@query("ext_28_observed_features", "SELECT source, bool_or(contains(text, '|')) AS has_table, bool_or(contains(text, '@')) AS has_mail FROM documents GROUP BY 1")
def _(spark, d):
    return Tables(spark, d).documents.groupBy("source").agg(F.bool_or(F.contains("text", F.lit("|"))).alias("has_table"), F.bool_or(F.contains("text", F.lit("@"))).alias("has_mail"))


@query("ext_35_entry_coverage", "SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.n, 0) AS declared, coalesce(b.n, 0) AS observed FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1) a FULL JOIN (SELECT lang, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1) b ON a.lang = b.lang")
def _(spark, d):
    t = Tables(spark, d)
    a = t.documents.groupBy("lang").agg(F.count("*").alias("a"))
    b = t.documents.join(t.labels, "doc_id").groupBy("lang").agg(F.count("*").alias("b"))
    return a.join(b, "lang", "full_outer").select("lang", F.coalesce("a", F.lit(0)).alias("declared"), F.coalesce("b", F.lit(0)).alias("observed"))


@query("ext_45_page_type", "SELECT p_name, CASE WHEN count(p_type) = 0 THEN NULL WHEN count(DISTINCT p_type) = 1 THEN min(p_type) ELSE 'conflict' END AS page_type FROM part GROUP BY 1")
def _(spark, d):
    g = Tables(spark, d).part.groupBy("p_name").agg(F.count("p_type").alias("k"), F.count_distinct("p_type").alias("n"), F.min("p_type").alias("m"))
    return g.select("p_name", F.when(F.col("k") == 0, None).when(F.col("n") == 1, F.col("m")).otherwise("conflict").alias("page_type"))


@query("ext_54_sample_gaps", "SELECT CAST(n_regionkey AS VARCHAR) AS parent, greatest(0, 40 - count(s_suppkey)) AS gap FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT 'total', greatest(0, 200 - count(*)) FROM supplier")
def _(spark, d):
    t = Tables(spark, d)
    per = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_regionkey").cast("string").alias("parent")).agg(F.greatest(F.lit(0).cast("long"), 40 - F.count("s_suppkey")).alias("gap"))
    return per.unionByName(t.supplier.agg(F.greatest(F.lit(0).cast("long"), 200 - F.count("*")).alias("gap")).select(F.lit("total").alias("parent"), "gap"))


@query("ext_55_reverse_map", "SELECT l_suppkey, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS members FROM lineitem GROUP BY 1")
def _(spark, d):
    return Tables(spark, d).lineitem.groupBy("l_suppkey").agg(F.array_join(F.sort_array(F.collect_set(F.col("l_linenumber").cast("string"))), ",").alias("members"))


@query("ext_57_baseline_metrics", "SELECT c_mktsegment, count(*) AS n, bool_or(c_acctbal > 9900) AS has_top FROM customer GROUP BY 1")
def _(spark, d):
    return Tables(spark, d).customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.bool_or(F.col("c_acctbal") > 9900).alias("has_top"))


@query("ext_59_fraction_sign", "SELECT p_partkey, CAST(sign(p_size * 31 - 17 * (p_partkey % 100 + 1)) AS INTEGER) AS s FROM part")
def _(spark, d):
    return Tables(spark, d).part.select("p_partkey", F.signum(F.col("p_size") * 31 - 17 * (F.col("p_partkey") % 100 + 1)).cast("int").alias("s"))
