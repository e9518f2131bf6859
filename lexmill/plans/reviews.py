"""Records under review: identities, answers, verdicts, scores, entries, confirmations.

Every code and verdict occurs in the rows: roles are dealt to rows so that each rule is broken by some."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import review as V
from lexmill.plans.base import Tables, query, source_path


@query("ext_01_topic_identity", """
WITH s AS (SELECT l_partkey AS k, list(DISTINCT CAST(l_suppkey AS VARCHAR)) FILTER (l_returnflag = 'A') AS own, list(DISTINCT CAST(l_suppkey AS VARCHAR)) FILTER (l_returnflag = 'R') AS old FROM lineitem GROUP BY 1),
t AS (SELECT 'topic-' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 16) AS topic_id, p_size, p_type, p_brand, 'topics/' || replace(p_name, ' ', '-') || '.md' AS wish, 'old/' || p_partkey || '.md' AS old_path, coalesce(own, []) AS own, coalesce(old, []) AS old FROM part LEFT JOIN s ON k = p_partkey),
taken AS (SELECT DISTINCT wish FROM t WHERE p_size > 45), f AS (SELECT wish, min(topic_id) AS first_id FROM t WHERE p_size <= 25 GROUP BY 1)
SELECT topic_id, array_to_string(list_sort(list_distinct(CASE WHEN p_size > 25 THEN list_concat(own, old) ELSE own END)), ',') AS source_ids, CASE WHEN p_size > 35 THEN p_brand ELSE p_type END AS category_id,
CASE WHEN p_size > 45 THEN t.wish WHEN p_size > 25 THEN old_path WHEN taken.wish IS NOT NULL OR first_id <> topic_id THEN replace(t.wish, '.md', '-' || substr(topic_id, 7, 8) || '.md') ELSE t.wish END AS published_path,
CASE WHEN p_size > 25 THEN 'kept' ELSE 'new' END AS state, CASE WHEN p_size > 25 THEN p_size > 35 ELSE taken.wish IS NOT NULL OR first_id <> topic_id END AS needs_review
FROM t LEFT JOIN taken ON taken.wish = t.wish LEFT JOIN f ON f.wish = t.wish""")
def _(spark, d):
    t = Tables(spark, d)
    of = lambda flag: F.collect_set(F.when(F.col("l_returnflag") == flag, F.col("l_suppkey").cast("string")))
    sources = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(of("A").alias("own"), of("R").alias("old"))
    topic = F.concat(F.lit("topic-"), F.substring(F.sha2(F.col("p_partkey").cast("string"), 256), 1, 16))
    wish = F.concat(F.lit("topics/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".md"))
    rows = t.part.join(sources, "p_partkey", "left").withColumns({"topic_id": topic, "wish": wish})
    topics = rows.select("topic_id", F.col("own").alias("source_ids"), F.col("p_type").alias("category_id"), F.col("wish").alias("published_path"))
    path = F.when(F.col("p_size") > 45, F.col("wish")).otherwise(F.concat(F.lit("old/"), F.col("p_partkey").cast("string"), F.lit(".md")))
    category = F.when(F.col("p_size") > 35, F.col("p_brand")).otherwise(F.col("p_type"))
    lock = rows.where("p_size > 25").select("topic_id", F.col("old").alias("source_ids"), category.alias("category_id"), path.alias("published_path"))
    return V.resolve_topics(topics, lock).withColumn("source_ids", F.array_join("source_ids", ","))


@query("ext_30_answerability_contract", """
WITH q AS (SELECT doc_id AS question_id, CASE WHEN lang = 'en' THEN 'positive' ELSE 'negative' END AS want FROM documents),
b AS (SELECT doc_id AS question_id, CASE WHEN toxic = 1 OR lang <> 'en' THEN 'negative' ELSE 'positive' END AS p, quality = 1 AND lang <> 'fr' AS ok, CASE WHEN toxic = 0 THEN source END AS hit, quality FROM labels JOIN documents USING (doc_id)),
a AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE quality = 0 UNION ALL SELECT -1 - item_id, 'positive', true, 'x', 1 FROM benchmark),
n AS (SELECT question_id, count(*) AS n, min(p) AS p, bool_and(ok) AS ok, min(hit) AS hit FROM a GROUP BY 1), j AS (SELECT coalesce(n.question_id, q.question_id) AS question_id, n, p, ok, hit, want FROM n FULL JOIN q ON n.question_id = q.question_id),
c AS (SELECT question_id, unnest([CASE WHEN n IS NULL THEN 'ANSWER_MISSING' END, CASE WHEN want IS NULL THEN 'QUESTION_UNKNOWN' END, CASE WHEN n > 1 THEN 'ANSWER_REPEATED' END,
CASE WHEN n = 1 AND want IS NOT NULL AND (ok IS NULL OR p IS DISTINCT FROM want) THEN 'POLARITY_OR_STATUS' END, CASE WHEN n = 1 AND want IS NOT NULL AND ok AND hit IS NULL THEN 'FIRST_HIT_MISSING' END,
CASE WHEN n = 1 AND want IS NOT NULL AND NOT ok AND hit IS NOT NULL THEN 'FIRST_HIT_UNEXPECTED' END, CASE WHEN n = 1 AND ok AND want = 'negative' THEN 'NEGATIVE_ANSWERABLE' END]) AS code FROM j) SELECT question_id, code FROM c WHERE code IS NOT NULL""")
def _(spark, d):
    t = Tables(spark, d)
    docs = t.documents.select(F.col("doc_id").alias("question_id"), "lang", "source")
    questions = docs.select("question_id", F.when(F.col("lang") == "en", "positive").otherwise("negative").alias("polarity"))
    negative = (F.col("toxic") == 1) | (F.col("lang") != "en")
    given = docs.join(t.labels.withColumnRenamed("doc_id", "question_id"), "question_id").select("question_id", F.when(negative, "negative").otherwise("positive").alias("polarity"), ((F.col("quality") == 1) & (F.col("lang") != "fr")).alias("answerable"), F.when(F.col("toxic") == 0, F.col("source")).alias("first_hit"), "quality")
    stray = t.benchmark.select((-1 - F.col("item_id")).alias("question_id"), F.lit("positive").alias("polarity"), F.lit(True).alias("answerable"), F.lit("x").alias("first_hit"))
    return V.answerability_failures(given.unionByName(given.where("quality = 0")).drop("quality").unionByName(stray), questions)


@query("ext_33_verdict", """
WITH r AS (SELECT doc_id, CASE WHEN lang = 'de' THEN 'not_applicable' WHEN toxic = 1 OR contains(text, '@') THEN 'failed' ELSE 'passed' END AS oracle, quality IS NOT NULL AS bounded, coalesce(quality = 1, true) AS said, coalesce(toxic = 0, true) AS complete FROM documents LEFT JOIN labels USING (doc_id)),
v AS (SELECT *, CASE WHEN oracle = 'not_applicable' THEN said ELSE bounded AND oracle = 'passed' END AS found FROM r)
SELECT doc_id, found AS answer_found, CASE WHEN found THEN 'page-' || doc_id END AS first_hit_page, CASE WHEN oracle = 'not_applicable' THEN complete WHEN NOT bounded THEN false ELSE oracle = 'passed' OR complete END AS answer_complete,
CASE WHEN found THEN 'hit' ELSE 'no_match' END AS answer_result, CASE WHEN found THEN 'passed' ELSE 'not_applicable' END AS source_recheck_result, CASE WHEN oracle <> 'not_applicable' AND NOT bounded THEN 'provider_response_contract_invalid' END AS failure_reason FROM v""")
def _(spark, d):
    t = Tables(spark, d)
    said, complete, page = F.coalesce(F.col("quality") == 1, F.lit(True)), F.coalesce(F.col("toxic") == 0, F.lit(True)), F.concat(F.lit("page-"), F.col("doc_id").cast("string"))
    oracle = F.when(F.col("lang") == "de", "not_applicable").when((F.col("toxic") == 1) | F.contains("text", F.lit("@")), "failed").otherwise("passed")
    rows = t.documents.select("doc_id", "lang", "text").join(t.labels, "doc_id", "left").select(
        "doc_id", page.alias("page"), oracle.alias("oracle"), F.col("quality").isNotNull().alias("bounded"), said.alias("answer_found"), F.when(said, page).alias("first_hit_page"),
        complete.alias("answer_complete"), complete.alias("boundary_version_accurate"), said.alias("source_attribution"), F.when(said, "hit").otherwise("no_match").alias("answer_result"), F.when(said, "passed").otherwise("not_applicable").alias("source_recheck_result"),
    )
    return V.normalize_verdict(rows, "page", "oracle", F.col("bounded")).select("doc_id", "answer_found", "first_hit_page", "answer_complete", "answer_result", "source_recheck_result", "failure_reason")


@query("ext_34_score_threshold", """
WITH g AS (SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'P') AS passed, count(*) AS sample_size, min(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderpriority END) AS actor FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN actor IS NULL THEN 0.0 ELSE round(passed / sample_size, 6) END AS rate, CASE WHEN actor IS NULL THEN 'METADATA_INVALID' WHEN passed / sample_size < 0.9 THEN 'ACCURACY_BELOW_THRESHOLD' END AS code FROM g""")
def _(spark, d):
    actor = F.min(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority")))
    g = Tables(spark, d).orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") != "P").alias("passed"), F.count("*").alias("sample_size"), actor.alias("actor"))
    return V.score(g, "passed", "sample_size", ["actor"]).select("o_custkey", F.round("rate", 6).alias("rate"), "code")


@query("ext_36_entry_bindings", """
WITH e AS (SELECT event_id, event_id // 3 AS bundle, CASE WHEN event_type IN ('view', 'click') THEN 'reader' WHEN event_type <> 'error' THEN 'writer' END AS process, value < 60 AS fit FROM events),
m AS (SELECT bundle, count(DISTINCT process) FILTER (fit) > 1 AS mixed FROM e GROUP BY 1), c AS (SELECT event_id, array_to_string(list_filter([CASE WHEN mixed THEN 'ENTRY_PRODUCER_MISMATCH' END, CASE WHEN fit AND process IS NULL THEN 'ENTRY_PRODUCER_MISSING' END, CASE WHEN NOT fit THEN 'ENTRY_STATUS_UNSUPPORTED' END], lambda x: x IS NOT NULL), ',') AS codes FROM e JOIN m USING (bundle))
SELECT event_id, codes, CASE WHEN codes = '' THEN 'passed' ELSE 'blocked' END AS binding FROM c""")
def _(spark, d):
    process = F.when(F.col("event_type").isin("view", "click"), "reader").when(F.col("event_type") != "error", "writer")
    rows = Tables(spark, d).events.select("event_id", F.floor(F.col("event_id") / 3).alias("bundle"), process.alias("process"), F.when(F.col("value") < 60, "verified").otherwise("draft").alias("status"))
    return V.entry_bindings(rows, "bundle", "process", "status").select("event_id", "codes", "binding")


@query("agg_29_quality_proxy", """
WITH r AS (SELECT source, lang, coalesce(text <> '' AND quality = 1, false) AS v, coalesce(text <> '', false) AS r, coalesce(contains(text, chr(10)), false) AS a, coalesce(lang = 'en', false) AS e, CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END AS x FROM documents LEFT JOIN labels USING (doc_id)),
t AS (SELECT count(*) AS n, count(*) FILTER (v) AS v, count(*) FILTER (r) AS r, count(*) FILTER (v AND a) AS a, sum(x) AS x, count(lang) AS m, count(DISTINCT source) AS p, count(DISTINCT source) FILTER (e) AS e FROM r),
k AS (SELECT CASE WHEN p > 0 AND m > 0 THEN 20.0::DOUBLE ELSE 0 END AS structure, 20.0::DOUBLE * v / n AS source_coverage, 15.0::DOUBLE * e / p AS product_entry, CAST(greatest(0, 15 - x) AS DOUBLE) AS reader_cleanliness, 20.0::DOUBLE * v / r AS content_fidelity, least(10.0::DOUBLE, 10.0::DOUBLE * a / v) AS traceability FROM t)
SELECT structure, round(source_coverage, 2) AS source_coverage, round(product_entry, 2) AS product_entry, reader_cleanliness, round(content_fidelity, 2) AS content_fidelity, round(traceability, 2) AS traceability,
least(100.0::DOUBLE, round(structure + source_coverage + product_entry + reader_cleanliness + content_fidelity + traceability, 2)) AS score FROM k""")
def _(spark, d):
    t = Tables(spark, d)
    sure = lambda c: F.coalesce(c, F.lit(False))
    there = sure(F.col("text") != "")
    rows = t.documents.select("doc_id", "source", "lang", there.alias("readable"), sure(F.contains("text", F.lit("\n"))).alias("anchored"), sure(F.col("lang") == "en").alias("entry")).join(t.labels, "doc_id", "left")
    rows = rows.withColumn("valid", F.col("readable") & sure(F.col("quality") == 1)).withColumn("violations", F.when((F.col("quality") == 0) & (F.col("toxic") == 1), 1).otherwise(0))
    return V.quality_proxy(rows, product="source", module="lang", valid="valid", readable="readable", anchored="anchored", entry="entry", violations="violations")


@query("gte_14_confirmation_valid", "SELECT event_id, ts BETWEEN TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 24 HOUR AND TIMESTAMP '2024-01-02 00:00:00' AND event_type IN ('click', 'purchase') AND user_id <= 10 AS valid FROM events")
def _(spark, d):
    zone = F.when(F.col("event_type") == "view", "").otherwise("Z")
    rows = Tables(spark, d).events.select(
        "event_id", F.lit("automatic-summary-confirmation").alias("meaning"), F.concat(F.when(F.col("event_type") == "error", "bot:").otherwise("human:"), F.col("user_id").cast("string")).alias("actor"),
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), zone).alias("at"), F.col("user_id").cast("string").alias("said_run"), F.least("user_id", F.lit(10)).cast("string").alias("run_id"),
        F.when(F.col("event_type") == "signup", "0").otherwise(F.sha2("event_type", 256)).alias("said_sha"), F.sha2("event_type", 256).alias("sha"),
    )
    said = {"meaning": "meaning", "actor": "actor", "confirmed_at": "at", "run_id": "said_run", "summary_sha256": "said_sha"}
    return rows.select("event_id", V.confirmation_valid(said, "run_id", "sha", F.lit("2024-01-02 00:00:00Z").cast("timestamp")).alias("valid"))


@query("ext_29_question_pages")
def _(spark, d):
    t = Tables(spark, d)
    pages = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left").select(source_path().alias("path"), F.col("source").alias("topic_id"), F.col("lang").alias("page_type"), (F.col("quality") == 1).alias("sampled"))
    # the questions are a declared list, as in the policy; the fold over them has no SQL, tests compare it with brute force
    asked = [(f"Q{i:02d}", *x) for i, x in enumerate([("src1", None), (None, "en"), (None, None), ("src1", None), (None, "de"), (None, "en"), (None, None)])]
    return spark.createDataFrame(sorted(V.question_pages(asked, pages).items()), "question_id string, path string")
