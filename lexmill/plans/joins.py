"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import joins as J
from lexmill.operators import ledger as R
from lexmill.operators.taxonomy import tiered_match
from lexmill.plans.base import CLAIMS, SOURCES, Tables, query


@query("join_01_members_to_items", "SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT o_custkey, list(o_orderkey) AS members FROM orders GROUP BY 1) m, unnest(members) t(k) JOIN orders ON o_orderkey = k JOIN customer ON c_custkey = m.o_custkey")
def _(spark, d):
    t = Tables(spark, d)
    clusters = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list("o_orderkey").alias("members"))
    return clusters.select("c_custkey", F.explode("members").alias("o_orderkey")).join(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey").join(t.customer.select("c_custkey"), "c_custkey").select("c_custkey", "o_orderkey", "o_totalprice")


@query("join_04_span_join", f"WITH {CLAIMS}, s AS (SELECT doc_id, n AS span, n * 3 + 1 AS a, n * 3 + 3 AS b FROM (SELECT doc_id, unnest(range((len(string_split(text, chr(10))) - 1) // 3 + 1)) AS n FROM documents)) SELECT c.doc_id, line_no, span FROM claims c JOIN s ON s.doc_id = c.doc_id AND line_no BETWEEN a AND b")
def _(spark, d):
    t = Tables(spark, d)
    n = F.floor((F.size(F.split("text", "\n", -1)) - 1) / 3)
    spans = t.documents.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("span")).select("doc_id", "span", (F.col("span") * 3 + 1).alias("a"), (F.col("span") * 3 + 3).alias("b"))
    return J.span_join(t.claims(), spans, "doc_id", "line_no", "a", "b").select("doc_id", "line_no", "span")


@query("join_05_locator_join", f"WITH {CLAIMS} SELECT a.doc_id, a.line_no, b.claim FROM claims a JOIN claims b ON a.uri = b.uri AND a.line_no = b.line_no")
def _(spark, d):
    c = Tables(spark, d).claims()
    return c.select("doc_id", "uri", "line_no").join(c.select("uri", "line_no", "claim"), ["uri", "line_no"]).select("doc_id", "line_no", "claim")


@query("join_06_multiset_match", f"WITH {CLAIMS}, a AS (SELECT doc_id, claim, line_no AS l, row_number() OVER (PARTITION BY doc_id, claim ORDER BY line_no) AS n FROM claims), b AS (SELECT doc_id, claim, line_no AS r, row_number() OVER (PARTITION BY doc_id, claim ORDER BY line_no) AS n FROM claims WHERE length(claim) >= 20) SELECT doc_id, l, r FROM a JOIN b USING (doc_id, claim, n)")
def _(spark, d):
    from lexmill.operators.layout import ordinal_match

    c = Tables(spark, d).claims()
    left, right = c.select("doc_id", "claim", F.col("line_no").alias("l")), c.where(F.char_length("claim") >= 20).select("doc_id", "claim", F.col("line_no").alias("r"))
    return ordinal_match(left, right, "doc_id", "claim", "l", "r").select("doc_id", "l", "r")


@query("join_07_output_locators", f"WITH {CLAIMS}, a AS (SELECT doc_id, claim, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS pos, row_number() OVER (PARTITION BY doc_id, claim ORDER BY line_no) AS n, line_no FROM claims) SELECT doc_id, line_no, 'lines:' || (pos + 2) || '-' || (pos + 2) AS locator FROM a")
def _(spark, d):
    from pyspark.sql import Window

    c = Tables(spark, d).claims().withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) + 2)
    return c.select("doc_id", "line_no", F.format_string("lines:%d-%d", "pos", "pos").alias("locator"))


@query("join_08_source_audit", f"WITH {SOURCES}, f AS (SELECT content_hash, min(path) AS first FROM src GROUP BY 1), c AS (SELECT doc_id, count(*) AS n FROM (WITH {CLAIMS} SELECT doc_id FROM claims) GROUP BY 1) SELECT s.doc_id, f.first AS canonical_path, coalesce(c.n, 0) AS n_claims FROM src s JOIN f ON f.content_hash = s.content_hash JOIN src k ON k.path = f.first LEFT JOIN c ON c.doc_id = k.doc_id")
def _(spark, d):
    t = Tables(spark, d)
    s = t.sources().select("doc_id", "path", "content_hash")
    first = s.groupBy("content_hash").agg(F.min_by(F.struct("path", "doc_id"), "path").alias("f"))
    n = t.claims().groupBy(F.col("doc_id").alias("cid")).agg(F.count("*").alias("n"))
    rows = s.join(first, "content_hash").select("doc_id", F.col("f.path").alias("canonical_path"), F.col("f.doc_id").alias("cid"))
    return rows.join(n, "cid", "left").select("doc_id", "canonical_path", F.coalesce("n", F.lit(0)).alias("n_claims"))


@query("join_09_set_equality", "SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'extra' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def _(spark, d):
    t = Tables(spark, d)
    return R.set_difference(t.documents, t.labels, "doc_id")


@query("join_10_provenance_chain", "SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderstatus = 'F'")
def _(spark, d):
    t = Tables(spark, d)
    done = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return t.lineitem.join(done, "l_orderkey").join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey").select("o_custkey", "l_suppkey").dropDuplicates()


@query("join_11_subset_join", "WITH s AS (SELECT DISTINCT o_custkey, o_orderstatus AS m FROM orders), g AS (SELECT DISTINCT o_orderpriority AS grp, o_orderstatus AS m FROM orders WHERE o_totalprice > 400000), z AS (SELECT o_custkey, count(*) AS z FROM s GROUP BY 1), h AS (SELECT o_custkey, grp, count(*) AS n FROM s JOIN g USING (m) GROUP BY ALL), w AS (SELECT h.o_custkey, count(*) AS c, min(grp) AS grp FROM h JOIN z ON z.o_custkey = h.o_custkey AND n = z GROUP BY 1) SELECT z.o_custkey, CASE WHEN c = 1 THEN grp END AS grp FROM z LEFT JOIN w ON w.o_custkey = z.o_custkey")
def _(spark, d):
    o = Tables(spark, d).orders
    groups = o.where("o_totalprice > 400000").select(F.col("o_orderpriority").alias("grp"), F.col("o_orderstatus").alias("m"))
    return J.contained_in_one(o.select("o_custkey", F.col("o_orderstatus").alias("m")), "o_custkey", groups, "grp", "m")


@query("join_12_tiered_gazetteer", """WITH e AS (SELECT n_name AS canonical, lower(n_name) AS name FROM nation UNION SELECT n_name, 'r' || n_regionkey FROM nation),
h AS (SELECT c_custkey, 0 AS rank, 'canonical' AS tier, 'nation_' || c_nationkey AS n FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT c_custkey, 1, 'alias', 'r' || (c_nationkey % 7) FROM customer),
f AS (SELECT c_custkey, rank, tier, count(DISTINCT canonical) AS n, min(canonical) AS canonical FROM h JOIN e ON e.name = h.n GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY rank) AS rn FROM f)
SELECT c.c_custkey, tier, CASE WHEN n = 1 THEN canonical END AS canonical, CASE WHEN tier IS NULL THEN 'unknown' WHEN n > 1 THEN 'conflict' ELSE 'matched' END AS status FROM customer c LEFT JOIN k ON k.c_custkey = c.c_custkey AND rn = 1""")
def _(spark, d):
    t = Tables(spark, d)
    names = t.nation.select(F.col("n_name").alias("canonical"), F.col("n_name").alias("name")).unionByName(t.nation.select(F.col("n_name").alias("canonical"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("name")))
    tiers = [("canonical", F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")))), ("alias", F.concat(F.lit("r"), (F.col("c_nationkey") % 7).cast("string")))]
    return tiered_match(t.customer, "c_custkey", tiers, names)


@query("join_13_either_key", "SELECT DISTINCT o_orderkey, s_suppkey FROM (SELECT o_orderkey, o_custkey AS k FROM orders UNION ALL SELECT o_orderkey, o_orderkey FROM orders) JOIN supplier ON s_suppkey = k")
def _(spark, d):
    t = Tables(spark, d)
    right = t.supplier.select(F.col("s_suppkey").alias("k"), "s_suppkey")
    return J.either_key(t.orders.withColumn("own", F.col("o_orderkey")), "o_orderkey", ["o_custkey", "own"], right, "k", "s_suppkey")


@query("join_15_full_outer_compare", "WITH a AS (SELECT l_partkey AS k, max(l_quantity) AS x FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS k, max(l_quantity) AS y FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN x IS DISTINCT FROM y THEN 'changed' ELSE 'same' END AS change FROM a FULL JOIN b ON a.k = b.k")
def _(spark, d):
    q = lambda flag: Tables(spark, d).lineitem.where(f"l_returnflag = '{flag}'").groupBy(F.col("l_partkey").alias("k")).agg(F.max("l_quantity").alias("v"))
    return J.compare(q("A"), q("N"), "k", "v")


@query("join_16_section_impact", "WITH a AS (SELECT l_suppkey AS page, l_linenumber AS section, count(*) AS x FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), b AS (SELECT l_suppkey AS page, l_linenumber AS section, count(*) AS y FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), j AS (SELECT coalesce(a.page, b.page) AS page, coalesce(a.section, b.section) AS section, x, y FROM a FULL JOIN b ON a.page = b.page AND a.section = b.section) SELECT page, section, CASE WHEN bool_or(y IS NULL) OVER (PARTITION BY page) THEN 'uncertain' WHEN x IS NOT DISTINCT FROM y THEN 'reuse' ELSE 'affected' END AS impact FROM j")
def _(spark, d):
    q = lambda flag: Tables(spark, d).lineitem.where(f"l_returnflag = '{flag}'").groupBy(F.col("l_suppkey").alias("page"), F.col("l_linenumber").alias("section")).agg(F.count("*").alias("v"))
    return J.section_impact(q("A"), q("R"), "page", "section", "v")


@query("join_17_unique_lineage", "WITH r AS (SELECT o_custkey, o_orderpriority, o_orderstatus, count(*) AS n, min(o_orderkey) AS k FROM orders GROUP BY ALL) SELECT o.o_orderkey, CASE WHEN n = 1 THEN r.k END AS match FROM orders o JOIN r USING (o_custkey, o_orderpriority, o_orderstatus)")
def _(spark, d):
    o = Tables(spark, d).orders
    keys = ["o_custkey", "o_orderpriority", "o_orderstatus"]
    return J.unique_matches(o.select("o_orderkey", *keys), o.select(F.col("o_orderkey").alias("match"), *keys), keys, "match").select("o_orderkey", "match")


@query("join_18_pair_reasons", "WITH x AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, 'same_nation' AS reason FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey UNION ALL SELECT a.s_suppkey, b.s_suppkey, 'same_band' FROM supplier a JOIN supplier b ON floor(a.s_acctbal / 100) = floor(b.s_acctbal / 100) AND a.s_suppkey < b.s_suppkey) SELECT a, b, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM x GROUP BY ALL")
def _(spark, d):
    s = Tables(spark, d).supplier.withColumn("band", F.floor(F.col("s_acctbal") / 100))
    return J.pair_reasons(s, "s_suppkey", {"same_nation": "s_nationkey", "same_band": "band"})


@query("join_19_replay_plan", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem GROUP BY 1 HAVING bool_and(l_linestatus = 'F')")
def _(spark, d):
    li = Tables(spark, d).lineitem
    done = li.groupBy("l_partkey").agg(F.bool_and(F.col("l_linestatus") == "F").alias("ok")).where("ok")
    return li.where("l_returnflag = 'R'").select("l_partkey").distinct().join(done, "l_partkey", "left_anti")


@query("join_20_snapshot_merge", "SELECT c.c_custkey, c.c_name, o.n FROM customer c FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey")
def _(spark, d):
    t = Tables(spark, d)
    n = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return t.customer.join(n, F.col("c_custkey") == F.col("k"), "full_outer").select("c_custkey", "c_name", "n")


@query("join_21_typed_key_status", "WITH h AS (SELECT p_name || '|' || p_type AS k, count(*) AS n FROM part WHERE p_size > 40 GROUP BY 1) SELECT p.p_partkey, CASE WHEN n IS NULL THEN 'not_applicable' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS status FROM part p LEFT JOIN h ON h.k = p.p_name || '|' || p.p_type")
def _(spark, d):
    p = Tables(spark, d).part.withColumn("k", F.concat_ws("|", "p_name", "p_type"))
    n = p.where("p_size > 40").groupBy("k").agg(F.count("*").alias("n"))
    return p.join(n, "k", "left").select("p_partkey", F.when(F.col("n").isNull(), "not_applicable").when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("status"))


@query("join_24_case_to_topic", "SELECT o_custkey, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN min(l_suppkey) END AS topic, count(DISTINCT l_suppkey) > 1 AS ambiguous FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(spark, d):
    t = Tables(spark, d)
    j = t.orders.select("o_custkey", F.col("o_orderkey").alias("l_orderkey")).join(t.lineitem.select("l_orderkey", "l_suppkey"), "l_orderkey")
    n = j.groupBy("o_custkey").agg(F.count_distinct("l_suppkey").alias("n"), F.min("l_suppkey").alias("m"))
    return n.select("o_custkey", F.when(F.col("n") == 1, F.col("m")).alias("topic"), (F.col("n") > 1).alias("ambiguous"))


@query("join_25_decisions_once", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'no_draft' WHEN l.doc_id IS NULL THEN 'no_decision' ELSE 'confirmed' END AS state FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id")
def _(spark, d):
    t = Tables(spark, d)
    a, b = t.documents.select("doc_id", F.lit(True).alias("a")), t.labels.select("doc_id", F.lit(True).alias("b"))
    return a.join(b, "doc_id", "full_outer").select("doc_id", F.when(F.col("a").isNull(), "no_draft").when(F.col("b").isNull(), "no_decision").otherwise("confirmed").alias("state"))


@query("join_26_source_chain", "SELECT l.l_orderkey, l.l_linenumber, CASE WHEN o.o_orderkey IS NULL THEN 'no_order' WHEN c.c_custkey IS NULL THEN 'no_customer' WHEN n.n_nationkey IS NULL THEN 'no_nation' ELSE 'ok' END AS chain FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c_acctbal > 0 LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey")
def _(spark, d):
    t = Tables(spark, d)
    j = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(t.customer.where("c_acctbal > 0"), F.col("c_custkey") == F.col("o_custkey"), "left").join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return j.select("l_orderkey", "l_linenumber", F.when(F.col("o_orderkey").isNull(), "no_order").when(F.col("c_custkey").isNull(), "no_customer").when(F.col("n_nationkey").isNull(), "no_nation").otherwise("ok").alias("chain"))


@query("join_27_identity_binding", "SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def _(spark, d):
    return J.dependency_violations(Tables(spark, d).lineitem, "l_partkey", "l_suppkey")


# --- set operations ------------------------------------------------------------


@query("set_02_claim_multiset_difference", "WITH a AS (SELECT l_partkey, count(*) AS na FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_partkey, count(*) AS nb FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) SELECT a.l_partkey, na - coalesce(nb, 0) AS n FROM a LEFT JOIN b ON a.l_partkey = b.l_partkey WHERE na > coalesce(nb, 0)")
def _(spark, d):
    li = Tables(spark, d).lineitem
    return R.multiset_difference(li.where("l_linestatus = 'F'").select("l_partkey"), li.where("l_linestatus = 'O'").select("l_partkey"))


@query("set_03_line_multiset_difference", "SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents EXCEPT ALL SELECT unnest(string_split(text, chr(10))) FROM conversations) GROUP BY line")
def _(spark, d):
    t = Tables(spark, d)
    lines = lambda df: df.select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return R.multiset_difference(lines(t.documents), lines(t.conversations))


@query("set_04_exact_coverage", "SELECT (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) AS uncovered, (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS foreign_keys")
def _(spark, d):
    t = Tables(spark, d)
    diff = R.set_difference(t.lineitem.select(F.col("l_orderkey").alias("k")), t.orders.select(F.col("o_orderkey").alias("k")), "k")
    return diff.agg(F.count_if(F.col("side") == "missing").alias("uncovered"), F.count_if(F.col("side") == "extra").alias("foreign_keys"))


@query("set_06_ordered_union", "SELECT user_id, event_type, min(event_id) AS first_seq FROM events GROUP BY ALL")
def _(spark, d):
    return Tables(spark, d).events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_seq"))


@query("set_07_leakage", "SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def _(spark, d):
    e = Tables(spark, d).events
    return e.where("event_type = 'error'").select("user_id").intersect(e.where("event_type = 'purchase'").select("user_id"))


@query("set_08_single_ownership", "SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) <> 1")
def _(spark, d):
    return Tables(spark, d).lineitem.groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("n")).where("n <> 1")


@query("set_09_snapshot_union", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def _(spark, d):
    return Tables(spark, d).events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"))


#: Customers as topics, and a snapshot of them that lacks some, has others twice, and knows some that are none.
MERGE_SQL = """i AS (SELECT CASE WHEN c_custkey % 17 = 0 THEN ' ' ELSE 't' || c_custkey END AS topic_id, CASE WHEN c_custkey % 51 <> 0 THEN 'd' || c_custkey END AS digest_topic_id, c_custkey, again FROM customer, (VALUES (1), (2)) r(again) WHERE again = 1 OR c_custkey % 29 = 3),
s AS (SELECT CASE WHEN c_custkey % 31 = 7 THEN 'u' || c_custkey WHEN c_custkey % 17 <> 0 THEN 't' || c_custkey END AS topic_id, 'd' || c_custkey AS digest_topic_id, c_nationkey, c_custkey % 41 = 1 AS old_paths, c_custkey % 43 = 1 AS bare FROM customer, (VALUES (1), (2)) r(again) WHERE c_custkey % 13 <> 5 AND (again = 1 OR c_custkey % 37 = 2)),
ni AS (SELECT *, coalesce(nullif(trim(topic_id), ''), digest_topic_id) AS name FROM i), nsn AS (SELECT *, coalesce(topic_id, digest_topic_id) AS name FROM s),
ci AS (SELECT name, count(*) AS n FROM ni GROUP BY 1), cs AS (SELECT name, count(*) AS n, bool_or(old_paths) AS old_paths, bool_or(bare) AS bare FROM nsn GROUP BY 1),
codes AS (SELECT 'index' AS side, name, 'NAME_MISSING' AS code, n FROM ci WHERE name IS NULL UNION ALL SELECT 'snapshot', name, 'NAME_MISSING', n FROM cs WHERE name IS NULL
UNION ALL SELECT 'index', name, 'NAME_REPEATED', n FROM ci WHERE name IS NOT NULL AND n > 1 UNION ALL SELECT 'snapshot', name, 'NAME_REPEATED', n FROM cs WHERE name IS NOT NULL AND n > 1
UNION ALL SELECT 'index', name, 'NOT_IN_SNAPSHOT', n FROM ci WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM cs WHERE name IS NOT NULL) UNION ALL SELECT 'snapshot', name, 'NOT_IN_INDEX', n FROM cs WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM ci WHERE name IS NOT NULL)
UNION ALL SELECT 'snapshot', name, 'OLD_PATHS_FOREIGN', n FROM cs WHERE name IS NOT NULL AND old_paths UNION ALL SELECT 'snapshot', name, 'RELATIONS_WITHOUT_EVIDENCE', n FROM cs WHERE name IS NOT NULL AND bare)"""


def snapshots(t: Tables):
    k = F.col("c_custkey")
    text = lambda p: F.concat(F.lit(p), k.cast("string"))
    twice = lambda fits: F.explode(F.when(fits, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    index = t.customer.withColumn("again", twice(k % 29 == 3)).select(F.when(k % 17 == 0, " ").otherwise(text("t")).alias("topic_id"), F.when(k % 51 != 0, text("d")).alias("digest_topic_id"), F.lit(None).cast("string").alias("topic_key"), "c_custkey")
    snapshot = t.customer.where(k % 13 != 5).withColumn("again", twice(k % 37 == 2)).select(
        F.when(k % 31 == 7, text("u")).when(k % 17 != 0, text("t")).alias("topic_id"), text("d").alias("digest_topic_id"), F.lit(None).cast("string").alias("topic_key"), F.array("c_nationkey").alias("related_topic_refs"),
        F.when(k % 41 == 1, F.array(F.lit("p"))).alias("old_path_mapping"), F.when(k % 43 == 1, F.array(F.lit("x"))).alias("related_topic_ids"),
    )
    return J.merge_snapshots(index, snapshot)


@query("join_20_merge_codes", f"WITH {MERGE_SQL} SELECT * FROM codes")
def _(spark, d):
    return snapshots(Tables(spark, d))[1]


@query("join_20_merged_topics", f"WITH {MERGE_SQL} SELECT ni.name, ni.c_custkey, nsn.c_nationkey AS related FROM ni JOIN nsn ON ni.name = nsn.name WHERE ni.name NOT IN (SELECT name FROM codes WHERE name IS NOT NULL)")
def _(spark, d):
    return snapshots(Tables(spark, d))[0].select("name", "row.c_custkey", F.col("related_topic_refs")[0].alias("related"))
