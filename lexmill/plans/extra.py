"""Scans of structure, slugs, links, composite gates and the rest of the second tier."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions import unicode as U
from lexmill.operators import layout as L
from lexmill.operators import links as K
from lexmill.operators import scan as S
from lexmill.operators.similarity import top_k
from lexmill.plans import runner
from lexmill.plans.base import CLAIMS, SOURCES, Tables, query
from lexmill.plans.scalars import MD_SQL, markdown

LINES_SQL = "l AS (SELECT conv_id, generate_subscripts(string_split(md, chr(10)), 1) AS line_no, unnest(string_split(md, chr(10))) AS line FROM md)"


@query("src_02_jsonl", "SELECT event_id, user_id FROM events")
def _(spark, d):
    from lexmill.sources.files import parse_jsonl

    rows = Tables(spark, d).events
    lines = rows.select(F.lit("ledger").alias("file"), F.col("event_id").alias("n"), F.to_json(F.struct("event_id", "user_id")).alias("value"))
    torn = spark.createDataFrame([("ledger", 1 << 40, '{"event_id": 1, "us')], "file string, n long, value string")
    return parse_jsonl(lines.unionByName(torn), "event_id long, user_id long")


@query("src_15_compiler_scan", f"WITH {SOURCES} SELECT path FROM src WHERE source <> 'src9'")
def _(spark, d):
    rows = Tables(spark, d).sources().withColumn("path", F.when(F.col("source") == "src9", F.concat(F.lit(".hidden/"), "path")).otherwise(F.col("path")))
    return rows.where(F.col("path").rlike(r"\.(md|markdown|txt|json)$") & ~F.col("path").rlike(r"(^|/)\.")).select("path")


@query("snk_15_vector_cache", "SELECT sha256(text) AS input_hash, CAST(length(text) AS DOUBLE) AS size FROM (SELECT DISTINCT text FROM conversations)")
def _(spark, d):
    from lexmill.sources.cache import cache_misses

    t = Tables(spark, d)
    misses = cache_misses(t.conversations, "text", t.documents.limit(0).select(F.lit("").alias("input_hash")))
    vectors = runner.embed(misses, lambda texts: [[float(len(x)), 1.0] for x in texts])
    return vectors.select("input_hash", F.col("vector")[0].alias("size"))


@query("flt_09_single_source_checks", f"WITH {SOURCES} SELECT doc_id, text <> '' AS complete, source < 'src5' AS axis_explicit, contains(text, '|') OR contains(text, chr(10)) AS structured, lang IS NOT NULL AS evidence, h.n = 1 AS conflict_free FROM src JOIN (SELECT content_hash, count(*) AS n FROM src GROUP BY 1) h USING (content_hash)")
def _(spark, d):
    s = Tables(spark, d).sources()
    n = s.groupBy("content_hash").agg(F.count("*").alias("n"))
    return s.join(n, "content_hash").select("doc_id", (F.col("text") != "").alias("complete"), (F.col("source") < "src5").alias("axis_explicit"), (F.contains("text", F.lit("|")) | F.contains("text", F.lit("\n"))).alias("structured"), F.col("lang").isNotNull().alias("evidence"), (F.col("n") == 1).alias("conflict_free"))


@query("flt_11_typed_sections", f"WITH {MD_SQL}, {LINES_SQL}, h AS (SELECT *, regexp_matches(line, '^\\s*#{{1,6}}\\s+\\S') AS head FROM l WHERE trim(regexp_replace(line, '\\s+', ' ', 'g')) NOT IN ('', '---') AND NOT starts_with(trim(line), '<!--')), s AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY conv_id ORDER BY line_no) AS section_no FROM h) SELECT conv_id, CAST(section_no AS BIGINT) AS section_no, count(*) FILTER (NOT head) AS n_lines FROM s GROUP BY ALL HAVING count(*) FILTER (NOT head) > 0")
def _(spark, d):
    return S.typed_sections(markdown(Tables(spark, d)), "conv_id", "md").select("conv_id", "section_no", "n_lines")


@query("cls_07_fragments", f"WITH {MD_SQL}, {LINES_SQL} SELECT conv_id, CAST(line_no AS INTEGER) AS line_no, CASE WHEN starts_with(line, '#') THEN CASE WHEN starts_with(line, '# ') THEN NULL ELSE 1 END ELSE (SELECT max(b.line_no) FROM l b WHERE b.conv_id = l.conv_id AND b.line_no < l.line_no AND starts_with(b.line, '#')) END AS parent FROM l WHERE trim(regexp_replace(line, '\\s+', ' ', 'g')) <> ''")
def _(spark, d):
    return S.fragments(markdown(Tables(spark, d)), "conv_id", "md").select("conv_id", "line_no", "parent")


@query("cls_08_components", f"WITH {MD_SQL} SELECT conv_id, CAST(len(string_split(md, chr(10))) AS BIGINT) AS n_lines FROM md")
def _(spark, d):
    c = S.components(markdown(Tables(spark, d)), "conv_id", "md")
    return c.groupBy("conv_id").agg(F.sum(F.col("line_end") - F.col("line_start") + 1).alias("n_lines"))


#: Lineages and strata that a split is found for; they are declared groups of cases, not cases.
MOST_STRATA = 100_000


def lineage_strata(rows):
    """(lineage, stratum) of ``rows``, once each; an error beyond a stated number."""
    found = rows.select("lineage", "stratum").distinct().limit(MOST_STRATA + 1).collect()
    if len(found) > MOST_STRATA:
        raise ValueError(f"more than {MOST_STRATA} pairs of lineage and stratum")
    return [tuple(r) for r in found]


@query("sim_15_lineage_split", "SELECT DISTINCT 'lineage-' || label AS lineage FROM embeddings")
def _(spark, d):
    rows = Tables(spark, d).embeddings.select(F.concat(F.lit("lineage-"), F.col("label").cast("string")).alias("lineage"), F.when(F.col("embedding")[0] > 0, "positive").otherwise("negative").alias("stratum"))
    chosen = runner.split_lineages(lineage_strata(rows))
    return spark.createDataFrame([(k,) for k in sorted(chosen)], "lineage string")


@query("sim_15_split_coverage", """WITH s AS (SELECT DISTINCT 'lineage-' || label AS lineage, CASE i WHEN 5 THEN 'only ' || label % 4 ELSE 'c' || i || CASE WHEN embedding[i] > 0 THEN '+' ELSE '-' END END AS stratum FROM embeddings, (VALUES (1), (2), (3), (4), (5)) x(i))
SELECT stratum, count(*) AS n_lineages, count(*) > 1 AS in_both FROM s GROUP BY 1""")
def _(spark, d):
    # a split is good if each stratum with two lineages has one on either side
    sign = lambda i: F.concat(F.lit(f"c{i + 1}"), F.when(F.col("embedding")[i] > 0, "+").otherwise("-"))
    strata = F.array(*map(sign, range(4)), F.concat(F.lit("only "), (F.col("label") % 4).cast("string")))
    rows = Tables(spark, d).embeddings.select(F.concat(F.lit("lineage-"), F.col("label").cast("string")).alias("lineage"), F.explode(strata).alias("stratum")).distinct()
    chosen = spark.createDataFrame(sorted(runner.split_lineages(lineage_strata(rows)).items()), "lineage string, side string")
    return rows.join(chosen, "lineage", "left").groupBy("stratum").agg(F.count("*").alias("n_lineages"), (F.count_distinct("side") == 2).alias("in_both"))


@query("sim_17_calibration_result", "SELECT label, count(*) AS n, round(min(CAST(embedding[1] AS DOUBLE)), 6) AS lo, round(max(CAST(embedding[1] AS DOUBLE)), 6) AS hi FROM embeddings GROUP BY label")
def _(spark, d):
    from lexmill.operators.calibrate import distribution

    out = distribution(Tables(spark, d).embeddings.select("label", F.col("embedding")[0].cast("double").alias("s")), ["label"], "s")
    return out.select("label", "n", F.round("min", 6).alias("lo"), F.round("max", 6).alias("hi"))


@query("join_22_weighted_fuzzy", """
WITH a AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS tok FROM part), b AS (SELECT DISTINCT p_name AS page, unnest(string_split(p_name, ' ')) AS tok FROM part), s AS (SELECT p_partkey, page, count(*) * 2 AS score FROM a JOIN b USING (tok) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, page) AS rn FROM s) SELECT p_partkey, page, score FROM k WHERE rn = 1""")
def _(spark, d):
    p = Tables(spark, d).part
    a = p.select("p_partkey", F.explode(F.split("p_name", " ")).alias("tok"))
    b = p.select(F.col("p_name").alias("page")).distinct().select("page", F.explode(F.split("page", " ")).alias("tok"))
    s = a.join(b, "tok").groupBy("p_partkey", "page").agg((F.count("*") * 2).alias("score"))
    return top_k(s, "p_partkey", 1, "page").select("p_partkey", "page", "score")


@query("win_09_page_partition", """WITH RECURSIVE o AS (SELECT o_custkey AS g, o_orderkey AS p, (o_orderkey % 9) + 3.0 AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
b AS (SELECT g, p, n, s, 1 AS bin, s AS run FROM o WHERE n = 1 UNION ALL SELECT o.g, o.p, o.n, o.s, CASE WHEN b.run + o.s > 40 THEN b.bin + 1 ELSE b.bin END, CASE WHEN b.run + o.s > 40 THEN o.s ELSE b.run + o.s END FROM b JOIN o ON o.g = b.g AND o.n = b.n + 1)
SELECT g AS o_custkey, bin AS page, CAST(sum(s) + 10 AS DOUBLE) AS n_lines FROM b GROUP BY ALL""")
def _(spark, d):
    # every page costs 10 lines of its own, an entry its size
    rows = Tables(spark, d).orders.withColumn("s", (F.col("o_orderkey") % 9) + 3.0)
    p = L.pack_groups(rows, "o_custkey", "o_orderkey", "s", 50 - 10)
    return p.groupBy("o_custkey", F.col("bin").alias("page")).agg((F.sum("s") + 10).alias("n_lines"))


@query("win_15_safe_prefix", "WITH r AS (SELECT l_orderkey, l_linenumber, l_tax > 0.01 AS ok, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_tax > 0.01) AS n FROM lineitem) SELECT l_orderkey, CAST(coalesce(min(n) FILTER (NOT ok) - 1, count(*)) AS INTEGER) AS safe FROM r GROUP BY 1")
def _(spark, d):
    flags = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", (F.col("l_tax") > 0.01).alias("ok")))), lambda x: x["ok"])
    return Tables(spark, d).lineitem.groupBy("l_orderkey").agg(flags.alias("f")).select("l_orderkey", S.safe_prefix("f").alias("safe"))


@query("scl_10_readable_slug", "SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g') AS slug FROM part")
def _(spark, d):
    return Tables(spark, d).part.select("p_partkey", U.readable_slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


@query("scl_11_strict_slug", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'x-index' ELSE role END AS slug FROM conversations")
def _(spark, d):
    return Tables(spark, d).conversations.select("conv_id", "turn", U.strict_slug(F.when(F.col("role") == "user", "Index").otherwise(F.col("role"))).alias("slug"))


@query("scl_13_evidence_slug", "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') || '-u00e9' AS slug FROM part")
def _(spark, d):
    return Tables(spark, d).part.select("p_partkey", U.evidence_slug(F.concat("p_name", F.lit(" é"))).alias("slug"))


@query("scl_20_frontmatter_pairs", "SELECT page_id, url AS source FROM pages")
def _(spark, d):
    x = F.concat(F.lit("---\ntitle: t\nsource: "), "url", F.lit("\n---\nbody"))
    return Tables(spark, d).pages.select("page_id", U.frontmatter_pairs(x)["source"].alias("source"))


@query("scl_21_yaml_frontmatter", """SELECT p_partkey, '{"name": "' || p_name || '", "size": ' || p_size || '}' AS front FROM part""")
def _(spark, d):
    x = F.concat(F.lit("---\nsize: "), F.col("p_size").cast("string"), F.lit("\nname: "), "p_name", F.lit("\n---\nbody"))
    return Tables(spark, d).part.select("p_partkey", U.frontmatter_json(x).alias("front"))


@query("scl_23_clean_body", r"WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS n_lines FROM l WHERE NOT regexp_matches(line, '(?i)^\s*(?:digest[_-]|content[_-]?fingerprint|source[_-]?id)') GROUP BY 1")
def _(spark, d):
    from lexmill.operators.layout import blank_runs

    rows = Tables(spark, d).documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).where(~F.col("line").rlike(r"(?i)^\s*(?:digest[_-]|content[_-]?fingerprint|source[_-]?id)"))
    return blank_runs(rows, "doc_id", "p", "line").groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query("scl_31_exception_audit", "SELECT source, CASE WHEN bool_or(regexp_matches(text, '(?i)(error|fail|erreur|fehler)')) THEN 'documented' ELSE 'source_not_documented' END AS status FROM documents GROUP BY 1")
def _(spark, d):
    return Tables(spark, d).documents.groupBy("source").agg(F.when(F.bool_or(F.col("text").rlike("(?i)(error|fail|erreur|fehler)")), "documented").otherwise("source_not_documented").alias("status"))


@query("scl_39_semantic_form", r"SELECT p_partkey, trim(regexp_replace(lower(p_name), '\b(and|the|of)\b', ' ', 'g')) AS form FROM part")
def _(spark, d):
    return Tables(spark, d).part.select("p_partkey", U.semantic_form(F.concat("p_name", F.lit(".MD"))).alias("form"))


@query("scl_43_oracle_terms", "SELECT p_partkey, replace(p_name, ' ', ',') AS terms FROM part")
def _(spark, d):
    from lexmill.operators.similarity import term_chunks

    return Tables(spark, d).part.select("p_partkey", F.array_join(F.slice(term_chunks(F.col("p_name")), 1, 3), ",").alias("terms"))


@query("scl_45_link_rewrite", "SELECT page_id, CASE WHEN page_id IN (SELECT doc_id FROM labels) THEN 'see [here](../new/' || page_id || '.md#a) end' ELSE 'see here end' END AS text FROM pages")
def _(spark, d):
    t = Tables(spark, d)
    name = F.concat(F.col("page_id").cast("string"), F.lit(".md"))
    pages = t.pages.select("page_id", F.concat(F.lit("see [here]("), name, F.lit("#a) end")).alias("text"))
    targets = t.labels.select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("target")).select("target", F.concat(F.lit("../new/"), "target").alias("path"))
    return K.rewrite(pages, "page_id", "text", targets)


@query("scl_48_relative_link", "SELECT p_partkey, '../../b/' || p_partkey || '.md' AS link FROM part")
def _(spark, d):
    return Tables(spark, d).part.select("p_partkey", U.relative_link(F.lit("root/a/x/page.md"), F.concat(F.lit("root/b/"), F.col("p_partkey").cast("string"), F.lit(".md"))).alias("link"))


@query("cls_04_display_title", r"SELECT p_partkey, p_name AS title FROM part")
def _(spark, d):
    x = F.concat(F.lit("**12. "), "p_name", F.lit("_draft**"))
    for pattern in (r"\*+", r"^[0-9]+[.)、]\s*", r"^[0-9]{1,3}\s+", "_.*$"):
        x = F.trim(F.regexp_replace(x, pattern, ""))
    return Tables(spark, d).part.select("p_partkey", x.alias("title"))


@query("cls_06_semantic_task", "SELECT p_partkey, CASE WHEN contains(p_name, 'small') THEN 'create' WHEN contains(p_name, 'red') THEN 'edit' ELSE 'general' END AS task FROM part")
def _(spark, d):
    return Tables(spark, d).part.select("p_partkey", T.first_rule("p_name", [("create", ("small",)), ("edit", ("red",))], "general").alias("task"))


@query("cls_10_suggestion_fields", "SELECT p_partkey, CASE WHEN length(p_name) >= 10 THEN p_name ELSE p_brand END AS title, CASE WHEN p_size <= 25 THEN p_type ELSE 'pending' END AS category, array_to_string(list_filter([CASE WHEN length(p_name) < 10 THEN 'title' END, CASE WHEN p_size > 25 THEN 'category' END], lambda x: x IS NOT NULL), ',') AS fallbacks FROM part")
def _(spark, d):
    title, category = F.when(F.char_length("p_name") >= 10, F.col("p_name")), F.when(F.col("p_size") <= 25, F.col("p_type"))
    used = F.array_compact(F.array(F.when(title.isNull(), "title"), F.when(category.isNull(), "category")))
    return Tables(spark, d).part.select("p_partkey", F.coalesce(title, "p_brand").alias("title"), F.coalesce(category, F.lit("pending")).alias("category"), F.array_join(used, ",").alias("fallbacks"))


@query("lay_01_draft_stage", f"WITH {CLAIMS} SELECT doc_id, CAST(sum(ceil(1.0 * n / 20)) AS BIGINT) AS n_batches, CAST(sum(n) AS BIGINT) AS n_claims FROM (SELECT doc_id, count(*) AS n FROM claims GROUP BY 1) GROUP BY 1")
def _(spark, d):
    c = Tables(spark, d).claims().withColumn("one", F.lit(1))
    p = L.pack_two(c, "doc_id", "line_no", "one", 20, 3000)
    return p.groupBy("doc_id").agg(F.max("bin").cast("long").alias("n_batches"), F.count("*").alias("n_claims"))


@query("lay_02_build_pages", f"WITH {CLAIMS} SELECT doc_id, (line_no - 1) // 12 + 1 AS page, count(*) AS n_claims FROM claims GROUP BY ALL")
def _(spark, d):
    from lexmill.operators.joins import span_join

    t = Tables(spark, d)
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).withColumn("one", F.lit(1))
    pages = L.pack_groups(lines, "doc_id", "p", "one", 12).groupBy("doc_id", F.col("bin").alias("page")).agg((F.min("p") + 1).alias("a"), (F.max("p") + 1).alias("b"))
    return span_join(t.claims(), pages, "doc_id", "line_no", "a", "b").groupBy("doc_id", F.col("page").cast("long").alias("page")).agg(F.count("*").alias("n_claims"))


@query("lay_07_two_layer_page", "SELECT conv_id, count(*) AS n_claims, count(DISTINCT turn) = count(*) AS owned_once FROM conversations GROUP BY 1")
def _(spark, d):
    return Tables(spark, d).conversations.groupBy("conv_id").agg(F.count("*").alias("n_claims"), (F.count_distinct("turn") == F.count("*")).alias("owned_once"))


@query("nav_01_navigation_pages", "SELECT p_type, '# ' || p_type || chr(10) || string_agg(DISTINCT '- [' || p_brand || '](' || p_brand || '.md)', chr(10) ORDER BY '- [' || p_brand || '](' || p_brand || '.md)') AS page FROM part GROUP BY 1")
def _(spark, d):
    line = F.concat(F.lit("- ["), "p_brand", F.lit("]("), "p_brand", F.lit(".md)"))
    return Tables(spark, d).part.groupBy("p_type").agg(F.concat(F.lit("# "), F.first("p_type"), F.lit("\n"), F.array_join(F.sort_array(F.collect_set(line)), "\n")).alias("page"))


@query("nav_05_source_index", "SELECT source, min(doc_id) AS first_doc, max(doc_id) AS last_doc, count(*) AS n FROM documents GROUP BY 1")
def _(spark, d):
    return Tables(spark, d).documents.groupBy("source").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n"))


@query("nav_06_topic_index", "SELECT user_id, arg_max(event_type, event_id) AS topic, min(event_id) AS first_seq FROM events GROUP BY 1")
def _(spark, d):
    from lexmill.operators.ledger import upsert

    e = Tables(spark, d).events.select("user_id", "event_id", F.col("event_type").alias("topic"))
    return upsert(e, e.limit(0), ["user_id"], "event_id").select("user_id", "topic", "first_seq")


@query("gte_10_question_oracle", f"WITH {MD_SQL} SELECT conv_id, regexp_matches(md, '(?m)^## user ') AS asked, regexp_matches(md, '(?m)^## assistant ') AS answered FROM md")
def _(spark, d):
    return markdown(Tables(spark, d)).select("conv_id", F.col("md").rlike("(?m)^## user ").alias("asked"), F.col("md").rlike("(?m)^## assistant ").alias("answered"))


@query("gte_13_binding_failures", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS pending, count(DISTINCT o_orderpriority) > 4 AS mixed FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'P') > 0 OR count(DISTINCT o_orderpriority) > 4")
def _(spark, d):
    g = Tables(spark, d).orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "P").alias("pending"), (F.count_distinct("o_orderpriority") > 4).alias("mixed"))
    return g.where("pending > 0 OR mixed")


@query("gte_18_location_comparison", "SELECT l_returnflag, count(*) FILTER (l_discount > l_tax) AS wins, count(*) FILTER (l_discount < l_tax) AS losses, count(*) FILTER (l_discount = l_tax) AS ties FROM lineitem GROUP BY 1")
def _(spark, d):
    a, b = F.col("l_discount"), F.col("l_tax")
    return Tables(spark, d).lineitem.groupBy("l_returnflag").agg(F.count_if(a > b).alias("wins"), F.count_if(a < b).alias("losses"), F.count_if(a == b).alias("ties"))


@query("gte_19_comparison_report", "SELECT c_mktsegment, count(*) AS pages, round(avg(c_acctbal), 4) AS mean_score, bool_and(c_acctbal > -1000) AS all_ok FROM customer GROUP BY 1")
def _(spark, d):
    return Tables(spark, d).customer.groupBy("c_mktsegment").agg(F.count("*").alias("pages"), F.round(F.avg("c_acctbal"), 4).alias("mean_score"), F.bool_and(F.col("c_acctbal") > -1000).alias("all_ok"))


@query("gte_22_semantic_batches", "SELECT item_id, (row_number() OVER (ORDER BY item_id) - 1) // 4 AS batch FROM benchmark")
def _(spark, d):
    from lexmill.sources.files import numbered

    return numbered(Tables(spark, d).benchmark, "item_id").select("item_id", F.floor((F.col("n") - 1) / 4).cast("long").alias("batch"))


@query("ext_03_global_plan", f"WITH {SOURCES}, f AS (SELECT content_hash, min(path) AS canonical, count(*) AS copies FROM src GROUP BY 1) SELECT canonical, copies FROM f")
def _(spark, d):
    return Tables(spark, d).sources().groupBy("content_hash").agg(F.min("path").alias("canonical"), F.count("*").alias("copies")).select("canonical", "copies")


@query("ext_11_semantic_rollup", "SELECT l_suppkey, count(*) AS concepts, count(DISTINCT l_orderkey) AS backtrace, round(avg(CAST(l_tax > 0 AS INT)), 6) AS completeness FROM lineitem GROUP BY 1")
def _(spark, d):
    return Tables(spark, d).lineitem.groupBy("l_suppkey").agg(F.count("*").alias("concepts"), F.count_distinct("l_orderkey").alias("backtrace"), F.round(F.avg((F.col("l_tax") > 0).cast("int")), 6).alias("completeness"))


@query("ext_13_section_bindings", "SELECT l_orderkey, l_linenumber, count(*) AS n_claims FROM lineitem JOIN (SELECT DISTINCT s_suppkey FROM supplier) ON s_suppkey = l_suppkey GROUP BY ALL")
def _(spark, d):
    t = Tables(spark, d)
    return t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n_claims"))


@query("ext_21_heading_identities", f"WITH {MD_SQL}, {LINES_SQL} SELECT conv_id, regexp_replace(line, '^#+ ', '') AS heading, min(CAST(line_no AS INTEGER)) AS line_no FROM l WHERE starts_with(line, '#') GROUP BY ALL")
def _(spark, d):
    rows = markdown(Tables(spark, d)).select("conv_id", F.posexplode(F.split("md", "\n", -1)).alias("p", "line")).where("startswith(line, '#')")
    return rows.groupBy("conv_id", F.regexp_replace("line", "^#+ ", "").alias("heading")).agg((F.min("p") + 1).alias("line_no"))


@query("ext_37_trust_fingerprints", f"WITH {SOURCES}, f AS (SELECT content_hash, count(DISTINCT lang) AS langs FROM src GROUP BY 1) SELECT doc_id, langs = 1 AS agrees FROM src JOIN f USING (content_hash)")
def _(spark, d):
    s = Tables(spark, d).sources()
    return s.join(s.groupBy("content_hash").agg(F.count_distinct("lang").alias("langs")), "content_hash").select("doc_id", (F.col("langs") == 1).alias("agrees"))


@query("ext_39_bundle_projection", "SELECT p_type AS concept, count(DISTINCT p_brand) AS n_indexes, count(*) AS n_references, min(p_name) AS first_page FROM part GROUP BY 1")
def _(spark, d):
    return Tables(spark, d).part.groupBy(F.col("p_type").alias("concept")).agg(F.count_distinct("p_brand").alias("n_indexes"), F.count("*").alias("n_references"), F.min("p_name").alias("first_page"))


@query("ext_41_content_extraction", f"WITH {CLAIMS}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM claims) SELECT doc_id, line_no FROM k WHERE n <= 120")
def _(spark, d):
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    return Tables(spark, d).claims().withColumn("n", n).where("n <= 120").select("doc_id", "line_no")


@query("ext_42_case_side", "SELECT doc_id, (CAST(contains(lower(text), 'de') AS INT) + CAST(contains(lower(text), 'in') AS INT)) / 2 AS score, CASE WHEN contains(lower(text), 'de') AND contains(lower(text), 'in') THEN 'complete' ELSE 'partial' END AS status FROM documents")
def _(spark, d):
    c = T.term_coverage("text", ["de", "in"])
    return Tables(spark, d).documents.select("doc_id", c.alias("score"), F.when(c == 1, "complete").otherwise("partial").alias("status"))


@query("ext_46_topic_examples", "SELECT p_partkey, kind FROM (SELECT p_partkey, 'small' AS kind FROM part WHERE p_size < 5 ORDER BY p_partkey LIMIT 10) UNION ALL SELECT p_partkey, kind FROM (SELECT p_partkey, 'large' AS kind FROM part WHERE p_size >= 45 ORDER BY p_partkey LIMIT 10)")
def _(spark, d):
    p = Tables(spark, d).part
    take = lambda cond, kind: p.where(cond).orderBy("p_partkey").limit(10).select("p_partkey", F.lit(kind).alias("kind"))
    return take("p_size < 5", "small").unionByName(take("p_size >= 45", "large"))


@query("ext_47_degraded_key", "SELECT p_partkey, coalesce(CASE WHEN p_size > 10 THEN regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') END, lower(p_type)) AS source_key FROM part")
def _(spark, d):
    return Tables(spark, d).part.select("p_partkey", F.coalesce(F.when(F.col("p_size") > 10, U.evidence_slug("p_name")), T.slug("p_type")).alias("source_key"))


@query("ext_48_topic_axis", "WITH t AS (SELECT lower(p_type) AS product, p_brand AS module, count(*) AS members FROM part GROUP BY ALL) SELECT product, module, members, CASE WHEN members = 1 THEN 'degraded' ELSE 'published' END AS status FROM t")
def _(spark, d):
    g = Tables(spark, d).part.groupBy(F.lower("p_type").alias("product"), F.col("p_brand").alias("module")).agg(F.count("*").alias("members"))
    return g.withColumn("status", F.when(F.col("members") == 1, "degraded").otherwise("published"))


@query("ext_53_reader_audit", "SELECT source, round(avg(CAST(length(text) > 200 AS INT)), 6) AS pass_ratio, avg(CAST(length(text) > 200 AS INT)) >= 0.8 AS passed FROM documents GROUP BY 1")
def _(spark, d):
    r = F.avg((F.char_length("text") > 200).cast("int"))
    return Tables(spark, d).documents.groupBy("source").agg(F.round(r, 6).alias("pass_ratio"), (r >= 0.8).alias("passed"))


@query("ext_56_one_run", "SELECT count(DISTINCT event_type) AS runs, count(DISTINCT event_type) = 1 AS one_run FROM events")
def _(spark, d):
    n = F.count_distinct("event_type")
    return Tables(spark, d).events.agg(n.alias("runs"), (n == 1).alias("one_run"))


@query("ext_58_location_case", "SELECT o_orderkey, o_orderstatus IN ('O', 'F') AND o_totalprice > 0 AND o_custkey IN (SELECT c_custkey FROM customer) AS valid FROM orders")
def _(spark, d):
    t = Tables(spark, d)
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("known"))
    return t.orders.join(c, "o_custkey", "left").select("o_orderkey", (F.col("o_orderstatus").isin("O", "F") & (F.col("o_totalprice") > 0) & F.coalesce("known", F.lit(False))).alias("valid"))
