"""Ordered per-group operators and layout."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import layout as L
from lexmill.operators.dedup import first_by_key, latest_by_key
from lexmill.operators.ledger import supersession
from lexmill.plans.base import CLAIMS, Tables, query
from lexmill.plans.scalars import MD_SQL, markdown

LINES_SQL = "l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)"


def doc_lines(t: Tables):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("pos"), "line")


@query("win_01_first_per_key", f"WITH {CLAIMS}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, claim ORDER BY line_no) AS n FROM claims) SELECT doc_id, line_no, claim FROM k WHERE n = 1")
def _(spark, d):
    return first_by_key(Tables(spark, d).claims(), ["doc_id", "claim"], "line_no").select("doc_id", "line_no", "claim")


@query("win_02_part_links", "SELECT conv_id, turn, lag('p' || conv_id || '-' || turn) OVER w AS previous, lead('p' || conv_id || '-' || turn) OVER w AS following FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(spark, d):
    path = F.concat(F.lit("p"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    return L.part_links(Tables(spark, d).conversations.withColumn("path", path), "conv_id", "turn", "path").select("conv_id", "turn", "previous", "following")


@query("win_03_supersession", "SELECT event_id, CASE WHEN p <> event_type THEN p END AS supersedes, CASE WHEN n <> event_type THEN n END AS superseded_by FROM (SELECT event_id, event_type, lag(event_type) OVER w AS p, lead(event_type) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))")
def _(spark, d):
    return supersession(Tables(spark, d).events, ["user_id"], "event_id", "event_type").select("event_id", "supersedes", "superseded_by")


@query("win_04_ordinal_alignment", f"""WITH {CLAIMS}, a AS (SELECT doc_id, claim, line_no AS lpos, row_number() OVER (PARTITION BY doc_id, claim ORDER BY line_no) AS n FROM claims),
b AS (SELECT doc_id, claim, line_no AS rpos, row_number() OVER (PARTITION BY doc_id, claim ORDER BY line_no DESC) AS n FROM claims) SELECT doc_id, claim, lpos, rpos FROM a JOIN b USING (doc_id, claim, n)""")
def _(spark, d):
    claims = Tables(spark, d).claims()
    right = claims.select("doc_id", "claim", F.col("line_no").alias("rpos"), (-F.col("line_no")).alias("back"))
    number = right.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "claim").orderBy("back")))
    left = claims.select("doc_id", "claim", F.col("line_no").alias("lpos"))
    return L.ordinal_match(left, number.select("doc_id", "claim", "rpos", "n"), "doc_id", "claim", "lpos", "n").select("doc_id", "claim", "lpos", "n").join(number, ["doc_id", "claim", "n"]).select("doc_id", "claim", "lpos", "rpos")


PACK_SQL = """WITH RECURSIVE o AS (SELECT {g} AS g, {p} AS p, {s} AS s, row_number() OVER (PARTITION BY {g} ORDER BY {p}, {s}) AS n FROM {t}),
b AS (SELECT g, p, n, s, 1 AS bin, CASE WHEN s > {m} THEN 0 ELSE s END AS run, s > {m} AS closed FROM o WHERE n = 1
UNION ALL SELECT o.g, o.p, o.n, o.s, CASE WHEN b.closed OR (b.run > 0 AND b.run + o.s > {m}) THEN b.bin + 1 ELSE b.bin END,
  CASE WHEN o.s > {m} THEN 0 WHEN b.closed OR (b.run > 0 AND b.run + o.s > {m}) THEN o.s ELSE b.run + o.s END, o.s > {m}
FROM b JOIN o ON o.g = b.g AND o.n = b.n + 1)
SELECT g AS {g}, p AS {p}, s AS {s}, bin FROM b"""


@query("win_05_page_groups", PACK_SQL.format(g="l_orderkey", p="l_linenumber", s="l_quantity", t="lineitem", m=60))
def _(spark, d):
    return L.pack_groups(Tables(spark, d).lineitem, "l_orderkey", "l_linenumber", "l_quantity", 60)


@query("win_06_chunks", f"WITH {LINES_SQL} SELECT doc_id, (pos - 1) // 240 AS chunk, count(*) AS n_lines FROM l GROUP BY ALL")
def _(spark, d):
    return L.chunks(doc_lines(Tables(spark, d)), "pos").groupBy("doc_id", "chunk").agg(F.count("*").alias("n_lines"))


@query("win_07_batch_contexts", """WITH RECURSIVE o AS (SELECT l_orderkey AS g, l_linenumber AS p, l_quantity AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS n FROM lineitem),
b AS (SELECT g, p, n, s, 1 AS bin, s AS run, 1 AS c FROM o WHERE n = 1 UNION ALL SELECT o.g, o.p, o.n, o.s, CASE WHEN b.run + o.s > 80 OR b.c >= 3 THEN b.bin + 1 ELSE b.bin END, CASE WHEN b.run + o.s > 80 OR b.c >= 3 THEN o.s ELSE b.run + o.s END, CASE WHEN b.run + o.s > 80 OR b.c >= 3 THEN 1 ELSE b.c + 1 END FROM b JOIN o ON o.g = b.g AND o.n = b.n + 1)
SELECT g AS l_orderkey, p AS l_linenumber, s AS l_quantity, bin FROM b""")
def _(spark, d):
    return L.pack_two(Tables(spark, d).lineitem, "l_orderkey", "l_linenumber", "l_quantity", 3, 80)


@query("win_08_semantic_parts", """WITH RECURSIVE o AS (SELECT conv_id AS g, turn AS p, CAST(length(text) AS DOUBLE) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
b AS (SELECT g, p, n, s, 1 AS bin, CASE WHEN s > 900 THEN 0 ELSE s END AS run, s > 900 AS closed FROM o WHERE n = 1
UNION ALL SELECT o.g, o.p, o.n, o.s, CASE WHEN b.closed OR (b.run > 0 AND b.run + o.s > 900) THEN b.bin + 1 ELSE b.bin END, CASE WHEN o.s > 900 THEN 0 WHEN b.closed OR (b.run > 0 AND b.run + o.s > 900) THEN o.s ELSE b.run + o.s END, o.s > 900 FROM b JOIN o ON o.g = b.g AND o.n = b.n + 1),
q AS (SELECT g, bin, sum(s) AS n_chars, count(*) AS n_sections FROM b GROUP BY ALL)
SELECT g AS conv_id, bin, n_chars, n_sections, lag(bin) OVER (PARTITION BY g ORDER BY bin) AS previous, lead(bin) OVER (PARTITION BY g ORDER BY bin) AS following FROM q""")
def _(spark, d):
    rows = Tables(spark, d).conversations.select("conv_id", "turn", F.char_length("text").alias("n"))
    parts = L.pack_groups(rows, "conv_id", "turn", "n", 900).groupBy("conv_id", "bin").agg(F.sum("n").alias("n_chars"), F.count("*").alias("n_sections"))
    return L.part_links(parts, "conv_id", "bin", "bin")


@query("win_10_structure_owner", f"""WITH {LINES_SQL}, c AS (SELECT doc_id, pos, CASE WHEN length(line) >= 60 THEN pos END AS claim FROM l)
SELECT doc_id, pos, CAST(coalesce(first_value(claim IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(claim IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS INTEGER) AS owner FROM c""")
def _(spark, d):
    rows = doc_lines(Tables(spark, d)).withColumn("claim", F.when(F.char_length("line") >= 60, F.col("pos")))
    return L.owner_of_structure(rows, "doc_id", "pos", "claim").select("doc_id", "pos", "owner")


@query("win_11_heading_parents", """WITH f AS (SELECT o_custkey, o_orderkey, CASE o_orderpriority[1:1] WHEN '1' THEN 1 WHEN '2' THEN 2 ELSE 3 END AS level FROM orders)
SELECT a.o_orderkey, (SELECT max(b.o_orderkey) FROM f b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey < a.o_orderkey AND b.level < a.level) AS parent FROM f a""")
def _(spark, d):
    p = F.substring("o_orderpriority", 1, 1)
    rows = Tables(spark, d).orders.withColumn("level", F.when(p == "1", 1).when(p == "2", 2).otherwise(3))
    return L.parents(rows, "o_custkey", "o_orderkey", "level").select("o_orderkey", "parent")


@query("win_12_first_owner", f"WITH {CLAIMS} SELECT doc_id, claim, min(line_no) AS owner FROM claims GROUP BY ALL")
def _(spark, d):
    return Tables(spark, d).claims().groupBy("doc_id", "claim").agg(F.min("line_no").alias("owner"))


@query("win_13_blank_runs", f"""WITH {LINES_SQL}, b AS (SELECT doc_id, pos, trim(line) = '' OR length(line) < 40 AS blank FROM l), i AS (SELECT *, sum(CASE WHEN blank THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS isl FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, isl, blank ORDER BY pos) AS n FROM i) SELECT doc_id, count(*) AS n_lines FROM r WHERE NOT blank OR n <= 2 GROUP BY doc_id""")
def _(spark, d):
    rows = doc_lines(Tables(spark, d)).withColumn("line", F.when(F.char_length("line") < 40, "").otherwise(F.col("line")))
    return L.blank_runs(rows, "doc_id", "pos", "line").groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query("win_14_batch_index", "SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 AS batch FROM documents")
def _(spark, d):
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return Tables(spark, d).documents.select("doc_id", F.floor((n - 1) / 20).cast("long").alias("batch"))


@query("ext_25_section_table", f"WITH {MD_SQL}, l AS (SELECT conv_id, generate_subscripts(string_split(md, chr(10)), 1) AS pos, unnest(string_split(md, chr(10))) AS line FROM md), h AS (SELECT *, regexp_matches(line, '^#{{1,6}}\\s+') AS head FROM l), s AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY conv_id ORDER BY pos) AS section_no FROM h) SELECT conv_id, CAST(section_no AS BIGINT) AS section_no, max(CASE WHEN head THEN regexp_replace(line, '^#{{1,6}}\\s+', '') END) AS heading, CAST(max(CASE WHEN head THEN length(regexp_extract(line, '^(#+)', 1)) END) AS INTEGER) AS level, count(*) FILTER (NOT head) AS n_lines FROM s GROUP BY conv_id, section_no")
def _(spark, d):
    return L.sections(markdown(Tables(spark, d)), "conv_id", "md")


@query("nav_03_module_prefixes", "WITH p AS (SELECT p_type || '/' || p_brand || '/' || p_name AS path FROM part), x AS (SELECT array_to_string(string_split(path, '/')[1:i], '/') AS prefix, i AS depth FROM p, range(1, 4) t(i)) SELECT prefix, CAST(depth AS INTEGER) AS depth, count(*) AS n FROM x GROUP BY ALL")
def _(spark, d):
    return L.module_prefixes(Tables(spark, d).part.select(F.concat_ws("/", "p_type", "p_brand", "p_name").alias("path")), "path")


@query("nav_02_topic_rows", "SELECT p_partkey, p_name, 'kept' AS state FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT DISTINCT l_partkey, p_name, 'laid out' FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'")
def _(spark, d):
    t = Tables(spark, d)
    new = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct()
    kept = t.part.join(new, "p_partkey", "left_anti").select("p_partkey", "p_name", F.lit("kept").alias("state"))
    return kept.unionByName(t.part.join(new, "p_partkey", "left_semi").select("p_partkey", "p_name", F.lit("laid out").alias("state")))


@query("nav_04_source_index", "SELECT source, count(*) AS n_sources, count(DISTINCT text) AS n_contents, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY source")
def _(spark, d):
    return Tables(spark, d).documents.groupBy("source").agg(F.count("*").alias("n_sources"), F.count_distinct(F.sha2("text", 256)).alias("n_contents"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"))


@query("lay_03_render_page", "SELECT conv_id, turn, '# ' || role || chr(10) || chr(10) || text || chr(10) || chr(10) || '## Sources' || chr(10) || '- conv/' || conv_id AS page FROM conversations")
def _(spark, d):
    page = F.concat_ws("\n", F.concat(F.lit("# "), "role"), F.lit(""), "text", F.lit(""), F.lit("## Sources"), F.concat(F.lit("- conv/"), F.col("conv_id").cast("string")))
    return Tables(spark, d).conversations.select("conv_id", "turn", page.alias("page"))


@query("lay_05_keep_entries", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def _(spark, d):
    t = Tables(spark, d)
    kept = t.part.where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    gone = t.supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return t.lineitem.join(kept, "l_partkey", "left_semi").join(gone, "l_suppkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("lay_08_contribution_body", "SELECT l_partkey, l_suppkey, arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS first_order FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY ALL")
def _(spark, d):
    t = Tables(spark, d)
    old = t.part.where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    rows = t.lineitem.join(old, "l_partkey", "left_anti")
    return rows.groupBy("l_partkey", "l_suppkey").agg(F.min_by("l_orderkey", F.struct("l_orderkey", "l_linenumber")).alias("first_order"))


@query("ext_08_previous_record", "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def _(spark, d):
    return latest_by_key(Tables(spark, d).events, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value")


@query("ext_16_title_candidates", r"SELECT DISTINCT conv_id, title FROM (SELECT conv_id, 'Conversation ' || conv_id AS title FROM conversations UNION ALL SELECT conv_id, role FROM conversations)")
def _(spark, d):
    md = markdown(Tables(spark, d)).select("conv_id", T.first_heading("md").alias("title"))
    return md.unionByName(Tables(spark, d).conversations.select("conv_id", F.col("role").alias("title"))).distinct()
