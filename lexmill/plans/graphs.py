"""Link graphs over pages and the key graph of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import graph as G
from lexmill.operators import routes as W
from lexmill.plans.base import Tables, query

EDGE_SQL = """links AS (SELECT page_id, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS pos, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages),
local AS (SELECT page_id, pos, regexp_replace(target, '#.*$', '') AS target FROM links WHERE regexp_replace(target, '#.*$', '') <> '' AND NOT regexp_matches(target, '^(?i)(https?|mailto|ftp|data):'))"""
SUPPLY_SQL = "e AS (SELECT DISTINCT l_suppkey AS src, (l_partkey * 7 + l_suppkey) % (SELECT count(*) FROM supplier) AS dst FROM lineitem)"


def supply(t: Tables):
    """src, dst, pos: suppliers, linked through the parts that they delivered, over all lines."""
    n = t.supplier.agg(F.count("*").alias("n"))
    rows = t.lineitem.crossJoin(F.broadcast(n))
    return rows.select(F.col("l_suppkey").alias("src"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % F.col("n")).alias("dst"), F.lit(0).alias("pos")).distinct()


@query("grf_01_link_edges", f"WITH {EDGE_SQL} SELECT page_id, CAST(pos AS INTEGER) AS pos, target FROM local")
def _(spark, d):
    return G.links(Tables(spark, d).pages, "page_id", "html").select("page_id", "pos", "target")


@query("grf_02_wiki_links", r"""WITH w AS (SELECT page_id, regexp_replace(html, '<a href="([^"]*)">([^<]*)</a>', '[[\1|\2]]', 'g') AS t FROM pages), x AS (SELECT page_id, unnest(regexp_extract_all(t, '\[\[([^\]|]*)\|?[^\]]*\]\]', 1)) AS target FROM w) SELECT page_id, target, count(*) AS n FROM x GROUP BY ALL""")
def _(spark, d):
    wiki = F.regexp_replace("html", r'<a href="([^"]*)">([^<]*)</a>', "[[$1|$2]]")
    found = F.regexp_extract_all(wiki, F.lit(r"\[\[([^\]|]*)\|?[^\]]*\]\]"), 1)
    return Tables(spark, d).pages.select("page_id", F.explode(found).alias("target")).groupBy("page_id", "target").agg(F.count("*").alias("n"))


@query("grf_03_normal_target", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a/c/x.md' WHEN 1 THEN 'a/x.md' WHEN 2 THEN 'a/b/x.md' END AS target FROM pages""")
def _(spark, d):
    raw = F.element_at(F.array(*map(F.lit, ("../c/./x.md", "../x.md", "x.md", "../../../x.md"))), (F.col("page_id") % 4 + 1).cast("int"))
    return Tables(spark, d).pages.select("page_id", G.normalized_target(F.lit("a/b/page.md"), raw).alias("target"))


@query("grf_04_reachable", f"WITH RECURSIVE {SUPPLY_SQL}, r AS (SELECT CAST(1 AS BIGINT) AS node UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r")
def _(spark, d):
    start = spark.createDataFrame([(1,)], "node long")
    return G.hops(supply(Tables(spark, d)), start).select("node")


@query("grf_05_routes")
def _(spark, d):
    return G.routes(supply(Tables(spark, d)), 1).select("node", "hops", F.array_join("route", ">").alias("route"))


@query("grf_07_route_hops", f"WITH RECURSIVE {SUPPLY_SQL}, r AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS hops UNION SELECT e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.node WHERE r.hops < 20) SELECT node, min(hops) AS hops FROM r GROUP BY node")
def _(spark, d):
    return G.routes(supply(Tables(spark, d)), 1).select("node", "hops")


@query("grf_06_hop_count", f"WITH RECURSIVE {SUPPLY_SQL}, r AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS hops UNION SELECT e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.node WHERE r.hops < 3) SELECT node, min(hops) AS hops FROM r GROUP BY node")
def _(spark, d):
    return G.hops(supply(Tables(spark, d)), spark.createDataFrame([(1,)], "node long"), 3)


@query("grf_08_broken_links", f"WITH {EDGE_SQL}, p AS (SELECT DISTINCT regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS path FROM pages) SELECT page_id, target FROM local WHERE target NOT IN (SELECT path FROM p)")
def _(spark, d):
    pages = Tables(spark, d).pages
    edges = G.links(pages, "page_id", "html").select(F.col("page_id").alias("src"), F.col("target").alias("dst"))
    nodes = pages.select(F.regexp_extract("url", "^[^:]*://[^/?#]*([^?#]*)", 1).alias("node")).distinct()
    return G.broken(edges, nodes).select(F.col("src").alias("page_id"), F.col("dst").alias("target"))


@query("join_28_bidirectional", f"WITH {SUPPLY_SQL} SELECT src, dst FROM e EXCEPT SELECT dst, src FROM e")
def _(spark, d):
    return G.one_way(supply(Tables(spark, d)))


@query("grf_09_walk_validity", "WITH w AS (SELECT o_custkey, o_orderkey, o_orderstatus AS src, lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dst, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders) SELECT o_custkey, CAST(pos AS INTEGER) AS pos, src, dst FROM w WHERE dst IS NOT NULL AND NOT (src, dst) IN (('O', 'O'), ('O', 'F'), ('F', 'F'), ('F', 'O'))")
def _(spark, d):
    walks = Tables(spark, d).orders.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"]).alias("jumps"))
    edges = spark.createDataFrame([("O", "O"), ("O", "F"), ("F", "F"), ("F", "O")], "src string, dst string")
    return G.broken_jumps(walks, "o_custkey", "jumps", edges)


@query("grf_10_impact_closure", f"WITH {SUPPLY_SQL}, s AS (SELECT s_suppkey AS node FROM supplier WHERE s_acctbal < 0) SELECT node FROM s UNION SELECT dst FROM e WHERE src IN (SELECT node FROM s) UNION SELECT src FROM e WHERE dst IN (SELECT node FROM s)")
def _(spark, d):
    from lexmill.operators.joins import one_hop

    t = Tables(spark, d)
    return one_hop(supply(t), t.supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("node")))


@query("join_14_edge_closure", f"WITH {SUPPLY_SQL}, s AS (SELECT s_suppkey AS node FROM supplier WHERE s_acctbal > 9000) SELECT node FROM s UNION SELECT dst FROM e WHERE src IN (SELECT node FROM s) UNION SELECT src FROM e WHERE dst IN (SELECT node FROM s)")
def _(spark, d):
    from lexmill.operators.joins import one_hop

    t = Tables(spark, d)
    return one_hop(supply(t), t.supplier.where("s_acctbal > 9000").select(F.col("s_suppkey").alias("node")))


@query("grf_12_old_path_state", "SELECT p_partkey, CASE WHEN l_partkey IS NULL THEN 'deprecated' ELSE 'alias' END AS state FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 49) ON l_partkey = p_partkey")
def _(spark, d):
    t = Tables(spark, d)
    live = t.lineitem.where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("live", F.lit(True))
    return t.part.join(live, "p_partkey", "left").select("p_partkey", F.when(F.col("live"), "alias").otherwise("deprecated").alias("state"))


@query("grf_13_route_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_orderpriority DESC, -o_totalprice DESC, o_orderkey) AS rank FROM orders")
def _(spark, d):
    from pyspark.sql import Window

    rank = F.struct((F.col("o_orderstatus") == "F").alias("reachable"), F.col("o_orderpriority").alias("kind"), (-F.col("o_totalprice")).alias("hops"))
    return Tables(spark, d).orders.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc(rank), "o_orderkey")).cast("long").alias("rank"))


@query("ext_32_reachable_wide", f"WITH RECURSIVE {SUPPLY_SQL}, w AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT CAST(1 AS BIGINT) AS node UNION SELECT w.dst FROM r JOIN w ON w.src = r.node) SELECT node FROM r")
def _(spark, d):
    e = supply(Tables(spark, d)).select("src", "dst")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return G.hops(both, spark.createDataFrame([(1,)], "node long")).select("node")


#: A question for each supplier: from the first supplier of its nation (every seventh from nowhere) to itself (every tenth to no page).
QUESTION_SQL = f"""{SUPPLY_SQL}, page AS (SELECT s_suppkey AS node FROM supplier), edge AS (SELECT src, dst FROM e WHERE dst IN (SELECT node FROM page)),
q AS (SELECT s_suppkey AS question, CASE WHEN s_suppkey % 7 = 3 THEN -1 ELSE min(s_suppkey) OVER (PARTITION BY s_nationkey) END AS entry, CASE WHEN s_suppkey % 10 = 4 THEN s_suppkey + 1000000 ELSE s_suppkey END AS target FROM supplier),
start AS (SELECT DISTINCT entry FROM q WHERE entry IN (SELECT node FROM page)),
walks AS (SELECT entry, entry AS node, 0 AS hops FROM start UNION SELECT w.entry, edge.dst, w.hops + 1 FROM walks w JOIN edge ON edge.src = w.node WHERE w.hops < 20),
h AS MATERIALIZED (SELECT entry, node, min(hops) AS hops FROM walks GROUP BY ALL),
route AS (SELECT entry, entry AS node, 0 AS hops, [entry] AS path FROM start UNION ALL
  SELECT * FROM (SELECT r.entry, edge.dst AS node, r.hops + 1 AS hops, min(list_append(r.path, edge.dst)) AS path FROM route r JOIN edge ON edge.src = r.node JOIN h ON h.entry = r.entry AND h.node = edge.dst AND h.hops = r.hops + 1 GROUP BY ALL)),
answered AS (SELECT question, q.entry, target, CASE WHEN r.hops IS NOT NULL THEN 'reached' WHEN q.entry NOT IN (SELECT node FROM page) THEN 'entry_missing' WHEN target NOT IN (SELECT node FROM page) THEN 'target_missing' ELSE 'unreachable' END AS status, r.hops, r.path FROM q LEFT JOIN route r ON r.entry = q.entry AND r.node = target)"""


def questions(t: Tables):
    k = F.col("s_suppkey")
    first = t.supplier.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("first"))
    rows = t.supplier.join(first, "s_nationkey")
    return rows.select(k.alias("question"), F.when(k % 7 == 3, F.lit(-1)).otherwise(F.col("first")).cast("long").alias("entry"), F.when(k % 10 == 4, k + 1000000).otherwise(k).cast("long").alias("target"))


def routed(t: Tables):
    pages = t.supplier.select(F.col("s_suppkey").cast("long").alias("node"))
    return W.question_routes(supply(t).withColumn("pos", F.col("dst")), pages, questions(t))


@query("gte_11_question_routes", f"WITH RECURSIVE {QUESTION_SQL} SELECT question, entry, target, status, hops, array_to_string(path, '>') AS route FROM answered")
def _(spark, d):
    return routed(Tables(spark, d)).withColumn("route", F.array_join("route", ">"))


@query("gte_11_navigation_codes", f"""WITH RECURSIVE {QUESTION_SQL}, a AS (SELECT *, question % 5 <> 2 AS positive, CASE question % 6 WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN path IS NOT NULL THEN list_append(path, -5) END ELSE path END AS jumps, CASE question % 4 WHEN 0 THEN target WHEN 1 THEN 0 END AS hit FROM answered)
SELECT question, 'ROUTE_MISSING' AS code FROM a WHERE path IS NULL UNION ALL SELECT question, 'JUMPS_INVALID' FROM a WHERE jumps IS NULL UNION ALL SELECT question, 'JUMPS_OFF_ROUTE' FROM a WHERE jumps <> path
UNION ALL SELECT question, 'HIT_OFF_TARGET' FROM a WHERE positive AND hit <> target UNION ALL SELECT question, 'NEGATIVE_HIT' FROM a WHERE NOT positive AND hit IS NOT NULL""")
def _(spark, d):
    # answers that follow the route, leave it, or say nothing
    found = routed(Tables(spark, d))
    k = F.col("question")
    jumps = F.when(k % 6 == 0, F.lit(None)).when(k % 6 == 1, F.concat("route", F.array(F.lit(-5).cast("long")))).otherwise(F.col("route"))
    hit = F.when(k % 4 == 0, F.col("target")).when(k % 4 == 1, F.lit(0).cast("long"))
    return W.check_jumps(found.select("question", (k % 5 != 2).alias("positive"), jumps.alias("jumps"), hit.alias("first_hit")), found)
