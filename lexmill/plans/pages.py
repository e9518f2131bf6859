"""Page building over documents whose lines carry markers: headings, questions, lines that no source supports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import pages as P
from lexmill.operators.layout import nested_sections
from lexmill.plans.base import Tables, query
from lexmill.plans.windows import PACK_SQL

MOST = 12

#: Every ninth line is a heading, every fifth of nine a question, every eighth unsupported; the SQL knows no code fences, and none occur.
MARKED_SQL = r"""l AS (SELECT doc_id, p, CASE p % 9 WHEN 0 THEN '## ' || line WHEN 4 THEN 'FAQ: ' || line WHEN 7 THEN 'unsupported: ' || line ELSE line END AS line FROM (SELECT doc_id, generate_subscripts(string_split(regexp_replace(text, '\n$', ''), chr(10)), 1) AS p, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS line FROM documents)),
cl AS (SELECT *, CASE WHEN trim(line) = '' THEN 'b' WHEN regexp_matches(line, '^\s*#{1,6}\s+') THEN 'h' WHEN regexp_matches(line, '(?i)^\s*(?:FAQ|Q(?:uestion)?)[\s:：]') THEN 'f' WHEN regexp_matches(line, '(?i)^\s*(?:Error\s+)?[A-Z][A-Z0-9_-]*[0-9]+[\s:：-]') THEN 'e' WHEN regexp_matches(line, '(?i)^\s*(?:[-*]\s*)?(?:parameter|param|argument)\b[^:：]*[:：]') THEN 'p' ELSE 't' END AS c FROM l),
m AS (SELECT doc_id, regexp_extract_all(string_agg(c, '' ORDER BY p), '([fep][tb]*|h[tb]*|[tb]b*)', 1) AS m FROM cl GROUP BY doc_id),
u AS (SELECT doc_id, generate_subscripts(m, 1) AS component, unnest(m) AS s FROM m),
sp AS (SELECT doc_id, CAST(component AS INTEGER) AS component, CAST(sum(length(s)) OVER w - length(s) + 1 AS INTEGER) AS line_start, CAST(sum(length(s)) OVER w AS INTEGER) AS line_end, CAST(length(s) AS INTEGER) AS size FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY component))"""
PLACED_SQL = f"""{MARKED_SQL}, pk AS ({PACK_SQL.format(g="doc_id", p="component", s="size", t="sp", m=MOST)}),
pl AS (SELECT sp.doc_id, sp.component, line_start, line_end, bin AS page, sp.size > {MOST} AS oversized FROM sp JOIN pk ON pk.doc_id = sp.doc_id AND pk.component = sp.component),
sh AS (SELECT l.doc_id, component, page, p, trim(line) = '' AS blank, row_number() OVER (PARTITION BY l.doc_id, page ORDER BY p) AS n FROM l JOIN pl ON pl.doc_id = l.doc_id AND l.p BETWEEN line_start AND line_end WHERE NOT starts_with(lower(trim(line)), 'unsupported:')),
rd AS (SELECT doc_id, component, page, p, n - min(n) FILTER (NOT blank) OVER (PARTITION BY doc_id, page) + 1 AS place, blank FROM sh),
vis AS (SELECT * FROM rd WHERE NOT blank)"""


def marked(t: Tables):
    """doc_id, md: each document with markers at the beginning of its lines."""
    mark = lambda line, i: F.when((i + 1) % 9 == 0, F.concat(F.lit("## "), line)).when((i + 1) % 9 == 4, F.concat(F.lit("FAQ: "), line)).when((i + 1) % 9 == 7, F.concat(F.lit("unsupported: "), line)).otherwise(line)
    return t.documents.where("text IS NOT NULL").select("doc_id", F.array_join(F.transform(T.lines("text"), mark), "\n").alias("md"))


def placed(docs):
    return P.place_components(docs, "doc_id", "md", MOST)


@query("lay_02_page_components", f"WITH RECURSIVE {PLACED_SQL} SELECT doc_id, component, line_start, line_end, page, oversized FROM pl")
def _(spark, d):
    return placed(marked(Tables(spark, d))).select("doc_id", "component", "line_start", "line_end", "page", "oversized")


@query("lay_02_claim_places", f"""WITH RECURSIVE {PLACED_SQL}, k AS (SELECT doc_id, p AS claim, p AS line_start, p + CAST(p % 3 AS INTEGER) AS line_end FROM l WHERE trim(line) <> '' AND p % 9 <> 0)
SELECT k.doc_id, k.claim, pl.component, pl.page, CAST(min(v.place) AS INTEGER) AS out_start, CAST(max(v.place) AS INTEGER) AS out_end FROM k LEFT JOIN pl ON pl.doc_id = k.doc_id AND k.line_start BETWEEN pl.line_start AND pl.line_end
LEFT JOIN vis v ON v.doc_id = k.doc_id AND v.component = pl.component AND v.p BETWEEN k.line_start AND k.line_end GROUP BY ALL""")
def _(spark, d):
    # a claim begins at every line that is no heading, and takes up to two more
    docs = marked(Tables(spark, d))
    lines = docs.select("doc_id", F.posexplode(T.lines("md")).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("claim"), "line")
    claims = lines.where((T.strip("line") != "") & (F.col("claim") % 9 != 0)).select("doc_id", "claim", F.col("claim").alias("line_start"), (F.col("claim") + F.col("claim") % 3).alias("line_end"))
    at = placed(docs)
    return P.claim_places(claims, "doc_id", at, P.rendered_lines(docs, "doc_id", "md", at))


@query("lay_02_component_places", f"WITH RECURSIVE {PLACED_SQL} SELECT pl.doc_id, pl.component, CASE WHEN count(v.place) > 0 THEN pl.page END AS page, CAST(min(v.place) AS INTEGER) AS out_start, CAST(max(v.place) AS INTEGER) AS out_end, count(v.place) = 0 AS omitted FROM pl LEFT JOIN vis v ON v.doc_id = pl.doc_id AND v.component = pl.component GROUP BY pl.doc_id, pl.component, pl.page")
def _(spark, d):
    docs = marked(Tables(spark, d))
    at = placed(docs)
    return P.component_places(at, "doc_id", P.rendered_lines(docs, "doc_id", "md", at))


@query("lay_02_uneven_cover", f"""WITH {MARKED_SQL}, spans AS (SELECT doc_id, line_start, line_end FROM sp WHERE NOT (doc_id % 5 = 1 AND component % 4 = 2) UNION ALL SELECT doc_id, line_start, line_end + 2 FROM sp WHERE doc_id % 5 = 2 AND component % 3 = 1 UNION ALL SELECT doc_id, 3, 9 FROM sp WHERE doc_id % 7 = 3 AND component = 1),
x AS (SELECT doc_id, max(line_end) AS n FROM sp GROUP BY 1), a AS (SELECT DISTINCT doc_id, unnest(range(line_start, line_end + 1)) AS p FROM spans UNION SELECT doc_id, unnest(range(1, n + 1)) FROM x),
o AS (SELECT a.doc_id, a.p, count(s.doc_id) AS owners, a.p <= n AS inside FROM a JOIN x ON x.doc_id = a.doc_id LEFT JOIN spans s ON s.doc_id = a.doc_id AND a.p BETWEEN s.line_start AND s.line_end GROUP BY ALL),
g AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, owners, inside ORDER BY p) AS island FROM o WHERE owners <> 1 OR NOT inside)
SELECT doc_id, CAST(min(p) AS BIGINT) AS line_start, CAST(max(p) AS BIGINT) AS line_end, owners FROM g GROUP BY doc_id, owners, inside, island""")
def _(spark, d):
    # some components are missing, some have two owners, and some owners reach over the end
    at = placed(marked(Tables(spark, d)))
    k, c = F.col("doc_id"), F.col("component")
    own = at.where(~((k % 5 == 1) & (c % 4 == 2))).select("doc_id", "line_start", "line_end")
    twice = at.where((k % 5 == 2) & (c % 3 == 1)).select("doc_id", "line_start", (F.col("line_end") + 2).alias("line_end"))
    over = at.where((k % 7 == 3) & (c == 1)).select("doc_id", F.lit(3).alias("line_start"), F.lit(9).alias("line_end"))
    extents = at.groupBy("doc_id").agg(F.lit(1).alias("low"), F.max("line_end").alias("high"))
    return P.uneven_cover(own.unionByName(twice).unionByName(over), "doc_id", "line_start", "line_end", extents, "low", "high")


@query("agg_07_layouts", f"""WITH RECURSIVE {MARKED_SQL}, tp AS (SELECT doc_id % 50 AS topic, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id, component) AS pos, size FROM sp), pk AS ({PACK_SQL.format(g="topic", p="pos", s="size", t="tp", m=MOST)})
SELECT topic, (SELECT count(*) FROM documents d WHERE d.text IS NOT NULL AND d.doc_id % 50 = topic) AS n_drafts, CAST(sum(size) AS BIGINT) AS n_lines, max(bin) AS n_pages, (SELECT min(doc_id) FROM documents d WHERE d.text IS NOT NULL AND d.doc_id % 50 = topic) AS first_key, count(*) FILTER (size > {MOST}) AS oversized FROM pk GROUP BY topic""")
def _(spark, d):
    docs = marked(Tables(spark, d))
    return P.topic_layouts(docs.select((F.col("doc_id") % 50).alias("topic"), "doc_id"), placed(docs), "doc_id", MOST)


#: Conversations as pages whose headings have four levels.
DEEP_SQL = r"""dp AS (SELECT conv_id, string_agg(repeat('#', CAST(1 + turn * 3 % 4 AS INTEGER)) || ' ' || role || ' ' || turn || chr(10) || CASE WHEN turn % 5 = 2 THEN '--' ELSE text END, chr(10) ORDER BY turn) AS md FROM conversations GROUP BY conv_id),
dl AS (SELECT conv_id, generate_subscripts(string_split(md, chr(10)), 1) AS p, unnest(string_split(md, chr(10))) AS line FROM dp),
lv AS (SELECT *, CASE WHEN regexp_matches(line, '^#{1,6}\s+') THEN length(regexp_extract(line, '^(#+)', 1)) END AS level FROM dl),
st AS (SELECT a.conv_id, a.p, a.level, a.line, coalesce((SELECT min(b.p) FROM lv b WHERE b.conv_id = a.conv_id AND b.p > a.p AND b.level <= a.level), (SELECT max(b.p) + 1 FROM lv b WHERE b.conv_id = a.conv_id)) AS stop FROM lv a WHERE a.level IS NOT NULL),
ns AS (SELECT s.conv_id, s.p, s.level, s.line, s.stop - 1 AS line_end, coalesce(string_agg(b.line, chr(10) ORDER BY b.p) FILTER (b.level IS NULL AND b.p IS NOT NULL), '') AS body FROM st s LEFT JOIN lv b ON b.conv_id = s.conv_id AND b.p > s.p AND b.p < s.stop GROUP BY ALL)"""


@query("ext_26_sections_with_body", rf"WITH {DEEP_SQL} SELECT conv_id, p AS line_no, regexp_replace(line, '^#{{1,6}}\s+', '') AS heading, CAST(level AS INTEGER) AS level, line_end, sha256(body) AS body, length(regexp_replace(body, '[^\p{{L}}\p{{N}}]+', '', 'g')) >= 4 AS substantive FROM ns")
def _(spark, d):
    turn = F.concat(F.repeat(F.lit("#"), (1 + F.col("turn") * 3 % 4).cast("int")), F.lit(" "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.when(F.col("turn") % 5 == 2, "--").otherwise(F.col("text")))
    parts = Tables(spark, d).conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", turn.alias("s")))).alias("p"))
    docs = parts.select("conv_id", F.array_join(F.transform("p", lambda x: x["s"]), "\n").alias("md"))
    return nested_sections(docs, "conv_id", "md").withColumn("body", F.sha2("body", 256))
