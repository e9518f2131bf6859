"""Candidates, two-layer pages, reused sections, source entries and inventories over conversations and documents, with faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import candidates as C
from lexmill.operators import contracts as K
from lexmill.operators import inventory as I
from lexmill.plans.base import SOURCES, Tables, query
from lexmill.plans.drafts import CODES_SQL, checked, drafts
from lexmill.plans.scalars import FOLD, GATE, SQUEEZE

#: Turns as claims; the fault of a conversation's candidate follows from its number.
CANDIDATE_SQL = f"""s AS (SELECT conv_id AS draft, turn, conv_id % 11 AS k, 'doc://' || conv_id AS uri, text, sha256('doc://' || conv_id || chr(10) || {FOLD.format(SQUEEZE.format('text'))}) AS fp, 'lines:' || turn || '-' || turn AS locator FROM conversations),
c AS (SELECT draft, turn, k, CASE WHEN k = 2 AND turn = 0 THEN NULL ELSE uri END AS uri, text, CASE WHEN k = 3 AND turn = 0 THEN 'x' ELSE fp END AS fp, CASE WHEN k = 5 AND turn = 0 THEN 'lines:9-9' ELSE locator END AS locator, uri AS real FROM s WHERE NOT (k = 6 AND turn = 0)
  UNION ALL SELECT draft, 99, k, uri, 'Foreign words.', sha256(uri || chr(10) || 'foreign words.'), 'lines:1-1', uri FROM s WHERE k = 4 AND turn = 0),
d AS (SELECT draft, k, string_agg(text, chr(10) ORDER BY turn) FILTER (NOT (k = 8 AND turn = 0)) AS body FROM s GROUP BY ALL),
due AS (SELECT draft, fp, count(*) AS due FROM s GROUP BY ALL), giv AS (SELECT draft, fp, count(*) AS given FROM c GROUP BY ALL),
lost AS (SELECT draft, sum(greatest(due - coalesce(given, 0), 0)) AS lost, sum(due) AS eligible FROM due LEFT JOIN giv USING (draft, fp) GROUP BY 1),
j AS (SELECT c.*, due.due, EXISTS (SELECT 1 FROM s WHERE s.draft = c.draft AND s.fp = c.fp AND s.turn = c.turn AND s.locator = c.locator) AS placed, NOT (c.k = 7 AND c.turn = 0) AND EXISTS (SELECT 1 FROM s WHERE s.draft = c.draft AND s.turn = c.turn AND s.locator = c.locator) AS covered, {GATE.format('body')} AS b, {GATE.format('text')} AS x FROM c LEFT JOIN due ON due.draft = c.draft AND due.fp = c.fp JOIN d ON d.draft = c.draft),
e AS (SELECT draft, count(*) AS n, bool_or(uri IS NULL) AS unlinked, bool_or(uri IS NOT NULL AND fp <> sha256(uri || chr(10) || {FOLD.format(SQUEEZE.format('text'))})) AS forged, bool_or(due IS NULL) AS foreign_, bool_or(NOT placed) AS misplaced, count(DISTINCT (turn, locator)) AS spots, count(DISTINCT (turn, locator)) FILTER (covered) AS held, bool_or(NOT contains(b, x)) AS unfaithful FROM j GROUP BY 1),
v AS (SELECT d.draft, CASE WHEN k = 1 THEN 'marked_invalid' WHEN unlinked THEN 'lineage_missing' WHEN forged THEN 'fingerprint_differs' WHEN foreign_ THEN 'not_in_source' WHEN misplaced THEN 'lineage_differs' WHEN lost > 0 THEN 'claim_dropped' WHEN held < spots THEN 'coverage_incomplete' WHEN unfaithful THEN 'not_faithful' WHEN k = 9 THEN 'structure_dropped' END AS reason, coalesce(held / spots, 1.0) AS ratio, coalesce(n, 0) / eligible AS kept, lost FROM d LEFT JOIN e ON e.draft = d.draft LEFT JOIN lost ON lost.draft = d.draft)"""


@query("gte_01_candidate_reasons", f"WITH {CANDIDATE_SQL} SELECT draft, reason IS NULL AS valid, reason, CASE WHEN coalesce(reason, 'coverage_incomplete') IN ('coverage_incomplete', 'not_faithful', 'structure_dropped') THEN round(ratio, 9) ELSE 0.0 END AS coverage_ratio, CASE WHEN reason IS NULL THEN round(kept, 9) ELSE 0.0 END AS retained_ratio, CASE WHEN reason = 'claim_dropped' THEN CAST(lost AS BIGINT) ELSE 0 END AS n_missing FROM v")
def _(spark, d):
    t = Tables(spark, d)
    k, first = F.col("draft") % 11, F.col("turn") == 0
    uri = F.concat(F.lit("doc://"), F.col("conv_id").cast("string"))
    at = F.concat(F.lit("lines:"), F.col("turn").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    s = t.conversations.select(F.col("conv_id").alias("draft"), "turn", uri.alias("source_uri"), "text", T.claim_fingerprint(uri, F.col("text")).alias("fingerprint"), F.col("turn").alias("raw_id"), at.alias("locator"))
    changed = s.where(~((k == 6) & first)).withColumn("source_uri", F.when(~((k == 2) & first), F.col("source_uri"))).withColumn("fingerprint", F.when((k == 3) & first, "x").otherwise(F.col("fingerprint"))).withColumn("locator", F.when((k == 5) & first, "lines:9-9").otherwise(F.col("locator")))
    foreign = s.where((k == 4) & first).withColumn("text", F.lit("Foreign words.")).withColumn("fingerprint", T.claim_fingerprint("source_uri", F.lit("Foreign words."))).withColumn("raw_id", F.lit(99).cast("long")).withColumn("locator", F.lit("lines:1-1"))
    coverage = s.where(~((k == 7) & first)).select("draft", "raw_id", "locator", F.lit("page").alias("page"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~((k == 8) & first), F.struct("turn", "text")))), lambda x: x["text"]), "\n")
    pages = s.groupBy("draft").agg(body.alias("body")).withColumn("invalid_reason", F.when(k == 1, "generator failed"))
    structure = s.where(first & (k == 9)).select("draft", F.lit("## Kept heading").alias("line"))
    out = C.candidate_gate(pages, s.drop("turn"), changed.unionByName(foreign).drop("turn"), coverage, structure)
    return out.withColumn("coverage_ratio", F.round("coverage_ratio", 9)).withColumn("retained_ratio", F.round("retained_ratio", 9))


#: Conversations as two-layer pages, a section and a claim for each turn.
LAYER_SQL = """p AS (SELECT conv_id, conv_id % 9 AS k, min(turn) AS lo, max(turn) AS hi FROM conversations GROUP BY 1),
s AS (SELECT c.conv_id, k, CASE WHEN k = 5 AND turn = hi THEN 's' || lo ELSE 's' || turn END AS section, CASE WHEN k = 6 OR turn % 2 = 0 THEN 'usage' ELSE 'rules' END AS layer, turn, lo, hi,
  CASE WHEN k = 2 AND turn = hi THEN [] WHEN k = 1 AND turn = lo AND lo < hi THEN ['c' || turn, 'c' || hi] WHEN k = 4 AND turn = lo THEN ['c' || turn, 'zz'] ELSE ['c' || turn] END AS ids FROM conversations c JOIN p USING (conv_id)),
o AS (SELECT conv_id, unnest(ids) AS claim FROM s), w AS (SELECT conv_id, claim, count(*) AS n FROM o GROUP BY ALL), cat AS (SELECT conv_id, 'c' || turn AS claim FROM conversations)
SELECT conv_id AS page_id, 'CLAIM_UNKNOWN' AS code, claim AS detail FROM w WHERE (conv_id, claim) NOT IN (SELECT (conv_id, claim) FROM cat) UNION ALL SELECT conv_id, 'CLAIM_UNOWNED', claim FROM cat WHERE (conv_id, claim) NOT IN (SELECT (conv_id, claim) FROM w)
UNION ALL SELECT w.conv_id, 'CLAIM_OWNED_TWICE', w.claim FROM w JOIN cat USING (conv_id, claim) WHERE n > 1 UNION ALL SELECT conv_id, 'SECTION_WITHOUT_CLAIMS', section FROM s WHERE len(ids) = 0
UNION ALL SELECT conv_id, 'CONTENT_UNALIGNED', section FROM s WHERE k = 3 AND turn = lo UNION ALL SELECT conv_id, 'SECTION_IDS', section FROM s GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT conv_id, 'LAYER_MISSING', NULL FROM s GROUP BY conv_id HAVING count(DISTINCT layer) < 2 UNION ALL SELECT conv_id, 'PATH_UNSTABLE', NULL FROM p WHERE k = 8
UNION ALL SELECT conv_id, 'LINK_NOT_LOCAL', '/abs.md' FROM p WHERE k = 7 UNION ALL SELECT conv_id, 'LINK_HIDDEN', '../Audit/x.md' FROM p WHERE k = 7 AND conv_id % 2 = 0"""


@query("lay_07_layer_codes", f"WITH {LAYER_SQL}")
def _(spark, d):
    t = Tables(spark, d)
    ends = t.conversations.groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"))
    rows = t.conversations.join(ends, "conv_id").select(F.col("conv_id").alias("page_id"), "turn", "lo", "hi", (F.col("conv_id") % 9).alias("k"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    k, first, last = F.col("k"), F.col("turn") == F.col("lo"), F.col("turn") == F.col("hi")
    own = F.array(name("c", "turn"))
    ids = F.when((k == 2) & last, F.array().cast("array<string>")).when((k == 1) & first & ~last, F.array(name("c", "turn"), name("c", "hi"))).when((k == 4) & first, F.array(name("c", "turn"), F.lit("zz"))).otherwise(own)
    bullets = F.transform(ids, lambda c: F.concat(F.lit("On "), c))
    bullets = F.when((k == 3) & first, F.concat(bullets, F.array(F.lit("more")))).otherwise(bullets)
    section = F.when((k == 5) & last, name("s", "lo")).otherwise(name("s", "turn"))
    sections = rows.select("page_id", F.when((k == 6) | (F.col("turn") % 2 == 0), "usage").otherwise("rules").alias("layer"), section.alias("section"), ids.alias("claim_ids"), bullets.alias("bullets"))
    pages = ends.select(F.col("conv_id").alias("page_id"), F.lit("Title").alias("title"), F.when(F.col("conv_id") % 9 == 8, "pages/draft-1.md").otherwise("pages/a.md").alias("path"))
    bad = F.when(F.col("page_id") % 9 == 7, F.when(F.col("page_id") % 2 == 0, F.array(F.lit("/abs.md"), F.lit("../Audit/x.md"))).otherwise(F.array(F.lit("/abs.md"))))
    links = pages.select("page_id", F.lit("related").alias("kind"), F.explode(F.coalesce(bad, F.array(F.lit("../b.md")))).alias("href"))
    return C.two_layer_codes(pages, sections, rows.select("page_id", name("c", "turn").alias("claim_id")), links)


@query("ext_09_reused_sections", """SELECT conv_id AS page_id, turn AS section, CASE WHEN turn % 3 = 0 AND turn % 4 <> 1 AND conv_id % 5 > 0 THEN 'Old ' || turn ELSE text END AS body, CASE WHEN turn % 3 = 0 AND turn % 4 <> 1 AND conv_id % 5 > 1 THEN 'o' || turn ELSE 'c' || turn END AS claims FROM conversations""")
def _(spark, d):
    # some sections are unchanged; old records lack a body or claims here and there, or are not there
    name = lambda p: F.concat(F.lit(p), F.col("turn").cast("string"))
    rows = Tables(spark, d).conversations.withColumn("page_id", F.col("conv_id")).withColumn("section", F.col("turn"))
    now = rows.select("page_id", "section", F.col("text").alias("body"), F.array(name("c")).alias("claim_ids"), F.lit("candidate").alias("status"))
    old_ids = F.when(F.col("conv_id") % 5 > 1, F.array(name("o"), F.lit(" "))).otherwise(F.array().cast("array<string>"))
    old = rows.where("conv_id % 5 > 0").select("page_id", "section", F.when(F.col("turn") % 4 == 1, " ").otherwise(name("Old ")).alias("body"), old_ids.alias("claim_ids"))
    out = C.reuse_sections(now, old, rows.where("turn % 3 = 0").select("page_id", "section"))
    return out.select("page_id", "section", "body", F.array_join("claim_ids", ",").alias("claims"))


def payloads(t: Tables):
    """The gate's question about each draft of ``drafts``, from the sections that its answer bound."""
    pages = drafts(t)
    sections = checked(t).select("page_id", F.posexplode("sections").alias("place", "s")).select("page_id", "place", "s.*")
    claims = pages.select("page_id", F.posexplode("claims").alias("place", "c")).select(
        "page_id", "place", "c.claim_id", "c.text", F.lit("doc://x").alias("source_uri"), F.concat(F.lit("lines:"), F.col("place").cast("string")).alias("locator"), F.sha2("c.text", 256).alias("content_hash"), F.lit("").alias("fingerprint"))
    return C.gate_payloads(sections, claims, claims.select("page_id", "place", "text"), pages.select("page_id", "page_type"))


PAYLOAD_SQL = f"""{CODES_SQL}, sec AS (SELECT z.conv_id, z.section, list_position(a.need, z.section) AS place, z.silent, z.body, z.bound FROM z JOIN a ON a.conv_id = z.conv_id WHERE z.conv_id NOT IN (SELECT conv_id FROM codes)),
txt AS (SELECT conv_id, string_agg('## ' || section || CASE WHEN body <> '' THEN chr(10) || body ELSE '' END || CASE WHEN silent OR len(bound) = 0 THEN '' ELSE chr(10) || '[^' || bound[1] || ']' END, chr(10) ORDER BY place) AS body FROM sec GROUP BY 1),
use_ AS (SELECT DISTINCT sec.conv_id, sec.bound[1] AS id, list_position(a.claims, sec.bound[1]) - 1 AS pos FROM sec JOIN a ON a.conv_id = sec.conv_id WHERE NOT silent),
nt AS (SELECT conv_id, string_agg('[^' || id || ']: doc://x#lines:' || pos, chr(10) ORDER BY id) AS notes, count(*) AS n FROM use_ GROUP BY 1),
ev AS (SELECT conv_id, string_agg(CASE WHEN turn % 5 = 4 THEN '|---|---|' ELSE text END, chr(10) ORDER BY turn) FILTER (turn % 5 = 4 OR text <> '') AS evidence FROM conversations GROUP BY 1)"""


@query("ext_10_gate_payloads", f"WITH {PAYLOAD_SQL} SELECT c.conv_id AS page_id, coalesce(txt.body, '') || CASE WHEN notes IS NULL THEN '' ELSE chr(10) || notes END AS body, sha256(coalesce(evidence, '')) AS evidence, coalesce(nt.n, 0) AS n_claims FROM c LEFT JOIN txt USING (conv_id) LEFT JOIN nt USING (conv_id) LEFT JOIN ev USING (conv_id)")
def _(spark, d):
    return payloads(Tables(spark, d)).select("page_id", "body", F.sha2("evidence", 256).alias("evidence"), F.size("claims").cast("long").alias("n_claims"))


@query("ext_10_payload_verdicts", f"""WITH {PAYLOAD_SQL}, f AS (SELECT c.conv_id, coalesce(txt.body, '') || CASE WHEN notes IS NULL THEN '' ELSE chr(10) || notes END AS body, coalesce(nt.n, 0) AS n FROM c LEFT JOIN txt USING (conv_id) LEFT JOIN nt USING (conv_id))
SELECT conv_id AS page_id, 'BODY_EMPTY' AS code FROM f WHERE body = '' UNION ALL SELECT conv_id, 'CLAIMS_MISSING' FROM f WHERE n = 0 UNION ALL SELECT conv_id, 'STATE_NOT_AUDITED' FROM sec WHERE silent""")
def _(spark, d):
    # the words of these answers are not the claims', and no copied block is that long: what remains is the shape
    found = K.code_rows(K.body_gate(payloads(Tables(spark, d))))
    return found.where("code IN ('BODY_EMPTY', 'CLAIMS_MISSING', 'STATE_NOT_AUDITED', 'STATE_SECTION', 'STATE_PAGE_TYPE', 'STATE_NOT_EMPTY')").select("page_id", "code")


#: Documents as sources: copies, pages of this run, and a ledger of earlier ones.
ENTRY_SQL = f"""{SOURCES}, tw AS (SELECT uri, first_value(uri) OVER (PARTITION BY content_hash ORDER BY doc_id) AS canonical, doc_id, content_hash FROM src),
pg AS (SELECT uri, 'pages/' || doc_id % 50 || '.md' AS target, doc_id % 20 = 5 AS degraded FROM src WHERE doc_id % 4 < 2),
hi AS (SELECT uri, 'old/' || doc_id % 30 || '.md' AS target, CASE doc_id % 12 WHEN 2 THEN 'removed' WHEN 6 THEN 'pending_review' ELSE 'active' END AS v, CASE doc_id % 8 WHEN 2 THEN 'Failed' WHEN 6 THEN NULL ELSE 'OK' END AS p, doc_id % 36 = 10 AS f FROM src WHERE doc_id % 4 IN (1, 2)),
live AS (SELECT *, v = 'pending_review' OR f AS pending FROM hi WHERE v <> 'removed'),
sh AS (SELECT uri, target FROM pg WHERE NOT degraded UNION SELECT uri, target FROM live WHERE NOT pending AND lower(coalesce(p, 'passed')) IN ('passed', 'verified', 'ok')),
tg AS (SELECT uri, list_sort(list(DISTINCT target)) AS targets FROM sh GROUP BY 1), rv AS (SELECT uri FROM pg WHERE degraded UNION SELECT uri FROM live WHERE pending)"""


@query("nav_04_source_entries", f"WITH {ENTRY_SQL} SELECT tw.uri AS source_uri, content_hash, CASE WHEN canonical <> tw.uri THEN 'duplicate' WHEN tw.uri IN (SELECT uri FROM rv) THEN 'needs-review' ELSE 'published' END AS status, array_to_string(coalesce(a.targets, b.targets, []), ',') AS targets FROM tw LEFT JOIN tg a ON a.uri = tw.uri LEFT JOIN tg b ON b.uri = tw.canonical WHERE coalesce(a.targets, b.targets) IS NOT NULL OR tw.uri IN (SELECT uri FROM rv)")
def _(spark, d):
    s = Tables(spark, d).sources().select("doc_id", F.col("uri").alias("source_uri"), "content_hash")
    k = F.col("doc_id")
    first = s.groupBy("content_hash").agg(F.min_by("source_uri", "doc_id").alias("canonical_uri"))
    twins = s.join(first, "content_hash").where("canonical_uri <> source_uri").select("source_uri", "canonical_uri", k.alias("seq"))
    target = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"), F.lit(".md"))
    pages = s.where(k % 4 < 2).select("source_uri", target("pages/", 50).alias("target"), (k % 20 == 5).alias("degraded"))
    history = s.where((k % 4).isin(1, 2)).select(
        "source_uri", target("old/", 30).alias("target"), F.when(k % 12 == 2, "removed").when(k % 12 == 6, "pending_review").otherwise("active").alias("verification_status"),
        F.when(k % 8 == 2, "Failed").when(k % 8 != 6, "OK").alias("validation_status"), (k % 36 == 10).alias("provider_failed"),
    )
    out = C.source_index(s.select("source_uri", "content_hash", k.alias("seq")), twins, pages, history)
    return out.withColumn("targets", F.array_join("targets", ","))


#: Documents as files of a tree with titles and links; what is wrong with a declaration or a link follows from the number.
TREE_SQL = """f AS (SELECT doc_id, doc_id % 40 AS k, 'a/doc-' || doc_id || '.md' AS path, CASE WHEN doc_id % 2 = 0 THEN 'intro' || chr(10) || '# Title ' || doc_id || chr(10) ELSE '' END
  || CASE WHEN doc_id % 5 = 0 THEN '[n](doc-' || doc_id - doc_id % 40 + 1 || '.md#s) ![i](x.png) [w](/wiki/x) [h](https://h/)' || chr(10) ELSE '' END || CASE doc_id % 50 WHEN 7 THEN '[u](../up)' || chr(10) WHEN 8 THEN '[u](../../up.md)' || chr(10) WHEN 9 THEN '[u](/abs.md)' || chr(10) ELSE '' END || text AS text FROM documents),
mx AS (SELECT max(doc_id) AS top FROM documents), d AS (SELECT CASE WHEN k = 4 THEN 'a/ghost-' || doc_id || '.md' ELSE path END AS path, CASE k WHEN 6 THEN ' ' WHEN 7 THEN 'doc://t/' || doc_id + 1 ELSE 'doc://t/' || doc_id END AS uri, CASE WHEN doc_id % 3 = 0 THEN 'Named ' || doc_id END AS title FROM f, (VALUES (1), (2)) r(again) WHERE k <> 3 AND (again = 1 OR k = 5)),
dd AS (SELECT path, count(*) AS n, min(uri) AS uri, min(title) AS title FROM d GROUP BY 1),
cf AS (SELECT dd.uri FROM f JOIN dd ON dd.path = f.path WHERE trim(dd.uri) <> '' GROUP BY 1 HAVING count(DISTINCT f.text) > 1),
ln AS (SELECT doc_id, path, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 1 END AS line, 'a/doc-' || doc_id - doc_id % 40 + 1 || '.md' AS target, 'local' AS state FROM f WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, path, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 1 END, 'up.md', 'local' FROM f WHERE doc_id % 50 = 7 UNION ALL SELECT doc_id, path, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 1 END, NULL, 'escapes' FROM f WHERE doc_id % 50 IN (8, 9)),
met AS (SELECT ln.*, dd.uri AS target_uri FROM ln LEFT JOIN dd ON dd.path = ln.target AND trim(dd.uri) <> ''),
codes AS (SELECT f.path, 'UNDECLARED' AS code, NULL::VARCHAR AS detail FROM f LEFT JOIN dd ON dd.path = f.path WHERE dd.path IS NULL UNION ALL SELECT dd.path, 'FILE_MISSING', NULL FROM dd LEFT JOIN f ON f.path = dd.path WHERE f.path IS NULL
  UNION ALL SELECT path, 'DECLARED_TWICE', NULL FROM dd WHERE n > 1 UNION ALL SELECT path, 'URI_MISSING', NULL FROM dd WHERE trim(uri) = '' UNION ALL SELECT f.path, 'URI_CONFLICT', NULL FROM f JOIN dd ON dd.path = f.path WHERE dd.uri IN (SELECT uri FROM cf)
  UNION ALL SELECT path, CASE state WHEN 'escapes' THEN 'LINK_ESCAPES' ELSE 'LINK_UNDECLARED' END, line || ':' || coalesce(target, '') FROM met WHERE target_uri IS NULL)"""


def tree(t: Tables):
    k, lit = F.col("doc_id"), F.lit
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else lit(p) for p in parts])
    head = F.when(k % 2 == 0, text("intro\n# Title ", k.cast("string"), "\n")).otherwise("")
    link = F.when(k % 5 == 0, text("[n](doc-", (k - k % 40 + 1).cast("string"), ".md#s) ![i](x.png) [w](/wiki/x) [h](https://h/)\n")).otherwise("")
    away = F.when(k % 50 == 7, "[u](../up)\n").when(k % 50 == 8, "[u](../../up.md)\n").when(k % 50 == 9, "[u](/abs.md)\n").otherwise("")
    files = t.documents.where("text IS NOT NULL").select("doc_id", text("a/doc-", k.cast("string"), ".md").alias("path"), F.concat(head, link, away, "text").alias("text"))
    r = k % 40
    again = F.explode(F.when(r == 5, F.array(lit(1), lit(2))).otherwise(F.array(lit(1))))
    uri = F.when(r == 6, " ").when(r == 7, text("doc://t/", (k + 1).cast("string"))).otherwise(text("doc://t/", k.cast("string")))
    declared = files.where(r != 3).withColumn("again", again).select(F.when(r == 4, text("a/ghost-", k.cast("string"), ".md")).otherwise(F.col("path")).alias("path"), uri.alias("source_uri"), lit("guide").alias("knowledge_type"), F.when(k % 3 == 0, text("Named ", k.cast("string"))).alias("title"), lit(None).cast("string").alias("parent_path"))
    return I.source_inventory(files.select("path", "text"), declared)


@query("src_07_inventory_codes", f"WITH {TREE_SQL} SELECT * FROM codes")
def _(spark, d):
    return tree(Tables(spark, d))[1]


@query("src_07_source_inventory", f"""WITH {TREE_SQL} SELECT 'source-' || substr(sha256(dd.uri), 1, 20) AS source_id, f.path, sha256(f.text) AS content_hash, coalesce(dd.title, 'doc-' || f.doc_id) AS title,
CASE WHEN f.doc_id % 2 = 0 THEN 'Title ' || f.doc_id ELSE regexp_extract(f.text, '(?m)^#\\s+(.+?)\\s*$', 1) END AS h1, 'a' AS parent_path, contains(f.text, '](x.png)') OR regexp_matches(f.text, '(?i)<img\\b') AS image, (SELECT count(*) FROM met WHERE met.path = f.path AND target_uri IS NOT NULL) AS n_links, (SELECT min(target_uri) FROM met WHERE met.path = f.path) AS link_to
FROM f JOIN dd ON dd.path = f.path WHERE f.path NOT IN (SELECT path FROM codes)""")
def _(spark, d):
    rows = tree(Tables(spark, d))[0]
    return rows.select("source_id", "path", "content_hash", "title", F.coalesce("h1", F.lit("")).alias("h1"), "parent_path", "features.image", F.size("links").cast("long").alias("n_links"), F.get("links", F.lit(0))["target_uri"].alias("link_to"))
