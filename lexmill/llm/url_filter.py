"""URL filtering: rules on host and path, and a list of canonical URLs of any size.

A blocked Bloom filter over the listed URLs is built with grouped bit-or aggregates and
broadcast; its size has a fixed upper bound whatever the list's length. Only URLs that the
filter lets through take part in an exact join with the list, which removes the filter's
false positives. A longer list raises the share of rows that join, never the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.bloom import MAX_BLOCKS, possible
from lexmill.llm.common import durable, out_of_the_way

# The rules of op8's contract, (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SALTS = 8
# Fixed value: query parameters that do not tell pages apart.
TRACKING = "^(utm_[a-z]*|ref|gclid|fbclid)(=|$)"
#: op8 lists the canonical URLs of pages with shorter HTML than this many characters.
THIN_CHARS = 800

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url):
    return F.when(F.instr(url, "://") > 0, F.expr(f"substr({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))


def host_and_path(url: str):
    """Columns host and path of the column named ``url``; both empty for null or without '://'."""
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return host, path


def canonical(url: str):
    """One spelling for URLs of one page: host without www. and default port, path without
    closing slashes, query without tracking parameters, no scheme or fragment. Null for
    null and for URLs without '://'."""
    host, path = host_and_path(url)
    rest = _after_scheme(url)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    short = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), r"^www\.", "")
    whole = F.concat(short, F.regexp_replace(path, "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(F.instr(url, "://") > 0, whole)


def rule_verdict(rules=RULES):
    """Columns rule and verdict, from columns host and path, of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path).otherwise(rule)
        verdict = F.when(fits, said).otherwise(verdict)
    return rule, verdict


def judge(urls: DataFrame, listed: DataFrame, *, url: str = "url", column: str = "canonical", rules=RULES, salts: int = SALTS, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """All columns of ``urls`` and host, path, canonical, rule, listed, verdict.

    A rule's verdict stands; without one, URLs whose canonical form is in ``listed``
    (distinct values of ``column``) are blocked and all others allowed. Null URLs and
    those without '://' have empty host and path and are allowed. Rows are judged one by
    one; result columns in ``urls`` are replaced. The join's listed side is copied
    ``salts`` times, so that a URL with a third of the rows is dealt to as many tasks."""
    out_of_the_way(urls, url)
    added = ("host", "path", "canonical", "rule", "listed", "verdict")
    host, path = host_and_path("__url")
    rows = urls.withColumn("__url", F.col(f"`{url}`")).select(*[F.col(f"`{c}`") for c in urls.columns if c not in added], host.alias("host"), path.alias("path"), canonical("__url").alias("canonical"))
    rule, verdict = rule_verdict(rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("verdict"))
    names = listed.where(F.col(column).isNotNull()).select(F.col(column).alias("canonical")).distinct()
    names = durable(names, "listed-urls")
    tested = rows.withColumn("__possible", possible(names, "canonical", "canonical", max_blocks=max_blocks))
    tested = durable(tested, "tested-urls")
    copies = names.withColumn("listed", F.lit(True)).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hits = tested.where("__possible").withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).join(copies, ["canonical", "__salt"], "left").drop("__salt")
    rest = tested.where("not __possible").withColumn("listed", F.lit(False))
    both = rest.unionByName(hits).drop("__possible").withColumn("listed", F.coalesce("listed", F.lit(False)))
    return both.withColumn("verdict", F.coalesce("verdict", F.when(F.col("listed"), "block").otherwise("allow")))


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    listed = pages.where(F.char_length("html") < THIN_CHARS).select(canonical("url").alias("canonical"))
    return judge(pages.select("page_id", "url"), listed).select("page_id", "host", "path", "rule", "verdict", "canonical", "listed")


OP8_SQL = """
WITH a AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest, instr(url, '://') > 0 AS has FROM pages),
b AS (SELECT page_id, html, has, rest, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
        array_to_string(list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]*|ref|gclid|fbclid)(=|$)')), '&') AS q FROM a),
c AS (SELECT page_id, html, host, path, CASE WHEN has THEN regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical FROM b),
r(said, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(said, length(h || p)) AS said FROM c JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
l AS (SELECT DISTINCT canonical FROM c WHERE length(html) < 800)
SELECT c.page_id, host, path, rule, coalesce(said, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, c.canonical, l.canonical IS NOT NULL AS listed
FROM c LEFT JOIN m ON c.page_id = m.page_id LEFT JOIN l ON c.canonical = l.canonical
"""
