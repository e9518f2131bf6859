"""Scalar text functions as column expressions; no Python runs per row.

Each takes a column (or its name) and returns a column. Null in, null out, unless the
docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statuses of failed captures, and the words of a page without content.
FAILED_STATUSES = ("failed", "empty", "empty_shell", "shell", "invalid", "inconsistent", "no_body")
SHELL_WORDS = ("home", "navigation", "login", "menu", "skip", "content", "search", "footer")

# Patterns of line markers, in the order in which they are tried.
HEADING = r"^\s*#{1,6}\s+"
FAQ = r"(?i)^\s*(?:FAQ|Q(?:uestion)?)[\s:：]"
ERROR_CODE = r"(?i)^\s*(?:Error\s+)?[A-Z][A-Z0-9_-]*[0-9]+[\s:：-]"
PARAMETER = r"(?i)^\s*(?:[-*]\s*)?(?:parameter|param|argument)\b[^:：]*[:：]"

# Full-width punctuation and the ASCII marks that stand for it.
WIDE_MARKS = "，。！？：；（）【】《》—－～％＃＆＊＋＝／＼｜＠＄＾＿｀“”„「」『』‘’‚·"
PLAIN_MARKS = ",.!?:;()[]<>--~%#&*+=/\\|@$^_`\"\"\"\"\"\"\"'''."

# Headings by kind, in the order in which they are tried.
SECTION_KINDS = (
    ("ignored", r"(?i)目录|修订记录|revision|document\s+directory"),
    ("diagnostic", "(?i)排查|故障|异常|问题|错误|失败|验证|检查|troubleshoot|diagnostic|faq|常见问题"),
    ("boundary", "(?i)限制|边界|注意|不支持|limit|boundary"),
    ("usage", "(?i)背景|用途|适用|功能介绍|概述|目标|场景|overview|introduction"),
    ("procedure", "(?i)入口|步骤|操作|配置|页面|内容|添加|新增|编辑|删除|列表|弹窗|筛选|设置|管理|procedure|action"),
)

# Patterns that a source's features are read from.
FEATURE_PARENT = r"(?:parent|parent_path)\s*:"
FEATURE_TABLE = r"\|[^\n]*\|"
FEATURE_FAQ = r"\b(?:faq|frequently asked|常见问题|问答)\b"
FEATURE_IMAGE = r"(?i)!\[[^]]*\]\([^)]*\)|<img\b"
FEATURE_VERSION = r"(?i)\bv?[0-9]+\.[0-9]+(?:\.[0-9]+)?\b"
FEATURE_NOISE = r"(?:todo|draft|lorem ipsum|噪声)"
SOURCE_ANCHOR = r"(?im)^##\s+(?:来源(?:索引|线索)?(?:（简表）)?|sources?)\s*$"

# What is taken out of a source line, and the summary of a page without prose.
LINE_MARKUP = (
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"https?://\S+", ""),
    ("[*_`~]", ""), (r"^(?:[-*+]\s+|[0-9]+[.)、]\s+)", ""), (r"\s+", " "), (r"^\s+|\s+$", ""), (r"[；;、,，]\s*$", ""),
)
NO_SUMMARY = ("本页整理 ", " 的操作、规则或背景资料。")

TOKEN = r"([\p{L}\p{N}_-]+)"
NUMBER = r"(?<![A-Za-z0-9_])([0-9]+(?:\.[0-9]+)?%?)(?![A-Za-z0-9_])"
IDENTIFIER = r"\b([A-Z][A-Z0-9_-]{2,})\b"
# Fixed value: text that must not reach a reader's page.
INTERNAL_HASH = r"(?i)(?:sha256|content[_-]?fingerprint|digest[_-]?topic|source[_-]?id)\s*[:=]?[`'\"]?[0-9a-f]{16,}"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def squeeze(x) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_c(x), r"\s+", " "))


def casefold(x) -> Column:
    """Lower case with sharp s spelt out: a full case folding for Latin letters."""
    return F.replace(F.lower(_c(x)), F.lit("ß"), F.lit("ss"))


def tokens(x) -> Column:
    """Distinct lower-case tokens, in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(x)), F.lit(TOKEN), 1))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def is_empty_shell(text, status) -> Column:
    """A failed status, a blank text, or a text of navigation words alone."""
    found = tokens(text)
    only = (F.size(found) > 0) & (F.size(F.array_except(found, F.array(*map(F.lit, SHELL_WORDS)))) == 0)
    return F.coalesce(F.lower(_c(status)).isin(*FAILED_STATUSES), F.lit(False)) | (strip(text) == "") | only


def fingerprint(x) -> Column:
    return F.sha2(_c(x), 256)


def normalize_uri(x) -> Column:
    """Scheme and authority in lower case, an empty path as '/', no fragment, query kept.
    Strings without scheme and authority are trimmed only."""
    value = strip(x)
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$"
    part = lambda i: F.regexp_extract(value, pattern, i)
    whole = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.when(part(3) == "", "/").otherwise(part(3)), part(4))
    return F.when(value.rlike(pattern), whole).otherwise(value)


def source_id(uri) -> Column:
    return F.concat(F.lit("source-"), F.substring(fingerprint(normalize_uri(uri)), 1, 20))


def snapshot_id(uri, path, text) -> Column:
    return F.concat(F.lit("snapshot-"), F.substring(F.sha2(F.concat_ws("\n", _c(uri), _c(path), fingerprint(text)), 256), 1, 24))


def normalize_claim(x) -> Column:
    return casefold(squeeze(x))


def claim_fingerprint(uri, text) -> Column:
    return F.sha2(F.concat(_c(uri), F.lit("\n"), normalize_claim(text)), 256)


def normalize_for_gate(x) -> Column:
    """Full-width marks as ASCII, white space squeezed and dropped next to punctuation, case folded."""
    plain = F.replace(F.translate(_c(x), WIDE_MARKS, PLAIN_MARKS), F.lit("…"), F.lit("..."))
    return F.regexp_replace(casefold(squeeze(plain)), r"\s*([!-/:-@\[-`{-~])\s*", "$1")


def normalize_newlines(x) -> Column:
    return F.regexp_replace(_c(x), "\r\n?", "\n")


def lines(x) -> Column:
    """The text's lines; a closing line feed ends the last one."""
    return F.split(F.regexp_replace(normalize_newlines(x), "\n$", ""), "\n", -1)


def web_references(x) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(r"(https?://[^\s)>]+)"), 1)


def first_heading(x) -> Column:
    return strip(F.regexp_extract(_c(x), r"(?m)^\s*#\s+(\S.*?)\s*$", 1))


def marker(line) -> Column:
    """heading, faq, error_code, parameter, code, or null."""
    x = _c(line)
    return F.when(x.rlike(HEADING), "heading").when(x.rlike(FAQ), "faq").when(x.rlike(ERROR_CODE), "error_code").when(x.rlike(PARAMETER), "parameter").when(strip(x).startswith("```"), "code")


def is_unsupported(line) -> Column:
    return casefold(strip(line)).startswith("unsupported:")


def strip_frontmatter(x) -> Column:
    return F.regexp_replace(normalize_newlines(x), r"(?s)\A---\n.*?\n---\n", "")


def structure_features(text, path, title, parent) -> Column:
    """Seven booleans that describe a source's structure."""
    x, low = _c(text), casefold(text)
    return F.struct(
        ((F.coalesce(_c(parent), F.lit("")) != "") | F.contains(_c(path), F.lit("/")) | low.rlike(FEATURE_PARENT)).alias("parent_child"),
        x.rlike(FEATURE_TABLE).alias("table"),
        low.rlike(FEATURE_FAQ).alias("faq"),
        x.rlike(FEATURE_IMAGE).alias("image"),
        (x.rlike("[一-鿿]") & x.rlike("[A-Za-z]")).alias("bilingual"),
        x.rlike(FEATURE_VERSION).alias("version"),
        ((strip(F.coalesce(_c(title), F.lit(""))) == "") | low.rlike(FEATURE_NOISE)).alias("noise"),
    )


def clean_line(x) -> Column:
    """A source line as reader text: links and images by their label, no URLs or mark-up."""
    y = F.replace(F.replace(F.replace(strip(x), F.lit(" "), F.lit(" ")), F.lit("<br />"), F.lit("；")), F.lit("<br/>"), F.lit("；"))
    for pattern, by in LINE_MARKUP:
        y = F.regexp_replace(y, pattern, by)
    return strip(y)


def table_cells(x) -> Column:
    """Cells of a table row; empty for a delimiter row, null for other lines."""
    bare = F.regexp_replace(strip(x), r"^\|+|\|+$", "")
    cells = F.transform(F.split(bare, r"\|", -1), lambda c: clean_line(c))
    rule = F.forall(cells, lambda c: c.rlike("^[-:]*$"))
    return F.when(F.size(F.split(_c(x), r"\|", -1)) >= 3, F.when(rule, F.array().cast("array<string>")).otherwise(cells))


def section_kind(heading) -> Column:
    x, out = _c(heading), F.lit("detail")
    for kind, pattern in reversed(SECTION_KINDS):
        out = F.when(x.rlike(pattern), kind).otherwise(out)
    return out


def let(x: Column, f) -> Column:
    """f(x), with x computed once, however often f names it, within lambdas too."""
    return F.transform(F.array(x), f)[0]


def word_grams(x, n: int = 5) -> Column:
    """Distinct runs of n blank-separated words; empty for fewer words."""

    def grams(words):
        runs = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
        return F.when(F.size(words) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))

    return let(F.filter(F.split(_c(x), " "), lambda w: w != ""), grams)


def gram_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct grams; 1 if both are empty."""

    def score(ab):
        x, y = ab["x"], ab["y"]
        return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(F.array_union(x, y))))

    return let(F.struct(a.alias("x"), b.alias("y")), score)


def numbers(x) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(NUMBER), 1)


def identifiers(x) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(IDENTIFIER), 1)


def facts_kept(value, source) -> Column:
    """Whether every number and identifier of ``value`` occurs in ``source``."""
    return F.forall(F.concat(numbers(value), identifiers(value)), lambda t: F.contains(_c(source), t))


def slug(x, fallback: str = "item") -> Column:
    """ASCII letters, digits and CJK characters, joined by single hyphens, at most 80."""
    y = F.regexp_replace(F.replace(F.lower(strip(x)), F.lit("&"), F.lit(" and ")), r"[\\/]+", " ")
    y = F.regexp_replace(y, "[^0-9a-z㐀-鿿぀-ヿ가-힯]+", "-")
    y = F.substring(F.regexp_replace(y, "^-+|-+$", ""), 1, 80)
    return F.when(y == "", fallback).otherwise(y)


def sentences(x) -> Column:
    """Split after closing punctuation followed by white space, and at line feeds; blanks dropped."""
    return F.filter(F.transform(F.split(_c(x), r"(?<=[.!?。！？；;])\s+|\n+"), lambda s: strip(s)), lambda s: s != "")


def summary_line(x, title) -> Column:
    """The first prose line of at least 8 characters, cut at 180."""
    prose = F.transform(F.filter(lines(x), lambda v: (strip(v) != "") & ~strip(v).rlike(r"^(#|- |\* |> |\|)")), lambda v: squeeze(v))
    first = F.get(F.filter(prose, lambda v: F.char_length(v) >= 8), 0)
    short = F.regexp_replace(F.substring(first, 1, 180), "[。；;，,]+$", "")
    return F.coalesce(F.concat(short, F.when(F.char_length(first) > 180, "……").otherwise("。")), F.concat(F.lit(NO_SUMMARY[0]), _c(title), F.lit(NO_SUMMARY[1])))


def code_signatures(x) -> Column:
    """Counts of what must survive a rewrite: fences, and URLs and numbers within code."""
    y = strip_frontmatter(x)
    code = F.array_join(F.regexp_extract_all(y, F.lit(r"(?s)```[^\n]*\n(.*?)```"), 1), "\n")
    count = lambda v, p: F.size(F.regexp_extract_all(v, F.lit(p), 0))
    return F.struct(
        count(y, r"(?m)^\s*```").alias("code_fence_markers"),
        count(code, r"(?i)(?:https?://|mailto:)[^\s)]+").alias("code_urls"),
        count(code, r"(?i)(?<!\w)(?:v?[0-9]+(?:[._:/-][0-9]+)+|[0-9]{2,})(?!\w)").alias("code_numeric_tokens"),
    )


def term_coverage(text, terms: list[str]) -> Column:
    """Share of terms that occur, case folded; 0 without terms."""
    low = casefold(text)
    hits = [F.contains(low, F.lit(t.lower())).cast("int") for t in terms]
    return (sum(hits[1:], hits[0]) / len(terms)) if hits else F.lit(0.0)


def has_source_anchor(x) -> Column:
    return _c(x).rlike(SOURCE_ANCHOR)


def part_path(folder, topic, part) -> Column:
    """Path of a topic's part; the first has no suffix."""
    suffix = F.when(_c(part) == 1, "").otherwise(F.format_string(".part-%03d", _c(part).cast("int")))
    return F.concat(_c(folder), F.lit("/"), _c(topic), suffix, F.lit(".md"))


def is_safe_path(x) -> Column:
    """Relative, without a parent step or an empty one."""
    parts = F.split(_c(x), "/")
    return ~_c(x).startswith("/") & ~F.array_contains(parts, "..") & ~F.array_contains(parts, "")


def retention_deadline(ts) -> Column:
    return _c(ts) + F.expr("INTERVAL 90 DAYS")


def lifecycle(status, stale_after, as_of: str) -> Column:
    """deprecated, stale, current, or unknown where the date cannot be read."""
    day = F.try_to_date(_c(stale_after), "yyyy-MM-dd")
    return F.when(strip(F.coalesce(_c(status), F.lit(""))) == "deprecated", "deprecated").when(F.coalesce(_c(stale_after), F.lit("")) == "", "current").when(day.isNull(), "unknown").when(F.lit(as_of).cast("date") >= day, "stale").otherwise("current")


def first_rule(haystack, rules: list[tuple[str, tuple[str, ...]]], fallback: str) -> Column:
    """The first rule one of whose needles occurs in the text, case folded."""
    low, out = F.lower(_c(haystack)), F.lit(fallback)
    for name, needles in reversed(rules):
        out = F.when(low.rlike("|".join("\\Q" + n.lower() + "\\E" for n in needles)), name).otherwise(out)
    return out
