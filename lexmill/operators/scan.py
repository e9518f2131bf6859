"""Ordered scans of a document's lines, as expressions over a string of line classes.

Each line becomes one letter: h heading, f faq, e error code, p parameter, c code fence, b blank,
t other text. A component is then a match of one pattern on that string, and its length in
letters is its length in lines. No Python runs per line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T

#: In order: code with the line before it and one line after it; atomic pairs and headings with the
#: lines up to the next marker or the line before code; single lines. Blanks go with what they follow.
COMPONENT = r"([tb]?c[^c]*(?:c|$)t?b*|[fep](?:[tb](?!c))*b*|h(?:[tb](?!c))*b*|[tb]b*)"


def line_class(line: Column) -> Column:
    letter = F.create_map(*[F.lit(x) for kv in {"heading": "h", "faq": "f", "error_code": "e", "parameter": "p", "code": "c"}.items() for x in kv])
    return F.when(T.strip(line) == "", "b").otherwise(F.coalesce(letter[T.marker(line)], F.lit("t")))


def class_string(text) -> Column:
    return F.array_join(F.transform(T.lines(text), lambda v: line_class(v)), "")


def components(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, component (from 1), kind, line_start, line_end, atomic: contiguous spans of all lines."""
    found = docs.select(key, F.regexp_extract_all(class_string(text), F.lit(COMPONENT), 1).alias("m"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<a:int,b:int,c:string>>").alias("out"))

    def step(acc, x):
        n = F.length(x)
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("a"), (acc["at"] + n - 1).alias("b"), x.alias("c")))).alias("out"))

    spans = found.select(key, F.posexplode(F.aggregate("m", start, step, lambda acc: acc["out"])).alias("i", "s"))
    code = F.contains("s.c", F.lit("c"))
    first = F.substring("s.c", 1, 1)
    kind = F.when(code, "code").when(first == "f", "faq").when(first == "e", "error_code").when(first == "p", "parameter").when(first == "h", "heading").otherwise("text")
    return spans.select(key, (F.col("i") + 1).alias("component"), kind.alias("kind"), F.col("s.a").alias("line_start"), F.col("s.b").alias("line_end"), (code | first.isin("f", "e", "p")).alias("atomic"))


def fragments(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, content_type, level, parent: non-blank lines; parent is the nearest heading line above (for a
    heading: of a smaller level)."""
    lines = docs.select(key, F.posexplode(T.lines(text)).alias("p", "line")).where(T.strip("line") != "")
    level = F.when(T.marker("line") == "heading", F.length(F.regexp_extract(T.strip("line"), "^(#+)", 1)))
    kind = F.coalesce(T.marker("line"), F.when(T.strip("line").startswith("|"), "table").otherwise("paragraph"))
    rows = lines.select(key, (F.col("p") + 1).alias("line_no"), kind.alias("content_type"), level.alias("level"))
    from lexmill.operators.layout import parents

    return parents(rows, key, "line_no", "level")


def typed_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, section_no, heading, kind, n_lines: sections with text, ignored headings left out; lines before
    the first heading are an overview."""
    lines = docs.select(key, F.posexplode(T.lines(text)).alias("p", "line")).where((T.strip("line") != "") & (T.strip("line") != "---") & ~T.strip("line").startswith("<!--"))
    head = F.col("line").rlike(r"^\s*#{1,6}\s+\S")
    rows = lines.withColumn("section_no", F.sum(head.cast("int")).over(Window.partitionBy(key).orderBy("p")))
    heading = F.max(F.when(head, T.clean_line(F.regexp_replace("line", r"^\s*#{1,6}\s+", ""))))
    each = rows.groupBy(key, "section_no").agg(F.coalesce(heading, F.lit("概览")).alias("heading"), F.count_if(~head).alias("n_lines"))
    return each.withColumn("kind", T.section_kind("heading")).where("kind <> 'ignored' AND n_lines > 0")


def split_pages(docs: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """key, page, line_start, line_end: pages of at most ``most`` lines, cut before headings where that is
    possible; a longer section is cut at the limit."""
    lines = docs.select(key, F.posexplode(T.lines(text)).alias("p", "line"))
    w = Window.partitionBy(key).orderBy("p")
    head = F.col("line").rlike(r"^#{1,6}\s+")
    rows = lines.withColumn("sec", F.sum(head.cast("int")).over(w))
    inner = rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(key, "sec").orderBy("p")) - 1) / most))
    units = inner.groupBy(key, "sec", "chunk").agg(F.min("p").alias("pos"), F.count("*").alias("n"))
    from lexmill.operators.layout import pack_groups

    packed = pack_groups(units, key, "pos", "n", most)
    return packed.groupBy(key, F.col("bin").alias("page")).agg((F.min("pos") + 1).alias("line_start"), F.max(F.col("pos") + F.col("n")).cast("long").alias("line_end"))


def copied_run(source, body, sentences: int = 3, chars: int = 240) -> Column:
    """Whether a run of more than ``sentences`` sentences or ``chars`` characters of the source stands
    verbatim in the body, both in gate form.

    Runs of sentences + 1 and single sentences decide the first rule; for the second, runs up to that
    length suffice, since a longer one breaks the first."""

    def hit(parts, whole, n):
        runs = F.transform(F.sequence(F.lit(1), F.size(parts) - n + 1), lambda i: T.normalize_for_gate(F.array_join(F.slice(parts, i, F.lit(n)), " ")))
        bad = F.exists(runs, lambda r: F.contains(whole, r) & (F.lit(n > sentences) | (F.char_length(r) > chars)))
        return F.when(F.size(parts) >= n, bad).otherwise(F.lit(False))

    def any_hit(x):
        out = hit(x["parts"], x["whole"], 1)
        for n in range(2, sentences + 2):
            out = out | hit(x["parts"], x["whole"], n)
        return out

    parts = F.transform(T.sentences(source), lambda s: T.normalize_for_gate(s))
    return T.let(F.struct(parts.alias("parts"), T.normalize_for_gate(body).alias("whole")), any_hit)


def safe_prefix(flags: str) -> Column:
    """Length of the longest prefix of an array of booleans that are all true."""
    first = F.array_position(flags, F.lit(False))
    return F.when(first == 0, F.size(flags)).otherwise(first - 1).cast("int")
