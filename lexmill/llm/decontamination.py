"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive benchmark words. A block of two words is hashed into a
shift table that says how far the search may move on when the block stands at the end of
the window; a shift of nought leads to the bucket of patterns with that suffix hash. Within
a bucket, patterns are in order of a hash of all their words, so that a bucket of any size costs
one bisection, and the words of those that are left are compared directly. Windows of one
length share a table, since the shortest pattern bounds all shifts. The search moves over many
stretches of a slice of texts at once.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import ASCII_LOWER, gram_hashes, open_fs, out_of_the_way, scratch_path, small_batches, text_slices, word_hashes, words_of

WINDOW = 10
#: Benchmark text in one set of tables, which take about eight times that; a larger benchmark is searched in several passes.
PASS_BYTES = 8 << 20
#: Words of one item that stand together in a set of tables; longer items are cut, with an overlap of a window.
ITEM_WORDS = 1 << 15
#: Words that one stretch of the search has.
STRETCH = 256
#: The shift table has at least so many bits, and about four places for each of its blocks.
TABLE_BITS = 18
MOST_BITS = 26

#: A word byte after folding: digits, a-z, and all of other alphabets.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[65:91] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True


def _split(text: str):
    """Folded bytes, word starts, ends and hashes of one text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = words_of(raw, np.array([0, len(raw)]), WORD_BYTE)
    return ASCII_LOWER[raw].tobytes(), starts, ends, word_hashes(raw, starts, ends)


@dataclass
class Tables:
    """Tables for the patterns of one length: shifts, the suffix hashes that have a bucket, and patterns by (suffix hash,
    hash of all words, item) with their item and first word in the pool of benchmark words."""

    length: int
    block: int
    bits: int
    shift: np.ndarray
    suffixes: np.ndarray
    whole: np.ndarray
    item: np.ndarray
    at: np.ndarray
    names: list[str]
    pool: bytes
    starts: np.ndarray
    ends: np.ndarray


def build_tables(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[Tables]:
    """Tables by pattern length, from (item_id, text). Null ids count as ''; items without words have no pattern."""
    found: dict[int, list] = defaultdict(list)
    for item, text in items:
        folded, starts, ends, hashes = _split(text or "")
        if m := min(window, len(starts)):
            found[m].append((item or "", folded, starts, ends, hashes))
    out = []
    for m, own in sorted(found.items()):
        names = sorted({x[0] for x in own})
        number = {x: i for i, x in enumerate(names)}
        block, words, size = min(2, m), 0, 0
        suffix, whole, item, at, pairs, back, starts, ends = ([] for _ in range(8))
        for name, folded, s, e, hashes in own:
            n = len(s) - m + 1
            codes = gram_hashes(hashes, block)
            suffix.append(codes[m - block :])
            whole.append(gram_hashes(hashes, m))
            item.append(np.full(n, number[name], np.int32))
            at.append(np.arange(n) + words)
            # a block may end k words before the end of a window, for any k that keeps both inside the item
            for k in range(m - block + 1):
                pairs.append(codes[m - block - k : len(codes) - k])
                back.append(np.full(n, k, np.uint8 if m < 250 else np.int64))
            starts.append(s + size)
            ends.append(e + size)
            words, size = words + len(s), size + len(folded)
        suffix, whole, item, at, pairs, back = map(np.concatenate, (suffix, whole, item, at, pairs, back))
        order = np.lexsort((at, item, whole))
        suffix, whole, item, at = suffix[order], whole[order], item[order], at[order]
        # of equal windows of one item, one is enough; windows that merely share the hash stay
        fresh = np.ones(len(at), bool)
        pool, starts, ends = b"".join(x[1] for x in own), np.concatenate(starts), np.concatenate(ends)
        for i in np.flatnonzero((whole[1:] == whole[:-1]) & (item[1:] == item[:-1])) + 1:
            fresh[i] = any(pool[starts[at[i] + k] : ends[at[i] + k]] != pool[starts[at[i - 1] + k] : ends[at[i - 1] + k]] for k in range(m))
        bits = min(MOST_BITS, max(TABLE_BITS, int(len(pairs)).bit_length() + 1))
        shift = np.full(1 << bits, m - block + 1, back.dtype)
        np.minimum.at(shift, (pairs >> np.uint64(64 - bits)).astype(np.int64), back)
        out.append(Tables(m, block, bits, shift, np.unique(suffix), whole[fresh], item[fresh], at[fresh], names, pool, starts, ends))
    return out


def _search(t: Tables, folded: bytes, starts, ends, hashes, first):
    """Yield (first word, item) of all occurrences in the texts of a slice."""
    n = len(starts)
    if n < t.length:
        return
    lane = np.arange(t.length - 1, n, STRETCH)
    stop = np.minimum(lane + STRETCH, n)
    zero = []
    while len(lane):
        code = gram_codes(hashes, lane, t.block)
        step = t.shift[(code >> np.uint64(64 - t.bits)).astype(np.int64)]
        halt = step == 0
        if halt.any():
            zero.append((lane[halt], code[halt]))
        lane = lane + np.maximum(step, 1)
        live = lane < stop
        lane, stop = lane[live], stop[live]
    if not zero:
        return
    ends_at, codes = np.concatenate([z[0] for z in zero]), np.concatenate([z[1] for z in zero])
    near = np.minimum(np.searchsorted(t.suffixes, codes), len(t.suffixes) - 1)
    text = np.searchsorted(first, ends_at, "right") - 1
    ends_at = ends_at[(t.suffixes[near] == codes) & (first[text] <= ends_at - t.length + 1)]
    whole = gram_codes(hashes, ends_at, t.length)
    low, high = np.searchsorted(t.whole, whole), np.searchsorted(t.whole, whole, "right")
    for i in np.flatnonzero(high > low):
        a = int(ends_at[i]) - t.length + 1
        words = [folded[starts[a + k] : ends[a + k]] for k in range(t.length)]
        for p in range(low[i], high[i]):
            w = t.at[p]
            if all(t.pool[t.starts[w + k] : t.ends[w + k]] == x for k, x in enumerate(words)):
                yield a, t.names[t.item[p]]


def gram_codes(hashes: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """As ``gram_hashes``, for the runs that end at the given words."""
    if n == 1:
        return gram_hashes(hashes[last], 1)
    runs = np.stack([hashes[last - k] for k in range(n - 1, -1, -1)], axis=1)
    return gram_hashes(runs.ravel(), n)[::n]


def _segments(items: DataFrame, window: int, words: int) -> DataFrame:
    """id, text, with items of more than ``words`` words cut into pieces that overlap by all but one word of a window."""

    def cut(batches):
        for batch in batches:
            ids, texts = [], []
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (text or "").encode()
                starts, ends, _ = words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), WORD_BYTE)
                for a in range(0, max(len(starts) - window + 1, 1), words):
                    b = min(a + words + window - 1, len(starts))
                    ids.append(name)
                    texts.append(raw[starts[a] : ends[b - 1]].decode() if b else "")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["id", "text"])

    return items.mapInArrow(cut, "id string, text string")


def _tables_of(benchmark: DataFrame, item_id: str, text: str, window: int, pass_bytes: int):
    """One list of tables per pass, each from a bounded share of the benchmark's text."""
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    passes = max(1, -(-total // pass_bytes))
    pieces = _segments(items, window, ITEM_WORDS)
    part = F.pmod(F.xxhash64("id", "text"), F.lit(passes))
    return passes, (build_tables([(r["id"], r["text"]) for r in pieces.where(part == k).collect()], window) for k in range(passes))


def _shared_tables(spark, passes: int, each):
    """A function that gives a task the passes' tables, one after another. One pass is broadcast; several are written to
    the shared folder, and a task holds one at a time."""
    if passes == 1:
        shared = spark.sparkContext.broadcast(next(each))
        return lambda: iter((shared.value,))
    folder = scratch_path(spark, "benchmark-tables")
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    for k, tables in enumerate(each):
        with fs.open_output_stream(f"{path}/{k}") as out:
            out.write(pickle.dumps(tables, protocol=5))

    def read():
        fs, path = open_fs(folder)
        for k in range(passes):
            with fs.open_input_file(f"{path}/{k}") as file:
                yield pickle.loads(file.read())

    return read


def mark(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """All columns of ``docs`` and n_words, n_hit (words inside any occurrence), matches.

    ``matches`` has (first_word, last_word, item_id) of runs of overlapping or adjoining
    occurrences of one item, ordered by place and item. Null and empty texts have no words;
    repeated rows are marked alike; an empty benchmark marks nothing; items that repeat an
    item_id count as one. Result columns in ``docs`` are replaced. The benchmark is searched
    whole, in as many passes as its size needs; documents are read once, and a task holds one
    pass's tables at a time. A very long text is searched whole, in slices of its words' hashes."""
    out_of_the_way(docs, text)
    out_of_the_way(benchmark, item_id, item_text)
    spark = docs.sparkSession
    small_batches(spark)
    added = ("n_words", "n_hit", "matches")
    keep = [c for c in docs.columns if c not in added]
    at = keep.index(text)
    names = [*keep, *added]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{fields}, n_words long, n_hit long, matches array<struct<first_word:bigint,last_word:bigint,item_id:string>>"
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("item_id", pa.string())]))
    passes = _shared_tables(spark, *_tables_of(benchmark, item_id, item_text, window, pass_bytes))

    def run(batches):
        for batch in batches:
            slices, found, n_words = [], [{} for _ in range(batch.num_rows)], np.zeros(batch.num_rows, np.int64)
            for row, raw, offsets in text_slices(batch.column(at)):
                starts, ends, first = words_of(raw, offsets, WORD_BYTE)
                slices.append((row, ASCII_LOWER[raw].tobytes(), starts, ends, word_hashes(raw, starts, ends), first))
                n_words[row : row + len(first) - 1] = np.diff(first)
            for tables in passes() if slices else ():
                for row, folded, starts, ends, hashes, first in slices:
                    for t in tables:
                        for a, item in _search(t, folded, starts, ends, hashes, first):
                            own = int(np.searchsorted(first, a, "right")) - 1
                            found[row + own].setdefault(item, []).append((a - int(first[own]), a - int(first[own]) + t.length - 1))
            runs = [sorted((a, b, item) for item, spans in own.items() for a, b in _joined(spans)) for own in found]
            n_hit = [sum(b - a + 1 for a, b in _joined([r[:2] for r in own])) for own in runs]
            matches = [[{"first_word": a, "last_word": b, "item_id": item} for a, b, item in own] for own in runs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words), pa.array(n_hit, pa.int64()), pa.array(matches, kind)], names=names)

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans, ends inclusive, merged where they overlap or adjoin."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns, derived from the matches."""
    items = F.sort_array(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return (
        mark(docs, benchmark)
        .withColumn("__items", items)
        .select("doc_id", "n_words", "n_hit", F.size("__items").cast("long").alias("n_items"), F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
    )


OP9_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(ws)) AS m, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS k
      FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) t(i) WHERE len(ws) > 0),
ms AS (SELECT DISTINCT m FROM p),
g AS (SELECT doc_id, m, i, array_to_string(ws[i : i + m - 1], ' ') AS k FROM w, ms, unnest(range(1, len(ws) - m + 2)) t(i)),
h AS (SELECT DISTINCT doc_id, item_id, g.m, i FROM g JOIN p ON g.k = p.k AND g.m = p.m),
hw AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM h, unnest(range(m)) t(j) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hw ON w.doc_id = hw.doc_id LEFT JOIN hi ON w.doc_id = hi.doc_id
"""
