"""Language identification with spans for mixed-language text.

Script ranges narrow each word's candidate languages, a byte n-gram model scores
the word under each candidate, and a Viterbi pass with a switching penalty turns
the word scores into spans of one language each.

The Viterbi pass works on chunks of ``CHUNK`` words from all texts at once: each
chunk is scored for every language that may precede it, the chunks of a text are
joined from left to right, and once it is known what precedes each chunk, a second pass
decodes it from there and the path is read back from the right.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import SLICE_BYTES, out_of_the_way, small_batches, text_slices, words_of

#: Labelled rows per language that the model is fitted on, at most (chosen by a hash of the row).
MAX_TRAIN_ROWS = 3000
#: The model's table takes 400 KB for each language; more labels than this raise.
MAX_LANGUAGES = 250
ORDERS = (2, 3, 4)
TABLE_BITS = 15
ALPHA = 0.05
SWITCH_PENALTY = 14.0
#: A language is no candidate for a word with letters of a script that makes up less of its training letters.
SCRIPT_SHARE = 0.001
CHUNK = 64
#: Entries of the largest array of a pass over chunks: words or pairs of languages.
ENTRIES = 1 << 22

# First code points of blocks, each up to the next one, and the script they hold.
SCRIPT_STARTS = (
    (0x0000, "latin"), (0x0250, "phonetic"), (0x0300, "marks"), (0x0370, "greek"), (0x0400, "cyrillic"),
    (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
    (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x32000, "other"),
)
_STARTS = np.array([a for a, _ in SCRIPT_STARTS])
_NAMES = sorted({b for _, b in SCRIPT_STARTS})
_SCRIPT_BIT = np.array([1 << _NAMES.index(b) for _, b in SCRIPT_STARTS], np.int64)
_LATIN = 1 << _NAMES.index("latin")

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[65:91] = _WORD_BYTE[97:123] = _WORD_BYTE[128:] = True


@dataclass
class LanguageModel:
    """languages: sorted labels; logp: [orders, buckets, languages], the dummy bucket last; scripts: bit masks by language."""

    languages: list[str]
    logp: np.ndarray
    scripts: np.ndarray


def _fold(raw: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters, byte for byte."""
    out = raw.copy()
    upper = (raw >= 65) & (raw <= 90)
    out[upper] += 32
    if len(raw) > 1:
        second = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        out[1:][second] += 32
    return out


def _grams(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """For the bytes of all words, with a blank before and after each: [orders] bucket
    numbers per padded byte, and where each word's padded bytes begin."""
    lens = ends - starts + 2
    heads = np.concatenate(([0], np.cumsum(lens)[:-1])) if len(lens) else np.zeros(0, np.int64)
    total = int(lens.sum())
    place = np.arange(total) - np.repeat(heads, lens)
    source = np.repeat(starts, lens) + place - 1
    pad = (place == 0) | (place == np.repeat(lens, lens) - 1)
    text = np.full(total, 32, np.uint32)
    text[~pad] = raw[source[~pad]]
    out, code = [], text.copy()
    dummy = 1 << TABLE_BITS
    for n in range(2, max(ORDERS) + 1):
        code[n - 1 :] |= text[: total - n + 1] << np.uint32(8 * (n - 1))
        if n in ORDERS:
            bucket = ((code * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)).astype(np.int64)
            bucket[place < n - 1] = dummy
            out.append(bucket)
    return out, heads


def _script_masks(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bits of the scripts in each word; words of ASCII letters alone are Latin."""
    masks = np.full(len(starts), 0, np.int64)
    ascii_letters = np.concatenate(([0], np.cumsum(raw < 128)))
    masks[ascii_letters[ends] > ascii_letters[starts]] = _LATIN
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        padded = np.concatenate((raw, np.zeros(3, np.uint8))).astype(np.int64)
        b0, b1, b2, b3 = (padded[lead + k] for k in range(4))
        cp = np.where(
            b0 < 0xE0, ((b0 & 0x1F) << 6) | (b1 & 0x3F),
            np.where(b0 < 0xF0, ((b0 & 0x0F) << 12) | ((b1 & 0x3F) << 6) | (b2 & 0x3F), ((b0 & 7) << 18) | ((b1 & 0x3F) << 12) | ((b2 & 0x3F) << 6) | (b3 & 0x3F)),
        )
        word = np.searchsorted(starts, lead, "right") - 1
        np.bitwise_or.at(masks, word, _SCRIPT_BIT[np.searchsorted(_STARTS, cp, "right") - 1])
    return masks


def _count_batches(languages: list[str]):
    """Counts of buckets by language, as sparse rows, over the texts of one task."""
    at = {x: i for i, x in enumerate(languages)}

    def run(batches):
        size = (1 << TABLE_BITS) + 1
        counts = np.zeros((len(languages), len(ORDERS), size), np.int64)
        scripts = np.zeros((len(languages), len(_NAMES)), np.int64)
        for batch in batches:
            label = np.array([at[x] for x in batch.column(1).to_pylist()], np.int64)
            for row, raw, offsets in text_slices(batch.column(0)):
                raw = _fold(raw)
                starts, ends, first = words_of(raw, offsets, _WORD_BYTE)
                if not len(starts):
                    continue
                grams, heads = _grams(raw, starts, ends)
                lang = np.repeat(label[row : row + len(offsets) - 1], np.diff(first))
                per_byte = np.repeat(lang, ends - starts + 2)
                masks = _script_masks(raw, starts, ends)
                for i in np.unique(lang):
                    for o, bucket in enumerate(grams):
                        counts[i, o] += np.bincount(bucket[per_byte == i], minlength=size)
                    own, weight = masks[lang == i], (ends - starts)[lang == i]
                    for s in range(len(_NAMES)):
                        scripts[i, s] += int(weight[(own >> s) & 1 == 1].sum())
        lang, order, bucket = np.nonzero(counts[:, :, :-1])
        own_lang, script = np.nonzero(scripts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((lang, own_lang)).astype(np.int32)),
                pa.array(np.concatenate((order, np.full(len(script), len(ORDERS)))).astype(np.int32)),
                pa.array(np.concatenate((bucket, script)).astype(np.int32)),
                pa.array(np.concatenate((counts[lang, order, bucket], scripts[own_lang, script]))),
            ],
            names=["lang", "kind", "bucket", "n"],
        )

    return run


def train(labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", max_rows: int = MAX_TRAIN_ROWS) -> LanguageModel:
    """Fit the n-gram model on at most about ``max_rows`` rows per language, chosen by
    a hash of ``key``. Rows without language or text are left out. What reaches the
    driver is a table of fixed size: buckets by languages."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(key).cast("string")).alias("h")).where("lang is not null and text is not null")
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(totals)
    if not languages:
        return LanguageModel([], np.zeros((len(ORDERS), (1 << TABLE_BITS) + 1, 0), np.float32), np.zeros(0, np.int64))
    keep = F.lit(False)
    for name, n in totals.items():
        share = min(1.0, max_rows / n)
        keep = keep | ((F.col("lang") == name) & (F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20))))
    sample = rows.where(keep).select("text", "lang").repartition(8)
    found = sample.mapInArrow(_count_batches(languages), "lang int, kind int, bucket int, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    i, kind, bucket, n = (found.column(c).to_numpy() for c in ("lang", "kind", "bucket", "n"))
    size, k = 1 << TABLE_BITS, len(languages)
    counts = np.zeros((len(ORDERS), size + 1, k), np.float64)
    scripts = np.zeros((k, len(_NAMES)), np.float64)
    grams = kind < len(ORDERS)
    counts[kind[grams], bucket[grams], i[grams]] = n[grams]
    scripts[i[~grams], bucket[~grams]] = n[~grams]
    total = counts.sum(axis=1, keepdims=True)
    logp = np.log((counts + ALPHA) / (total + ALPHA * size))
    logp[:, size, :] = 0
    share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    masks = ((share >= SCRIPT_SHARE) * (1 << np.arange(len(_NAMES)))).sum(axis=1).astype(np.int64)
    return LanguageModel(languages, logp.astype(np.float32), masks)


def _decode(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best language per word. scores: [words, languages]; first: index of each text's first word, and the end."""
    k = scores.shape[1]
    counts = np.diff(first)
    chunks = -(-counts // CHUNK)
    total = int(chunks.sum())
    heads = np.concatenate(([0], np.cumsum(chunks)))
    text = np.repeat(np.arange(len(counts)), chunks)
    nth = np.arange(total) - heads[text]
    begin = first[:-1][text] + nth * CHUNK
    size = np.minimum(CHUNK, first[1:][text] - begin)
    value = np.zeros((len(counts), k))
    before = np.zeros((total, k), np.int16)
    # first pass: best[c, s, l] is the best score of chunk c that ends in l when language s came before it
    for low in range(0, total, step := max(1, ENTRIES // (k * k))):
        high = min(low + step, total)
        best = np.full((high - low, k, k), -1e30, np.float64)
        best[:, np.arange(k), np.arange(k)] = 0
        for t in range(int(size[low:high].max())):
            live = np.flatnonzero(size[low:high] > t)
            own = best[live]
            best[live] = np.maximum(own, own.max(axis=2)[:, :, None] - penalty) + scores[begin[low:high][live] + t][:, None, :]
        order = np.argsort(nth[low:high], kind="stable")
        for c in np.split(order, np.flatnonzero(np.diff(nth[low:high][order])) + 1):
            sums = value[text[low + c]][:, :, None] + best[c]
            before[low + c] = sums.argmax(axis=1)
            value[text[low + c]] = sums.max(axis=1)
    last = np.zeros(total, np.int64)
    came = np.zeros(total, np.int64)
    state = value.argmax(axis=1)
    for j in range(int(chunks.max(initial=0)) - 1, -1, -1):
        live = np.flatnonzero(chunks > j)
        c = heads[live] + j
        last[c] = state[live]
        came[c] = state[live] = before[c, state[live]]
    # second pass: each chunk from the language that came before it to the one it ends in
    labels = np.zeros(len(scores), np.int64)
    for low in range(0, total, step := max(1, ENTRIES // (CHUNK * k))):
        high = min(low + step, total)
        n, longest = high - low, int(size[low:high].max())
        best = np.full((n, k), -1e30, np.float64)
        best[np.arange(n), came[low:high]] = 0
        switched = np.zeros((longest, n, k), bool)
        origin = np.zeros((longest, n), np.int16)
        for t in range(longest):
            live = np.flatnonzero(size[low:high] > t)
            own = best[live]
            jump = own.max(axis=1)[:, None] - penalty
            switched[t, live] = jump > own
            origin[t, live] = own.argmax(axis=1)
            best[live] = np.maximum(own, jump) + scores[begin[low:high][live] + t]
        now = last[low:high].copy()
        for t in range(longest - 1, -1, -1):
            live = np.flatnonzero(size[low:high] > t)
            labels[begin[low:high][live] + t] = now[live]
            now[live] = np.where(switched[t, live, now[live]], origin[t, live], now[live])
    return labels


def _slice_bytes(k: int) -> int:
    """Bytes of text that a pass over words takes at once: fewer for many languages."""
    return max(1 << 12, SLICE_BYTES * 16 // max(16, k))


def _word_scores(model: LanguageModel, folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """[words, languages]; in runs of words, so that a long text takes no more at once than a slice."""
    scores = np.empty((len(starts), len(model.languages)))
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _slice_bytes(len(model.languages)), "right")))
        base = starts[i]
        part, a, b = folded[base : ends[j - 1]], starts[i:j] - base, ends[i:j] - base
        grams, heads = _grams(part, a, b)
        per_byte = model.logp[0][grams[0]]
        for o in range(1, len(ORDERS)):
            per_byte = per_byte + model.logp[o][grams[o]]
        own = np.add.reduceat(per_byte, heads, axis=0).astype(np.float64)
        masks = _script_masks(part, a, b)
        fits = (masks[:, None] & ~model.scripts[None, :]) == 0
        fits[~fits.any(axis=1)] = True
        own[~fits] -= 1000.0
        scores[i:j] = own
        i = j
    return scores


def _label_slice(model: LanguageModel, raw: np.ndarray, offsets: np.ndarray, penalty: float):
    """Per text of a slice: language number or -1, score, spans (start, end in code points, language number)."""
    n, k = len(offsets) - 1, len(model.languages)
    folded = _fold(raw)
    starts, ends, first = words_of(folded, offsets, _WORD_BYTE)
    pick, score, spans = np.full(n, -1), np.zeros(n), [[] for _ in range(n)]
    if not len(starts) or not k:
        return pick, score, spans
    scores = _word_scores(model, folded, starts, ends)
    labels = _decode(scores, first, penalty)
    size = (ends - starts).astype(np.int64)
    text = np.repeat(np.arange(n), np.diff(first))
    weight = np.zeros((n, k))
    np.add.at(weight, (text, labels), size)
    all_of = weight.sum(axis=1)
    has = all_of > 0
    pick[has] = weight[has].argmax(axis=1)
    sums = np.zeros((n, k))
    np.add.at(sums, text, scores)
    sums -= sums.max(axis=1, keepdims=True)
    posterior = np.exp(np.maximum(sums, -700))
    posterior /= posterior.sum(axis=1, keepdims=True)
    rows = np.flatnonzero(has)
    share = weight[rows, pick[rows]] / all_of[rows]
    score[rows] = share * np.where(share < 1, 1.0, posterior[rows, pick[rows]])
    new = np.ones(len(labels), bool)
    new[1:] = (labels[1:] != labels[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    tail = np.concatenate((head[1:], [len(labels)])) - 1
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    for a, b in zip(head, tail, strict=True):
        base = points[offsets[text[a]]]
        spans[text[a]].append((int(points[starts[a]] - base), int(points[ends[b]] - base), int(labels[a])))
    return pick, score, spans


def _has_letter(text: str | None) -> bool:
    return text is not None and any(ch.isalpha() for ch in text)


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text", keep: list[str] | None = None, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """Columns ``keep`` (all, by default) and ``lang_pred``, ``score``, ``spans``.

    ``spans`` has (start, end, lang) in code points, end exclusive, in order. Null
    texts and texts without a letter get ``und``, score 0 and no spans, and so do all
    texts when no language was learned. Equal scores go to the first language by
    name; repeated rows are labelled alike, each for itself; columns of ``docs``
    called like a result are replaced. A very long text is decoded whole, in runs of words: what it
    takes is its words by the languages, and bounded arrays."""
    out_of_the_way(docs, text)
    small_batches(docs.sparkSession)
    extra = ("lang_pred", "score", "spans")
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in extra]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            langs, scores, spans = [], [], []
            for row, raw, offsets in text_slices(texts, _slice_bytes(len(model.languages))):
                pick, score, found = _label_slice(model, raw, offsets, penalty)
                ascii_letter = np.concatenate(([0], np.cumsum(_WORD_BYTE[raw] & (raw < 128))))
                plain = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
                for i in range(len(offsets) - 1):
                    if pick[i] < 0 or not (plain[i] or _has_letter(texts[row + i].as_py())):
                        langs.append("und")
                        scores.append(0.0)
                        spans.append([])
                    else:
                        langs.append(model.languages[pick[i]])
                        scores.append(float(score[i]))
                        spans.append([{"start": a, "end": b, "lang": model.languages[x]} for a, b, x in found[i]])
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=[*kept, *extra])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    schema = f"{fields}, " * bool(kept) + "lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>"
    return source.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """Rows that no model learns from; null, and so not learnt from either, where the key is null."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    found = identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")
