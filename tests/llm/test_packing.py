import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import packing as P
from lexmill.llm.tokens import encoder, ids_of, vocabulary
from tests.llm.brute import best_fit

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def check(rows, texts, length=1024):
    """All ids, once, in place: a round trip from placed pieces to documents."""
    seqs, docs = {}, {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault(r["doc_id"], []).append(r)
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    for key, text in texts.items():
        ids = ids_of(vocabulary(), text)
        pieces = sorted(docs[key], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert [r["start"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces])[:-1].tolist()
        assert sum(r["length"] for r in pieces) == len(ids)
        assert all(r["length"] == length for r in pieces[1:])
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in pieces)
    return len(seqs)


def test_ids_equal_the_named_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    r = random.Random(1)
    texts = ["", "Größe, naïve\r\n\t x", "don't I'LL we're", "１２³ ½ Ⅷ ٣", "a" * 500, "中文 か 한글 🙂👩‍👩‍👧", "<|endoftext|>", "   x ​", "\x00\x1f"]
    texts += ["".join(chr(r.choice([r.randint(32, 126), r.randint(160, 0x24F), r.randint(0x370, 0x7FF), r.randint(0x3000, 0x9FFF)])) for _ in range(200)) for _ in range(50)]
    assert [encoder(vocabulary())(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_whole_table_round_trip(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = P.op2_packing(spark, SMALL).collect()
    used = check(rows, texts)
    assert used <= -(-sum(r["length"] for r in rows) // 1024) * 1.02 + 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=120))
def test_plan_equals_best_fit_one_by_one(sizes):
    plan = P.plan_best_fit({s: sizes.count(s) for s in set(sizes)}, 32)
    room, seen = {}, {}
    for run in plan:
        for i in range(run.n):
            b, offset = run.bin + i // run.each, run.offset + i % run.each * run.length
            assert room.get(b, 0) == offset
            room[b] = offset + run.length
            seen[run.length] = seen.get(run.length, 0) + 1
    assert seen == {s: sizes.count(s) for s in set(sizes)}
    assert sorted(32 - x for x in room.values()) == best_fit(sizes, 32)


def test_capacity_tree_finds_the_tightest():
    tree, r = P.CapacityTree(20), random.Random(2)
    counts = [0] * 21
    for _ in range(500):
        c = r.randint(0, 20)
        n = 1 if counts[c] == 0 or r.random() < 0.5 else -1
        counts[c] += n
        tree.add(c, n)
        need = r.randint(1, 20)
        assert tree.tightest(need) == next((k for k in range(need, 21) if counts[k]), -1)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "y z"), (4, "word " * 3000)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "text", "1 AS offset", "'a' AS sequence_id")
    got = P.packed(docs).collect()
    assert sorted(r["length"] for r in got if r["doc_id"] in (1, 2)) == [1, 1]
    assert sum(r["doc_id"] == 3 for r in got) == 2 and sum(r["doc_id"] is None for r in got) == 1
    check(got, {1: None, 2: "", 4: rows[-1][1]})


def test_empty_table(spark):
    assert P.packed(spark.createDataFrame([], DOCS)).count() == 0


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * i) for i in range(30)], DOCS)
    placed = P.place_pieces(P.tokenize_pieces(docs, length=64).persist(), length=64)
    whole = P.sequences(placed).collect()
    assert sum(r["length"] for r in whole) == sum(len(ids_of(vocabulary(), f"text number {i} " * i)) for i in range(30))
    assert all(len(r["ids"]) == 4 * r["length"] <= 256 for r in whole)


def test_pieces_longer_than_a_sequence_are_refused():
    with pytest.raises(ValueError):
        P.plan_best_fit({40: 1}, 32)


def test_many_batches_and_buckets_give_the_same_packing(spark):
    r = random.Random(12)
    rows = [(i, 0, r.randint(1, 1024)) for i in range(3000)] + [(-i, 0, 1024) for i in range(1, 500)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long").repartition(3)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "100")
    try:
        for buckets in (7, 100, 4096):
            placed = P.place_pieces(P.durable(pieces, "test-pieces"), bucket_rows=buckets).collect()
            seqs = {}
            for x in placed:
                seqs.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
            for parts in seqs.values():
                ends = 0
                for offset, n in sorted(parts):
                    assert offset == ends
                    ends += n
                assert ends <= 1024
            assert sorted(x["doc_id"] for x in placed) == sorted(x[0] for x in rows)
            assert len(seqs) == len(best_fit([x[2] for x in rows], 1024))
    finally:
        spark.conf.set(key, before)


def test_a_changed_cluster_overlaps_nothing(spark, tmp_path):
    """The scan is split into other tasks between the call and the read, as when executors come or go."""
    key = "spark.sql.leafNodeDefaultParallelism"
    rows = [(i, j, n) for n in (3, 5, 700) for i in range(700) for j in range(2)]
    spark.createDataFrame(rows, "doc_id long, piece int, length long").repartition(6, "doc_id").write.parquet(str(tmp_path / "pieces"))
    try:
        spark.conf.set(key, "4")
        df = P.place_pieces(spark.read.parquet(str(tmp_path / "pieces")), bucket_rows=32)
        spark.conf.set(key, "1")
        placed = df.collect()
    finally:
        spark.conf.unset(key)
    assert len(placed) == len(rows)
    ends = {}
    for r in sorted(placed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= P.LENGTH
