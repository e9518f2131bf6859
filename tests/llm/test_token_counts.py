import random

import numpy as np
import pytest

from lexmill.llm import token_counts as C
from lexmill.llm.tokens import encoder, vocabulary

SMALL = "/root/testdata/sf0.001"


def test_counts_equal_direct_tokenization(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r["doc_id"]: r["n_tokens"] for r in C.op4_token_counts(spark, SMALL).collect()}
    assert got == {r["doc_id"]: len(encoder(vocabulary())(r["text"] or "")) for r in docs}


@pytest.mark.parametrize("block", [1, 3, 16, 10_000])
def test_any_block_size_gives_the_same_documents(spark, tmp_path, block):
    r, want = random.Random(4), []
    for k in range(6):
        ids = [r.choice([9, 1, 2]) for _ in range(r.randint(0, 70))] if k else []
        np.array(ids, "<u4").tofile(tmp_path / f"f{k}.bin")
        start, n = 0, 0
        for i, x in enumerate(ids):
            if x == 9:
                want.append((f"f{k}.bin", n, start, i - start, True))
                start, n = i + 1, n + 1
        if start < len(ids):
            want.append((f"f{k}.bin", n, start, len(ids) - start, False))
    got = C.count_tokens(C.list_token_files(spark, str(tmp_path)), str(tmp_path), separator=9, dtype="<u4", block_tokens=block)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "<|endoftext|>"), (4, "x " * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS file", "2 AS n_tokens")
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in C.document_token_counts(df).collect()), key=repr)
    assert got == sorted(((i, len(encoder(vocabulary())(x or ""))) for i, x in rows), key=repr)


def test_empty_table(spark):
    assert C.document_token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_torn_file_raises(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole number"):
        C.count_tokens(C.list_token_files(spark, str(tmp_path)), str(tmp_path)).collect()
