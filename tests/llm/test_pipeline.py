import zlib

import corpus_pipeline as C
from lexmill.llm.language_id import held_out, identify, train
from lexmill.llm.pii import find, luhn, mask
from lexmill.llm.tokens import ids_of, vocabulary
from tests.llm.brute import components, contamination

SMALL = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    model = train(docs.where(~held_out()))
    labels = {r["doc_id"]: r["lang_pred"] for r in identify(docs, model, keep=["doc_id"]).collect()}
    kept = {i: r["text"] for i, r in rows.items() if labels[i] != "und"}
    part = components(list(kept.items()))
    kept = {i: t for i, t in kept.items() if part[i][1] == i}
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept.items() if not contamination(t, items)[1]}
    kept = {i: mask(t, find(t)) for i, t in kept.items()}
    got = {}
    for r in C.run(spark, SMALL).collect():
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert set(got) == set(kept)
    for i, text in kept.items():
        ids = ids_of(vocabulary(), text)
        assert sum(p[2] for p in got[i]) == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == crc for _, s, n, crc in got[i])


def test_stages_return_documents(spark):
    docs = spark.createDataFrame([(1, "the cat and a@b.cd", "en", "s", 3), (2, None, None, "s", 0), (3, "...", "en", "s", 3), (4, "the cat and a@b.cd", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).persist()
        assert docs.columns == list(C.COLUMNS), name
    assert [tuple(r) for r in docs.collect()] == [(1, "the cat and <EMAIL>", "en", "s", 19)]
    assert len(C.STAGES) == 5 and C.ORACLE_SQL is None and luhn("79927398713")
