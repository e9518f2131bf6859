import random

import numpy as np

from lexmill.llm import language_id as L

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"


def corpus(n=40):
    r = random.Random(5)
    words = {"aa": ["kato", "lani", "moke", "tilo"], "bb": ["струк", "весна", "пол"], "cc": ["schrank", "pfund", "zwerg"]}
    return [(i, " ".join(r.choice(words[lang]) for _ in range(30)), lang) for i, lang in enumerate(list(words) * n)]


def model(spark):
    return L.train(spark.createDataFrame(corpus(), DOCS))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    rows = L.op1_language_id(spark, SMALL).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_every_row_comes_back_once(spark):
    got = [r["doc_id"] for r in L.op1_language_id(spark, SMALL).collect()]
    want = [r["doc_id"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted(got) == sorted(want)


def test_mixed_text_gets_a_span_for_each_language(spark):
    text = "kato lani moke " * 8 + "schrank pfund zwerg " * 8 + "пол весна струк " * 8
    found = L.identify(spark.createDataFrame([(1, text, "aa")], DOCS), model(spark)).first()
    assert [s["lang"] for s in found["spans"]] == ["aa", "cc", "bb"]
    assert text[found["spans"][2]["start"] : found["spans"][2]["end"]].split() == ["пол", "весна", "струк"] * 8


def test_texts_without_letters(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 ... €€ 中!"[:9], "x"), (None, "kato lani moke", None), (5, "kato lani", "zz"), (5, "kato lani", "zz")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS score", "2 AS spans")
    got = L.identify(docs, model(spark)).collect()
    assert [r["lang_pred"] for r in got] == ["und", "und", "und", "aa", "aa", "aa"]
    assert [r["score"] == 0.0 for r in got] == [True, True, True, False, False, False]
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "lang_pred", "score", "spans"}


def test_no_model_and_no_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    none = L.train(empty)
    assert none.languages == []
    assert [r["lang_pred"] for r in L.identify(spark.createDataFrame([(1, "abc", None)], DOCS), none).collect()] == ["und"]
    assert L.identify(empty, none).count() == 0


def test_long_text_is_labelled_to_its_end(spark):
    text = "kato lani moke tilo " * 120_000 + "schrank pfund zwerg " * 50
    spans = L.identify(spark.createDataFrame([(1, text, None)], DOCS), model(spark)).first()["spans"]
    assert [s["lang"] for s in spans] == ["aa", "cc"] and spans[1]["end"] == len(text) - 1


def test_chunked_decoding_equals_plain_viterbi():
    r = np.random.default_rng(3)
    for _ in range(20):
        counts = r.integers(0, 300, 6)
        first = np.concatenate(([0], np.cumsum(counts)))
        scores = r.normal(size=(first[-1], 3)) * 3
        got = L._decode(scores, first, 4.0)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if a == b:
                continue
            best, back = scores[a].copy(), []
            for t in range(a + 1, b):
                jump = best.max() - 4.0
                back.append(np.where(best >= jump, np.arange(3), best.argmax()))
                best = np.maximum(best, jump) + scores[t]
            path = [int(best.argmax())]
            for p in reversed(back):
                path.append(int(p[path[-1]]))
            value = lambda labels: sum(scores[a + i][x] for i, x in enumerate(labels)) - 4.0 * sum(x != y for x, y in zip(labels, labels[1:], strict=False))
            assert np.isclose(value(path[::-1]), value(got[a:b].tolist()))


def test_a_row_without_id_is_not_held_out(spark, tmp_path):
    rows = [(None, "kato lani moke", "zz"), (3, "kato lani", "zz"), (4, "sumi tare", "yy"), (6, "sumi tare kola", "yy"), (9, "kato moke", "zz")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["held_out"] for r in L.op1_language_id(spark, str(tmp_path)).collect()}
    assert got[None] is False and all(isinstance(x, bool) for x in got.values())
