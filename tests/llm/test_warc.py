import base64
import gzip
import hashlib

import pytest

from lexmill.llm import warc as W
from lexmill.llm.common import durable, scratch_path
from tests.oracle import same_rows

SMALL = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


def test_equals_sql(spark):
    same_rows(W.op6_warc(spark, SMALL), W.OP6_SQL, SMALL)


def test_copies_revisit_the_smallest(spark):
    rows = [(5, "u", "a\r\n\r\nb"), (3, None, "a\r\n\r\nb"), (9, "x y\nz", None), (8, "é", ""), (7, "w", "ü" * 70_000), (None, "n", "a\r\n\r\nb")]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS digest", "2 AS refers_to", "3 AS record_type")
    got = {r["page_id"]: r for r in W.archived(df).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {5: ("revisit", 3), 3: ("response", None), 9: ("revisit", 8), 8: ("response", None), 7: ("response", None), None: ("revisit", 3)}
    for i, _, html in rows:
        data = (html or "").encode()
        assert got[i]["payload_bytes"] == len(data)
        assert got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_minimum_size_keeps_small_ones_whole(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "v", "ab"), (3, "w", "abc"), (4, "x", "abc")], PAGES)
    got = {r["page_id"]: r["record_type"] for r in W.with_originals(df, min_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_repeated_rows_have_one_response(spark):
    df = spark.createDataFrame([(1, "u", "a")] * 3, PAGES)
    assert sorted((r["record_type"], r["refers_to"]) for r in W.archived(df).collect())[1:] == [("revisit", 1), ("revisit", 1)]


def test_selected_records_are_read_by_range(spark):
    where = scratch_path(spark, "warc-test")
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * 50) for i in range(200)], PAGES).repartition(3)
    index = durable(W.write_archives(W.with_originals(pages), where), "index-test")
    got = W.read_records(index.where("url IN ('http://h/7', 'http://h/8', 'http://h/150')"), where).collect()
    assert {(r["page_id"], bytes(r["payload"]).decode()) for r in got} == {(i, f"<p>{i}</p>" * 50) for i in (7, 8, 150)}
    one = index.first()
    member = open(f"{where.removeprefix('file://')}/{one['file']}", "rb").read()[one["offset"] : one["offset"] + one["length"]]
    assert gzip.decompress(member).startswith(b"WARC/1.1\r\nWARC-Type: response")


def test_ranges_close_at_gaps_and_size():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 500, 10), ("b", 510, 10), ("b", 520, 90)]
    assert [len(g) for g in W.coalesced(rows, gap=100, most=95)] == [2, 1, 1, 1]


def test_damage_raises():
    digest = base64.b32encode(hashlib.sha1(b"x").digest()).decode()
    record = W.record_bytes(1, "u", b"y", digest, "response", None)
    with pytest.raises(ValueError):
        W.parse_record(gzip.compress(record))


def test_empty_table(spark):
    assert W.archived(spark.createDataFrame([], PAGES)).count() == 0


def test_a_changed_cluster_loses_no_original(spark, tmp_path):
    """The scan is split into other tasks between the call and the read, as when executors come or go."""
    key = "spark.sql.leafNodeDefaultParallelism"
    rows = [(i, f"u{i}", f"<p>{i % 250}</p>" * 40) for i in range(750)] + [(5, "twice", "<p>5</p>" * 40)] * 2
    spark.createDataFrame(rows, PAGES).repartition(6, "page_id").write.parquet(str(tmp_path / "pages"))
    try:
        spark.conf.set(key, "4")
        df = W.with_originals(spark.read.parquet(str(tmp_path / "pages")))
        spark.conf.set(key, "1")
        got = df.select("page_id", "record_type", "refers_to").collect()
    finally:
        spark.conf.unset(key)
    assert sum(r["record_type"] == "revisit" for r in got) == 502
    assert sorted(r["page_id"] for r in got if r["record_type"] == "response") == list(range(250))
    assert all(r["refers_to"] == r["page_id"] % 250 for r in got if r["record_type"] == "revisit")


def test_one_long_payload(spark):
    html = "<p>é</p>" * 1_000_000
    got = {r["page_id"]: r for r in W.archived(spark.createDataFrame([(1, "u", html), (2, "v", html), (3, "w", "x")], PAGES)).collect()}
    assert (got[1]["record_type"], got[2]["refers_to"]) == ("response", 1)
    assert got[2]["payload_bytes"] == len(html.encode())
    assert got[2]["payload_digest"] == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
