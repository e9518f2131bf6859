"""Streams that process all that is there equal the batch operators."""

from pyspark.sql import functions as F

from lexmill.operators.ledger import fold_latest
from lexmill.streaming import ledger as S
from tests.oracle import SMALL

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def split_events(spark, folder):
    e = spark.read.schema(SCHEMA).parquet(f"{SMALL}/events.parquet")
    e.repartition(6).write.parquet(folder)
    return e


def test_latest_state_equals_batch(spark, tmp_path):
    e = split_events(spark, str(tmp_path / "in"))
    state = S.latest_state(S.read_ledger(spark, str(tmp_path / "in"), SCHEMA, files_per_batch=2), ["user_id"], "event_id", ["event_type", "value"])
    got = S.run_available(state, "latest_state", str(tmp_path / "cp"))
    want = fold_latest(e, ["user_id"], "event_id", ["event_type", "value"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_published_state_is_the_last_one(spark, tmp_path):
    e = split_events(spark, str(tmp_path / "in"))
    state = S.latest_state(S.read_ledger(spark, str(tmp_path / "in"), SCHEMA, files_per_batch=3), ["user_id"], "event_id", ["event_type"])
    S.publish(state, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.schema("user_id long, event_type string").json(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fold_latest(e, ["user_id"], "event_id", ["event_type"]).collect()))


def test_duplicates_within_the_watermark(spark, tmp_path):
    e = split_events(spark, str(tmp_path / "in"))
    e.limit(50).write.mode("append").parquet(str(tmp_path / "in"))
    once = S.once_within(S.read_ledger(spark, str(tmp_path / "in"), SCHEMA, files_per_batch=100), ["event_id"], "ts", "400 days")
    assert S.run_available(once, "once", str(tmp_path / "cp"), "append").count() == e.count()


def test_activity_windows(spark, tmp_path):
    e = split_events(spark, str(tmp_path / "in"))
    got = S.run_available(S.activity(S.read_ledger(spark, str(tmp_path / "in"), SCHEMA), "ts", "event_type", "1 day", "400 days"), "activity", str(tmp_path / "cp"))
    want = e.groupBy(F.window("ts", "1 day")["start"].alias("w"), "event_type").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
