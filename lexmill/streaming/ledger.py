"""Claim ledgers as streams: the same folds as in batch, fed by new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.ledger import fold_latest


def read_ledger(spark: SparkSession, folder: str, schema: str, *, files_per_batch: int = 8, pattern: str = "*") -> DataFrame:
    """A stream over the parquet files of an append-only ledger folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(folder)


def latest_state(stream: DataFrame, keys: list[str], seq: str, columns: list[str]) -> DataFrame:
    """The batch fold on a stream: state holds one row per key, whatever the history's length."""
    return fold_latest(stream, keys, seq, columns)


def once_within(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Repeated deliveries of a record dropped; state is forgotten ``delay`` behind the newest time."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def activity(stream: DataFrame, ts: str, kind: str, width: str, delay: str) -> DataFrame:
    """window_start, kind, n in tumbling windows; later records than ``delay`` are left out."""
    counted = stream.withWatermark(ts, delay).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), kind, "n")


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Process what is there, then stop; the result as an in-memory table (for tests and small states)."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def publish(df: DataFrame, target: str, checkpoint: str, mode: str = "complete"):
    """Each trigger's whole state replaces ``target`` by a staged rename; a replayed trigger writes the same."""
    from lexmill.sources.sinks import replace_jsonl

    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: replace_jsonl(batch, target)).trigger(availableNow=True).start()
