"""Streams beside change capture: histories with replay, tickers and debounced deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def job_events(spark: SparkSession, path: str, schema: str, job: str | None = None) -> DataFrame:
    """The events of a job (of all jobs): those written so far, then those that arrive."""
    events = spark.readStream.schema(schema).parquet(path)
    return events.where(F.col("job") == job) if job else events


def replay(spark: SparkSession, path: str, key: str, last: object | None = None) -> DataFrame:
    """What comes after the entry ``last`` in a history; an unknown entry replays all."""
    rows = spark.read.parquet(path)
    if last is None or rows.where(F.col(key) == last).isEmpty():
        return rows
    return rows.where(F.col(key) > last)


def ticker(events: DataFrame, keys: list[str], name: str, checkpoint: str, every: str = "500 milliseconds"):
    """Counts of each key so far, shown in a memory table at an interval."""
    counts = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def debounced_deltas(changes: DataFrame, key: str, order: str, publish, checkpoint: str, every: str | None = None):
    """Hands the last change of each key of an interval to ``publish(batch, epoch)``; a retried batch has the same epoch."""

    def one(batch: DataFrame, epoch: int) -> None:
        columns = [c for c in batch.columns if c != key]
        publish(batch.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, "r.*"), epoch)

    stream = changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()


def flushed_position(progress: list[dict]) -> str | None:
    """The end offset of the last batch that a query has finished: what may be confirmed to its source."""
    done = [p for p in progress if p and p.get("sources")]
    return done[-1]["sources"][0]["endOffset"] if done else None
