"""Structured Streaming forms of change replay and windowed counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .store import BucketStore, replay_into


def fresh_events(events: DataFrame) -> DataFrame:
    """Of a stream (tab, lsn, seq, payload, arrival): the events beyond the (lsn, seq) that arrived before of their table.

    A micro-batch of one table is one group, bounded by the source's rate limit.

    The state of a table is one pair, so it does not grow with the stream; it lives in the
    query's checkpoint and survives a restart.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top = state.get if state.exists else (-1, -1)
        # a shuffle gives the rows of a micro-batch in any order: they are taken by arrival
        rows = pd.concat(list(frames)).sort_values("arrival", kind="stable")
        own = list(zip(rows["lsn"].astype("int64"), rows["seq"].astype("int64"), strict=True))
        before = list(accumulate(own, max, initial=tuple(top)))
        state.update((int(before[-1][0]), int(before[-1][1])))
        yield rows[[x > t for x, t in zip(own, before, strict=False)]][["tab", "lsn", "seq", "payload"]]

    return events.select("tab", "lsn", "seq", "payload", "arrival").groupBy("tab").applyInPandasWithState(step, "tab string, lsn long, seq long, payload string", "lsn long, seq long", "append", GroupStateTimeout.NoTimeout)


def apply_batches(changes: DataFrame, path: str, key: str, op: str, order: list[str], checkpoint: str, kept: int = 2):
    """The state after all changes: of each key the last one, unless it is a deletion; see ``store`` and read with ``current``."""
    return replay_into(changes, BucketStore(changes.sparkSession, path, [key], op, order, kept=kept), checkpoint)


def current(spark: SparkSession, path: str, key: str, op: str, order: list[str]) -> DataFrame:
    """The rows of ``apply_batches`` that are not deleted."""
    return BucketStore(spark, path, [key], op, order).current()


def windowed_counts(events: DataFrame, ts: str, key: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """An extension: counts in event-time windows with a watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count(F.lit(1)).alias("n"))


def deduplicated(events: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """In-flight deduplication: a repeated key within the watermark is dropped."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)
