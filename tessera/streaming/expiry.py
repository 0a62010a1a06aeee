"""State that ends by timers: a store whose entries expire, and requests that wait for one already in flight.

Both take event time: a timer fires when the watermark passes it, so a replay gives the same answers, and what nobody asks
for leaves the state by itself.  Timers need the RocksDB state store: see ``rocksdb_state``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: Seconds that an entry is kept.
TTL = 120.0


def rocksdb_state(spark: SparkSession) -> None:
    """New streams of the session keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ms(seconds: float) -> int:
    return int(round(seconds * 1000))


class _Expiring(StatefulProcessor):
    def __init__(self, seconds: float) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value string, until double")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = self.entry.get() if self.entry.exists() else None
        before = held
        for r in sorted(rows, key=lambda r: r.at):
            if held is not None and r.at >= held[1]:
                yield Row(key=key[0], at=held[1], value=None, status="expired")
                held = None
            if r.action == "put":
                held = (r.value, r.at + self.seconds)
            else:
                yield Row(key=key[0], at=r.at, value=held and held[0], status="found" if held else "missing")
                held = None
        if before is not None and (held is None or held[1] != before[1]):
            self.handle.deleteTimer(_ms(before[1]))
        if held is None:
            self.entry.clear()
        elif held != before:
            self.entry.update(tuple(held))
            self.handle.registerTimer(_ms(held[1]))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.entry.exists() and _ms(self.entry.get()[1]) <= expiredTimerInfo.getExpiryTimeInMs():
            until = self.entry.get()[1]
            self.entry.clear()
            yield Row(key=key[0], at=until, value=None, status="expired")

    def close(self) -> None:
        pass


def _timed(rows: DataFrame, late: str) -> DataFrame:
    return rows.withColumn("event_time", F.timestamp_seconds("at")).withWatermark("event_time", late)


def expiring_store(requests: DataFrame, seconds: float = TTL, late: str = "0 seconds") -> DataFrame:
    """Answers to a stream of requests (key, action, value, at in seconds): ``put`` keeps a value for some time, ``pop`` takes it once.

    Gives (key, at, value, status): ``found`` or ``missing`` for each pop, and ``expired``, unasked, for each value that
    nobody took in time; a value that is put over another replaces it.  The state of a key is one value, until its timer.
    Requests may come ``late``; those later than that are dropped.
    """
    rows = _timed(requests.select("key", "action", "value", F.col("at").cast("double").alias("at")), late)
    return rows.groupBy("key").transformWithState(_Expiring(seconds), "key string, at double, value string, status string", "append", "EventTime")


class _InFlight(StatefulProcessor):
    def __init__(self, seconds: float) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.leader = handle.getValueState("leader", "request string, until double")
        self.waiting = handle.getListState("waiting", "request string")

    def _end(self, key: tuple, at: float, status: str, result: str | None) -> Iterator[Row]:
        leader = self.leader.get()[0]
        for request in [leader, *(w[0] for w in (self.waiting.get() if self.waiting.exists() else []))]:
            yield Row(agent=key[0], key=key[1], request=request, at=at, status=status, result=result)
        self.leader.clear()
        self.waiting.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (r.at, r.action != "complete", r.request or "")):
            held = self.leader.get() if self.leader.exists() else None
            if held is not None and r.at >= held[1]:
                self.handle.deleteTimer(_ms(held[1]))
                yield from self._end(key, held[1], "abandoned", None)
                held = None
            if r.action == "complete":
                if held is not None:
                    self.handle.deleteTimer(_ms(held[1]))
                    yield from self._end(key, r.at, "completed", r.result)
            elif held is None:
                self.leader.update((r.request, r.at + self.seconds))
                self.handle.registerTimer(_ms(r.at + self.seconds))
                yield Row(agent=key[0], key=key[1], request=r.request, at=r.at, status="leader", result=None)
            else:
                self.waiting.appendValue((r.request,))
                yield Row(agent=key[0], key=key[1], request=r.request, at=r.at, status="follower", result=None)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.leader.exists() and _ms(self.leader.get()[1]) <= expiredTimerInfo.getExpiryTimeInMs():
            yield from self._end(key, self.leader.get()[1], "abandoned", None)

    def close(self) -> None:
        pass


def in_flight(requests: DataFrame, seconds: float = TTL, late: str = "0 seconds") -> DataFrame:
    """In-flight deduplication of requests (agent, key, request, action, result, at in seconds).

    The first ``acquire`` of (agent, key) is the ``leader``; those that come until it ends are ``follower`` and wait.  ``complete`` ends it:
    the leader and all who wait get its result (``completed``).  One that does not complete in time is ``abandoned`` by a
    timer, and so are those who wait.  Gives (agent, key, request, at, status, result).
    """
    rows = _timed(requests.select("agent", "key", "request", "action", "result", F.col("at").cast("double").alias("at")), late)
    return rows.groupBy("agent", "key").transformWithState(_InFlight(seconds), "agent string, key string, request string, at double, status string, result string", "append", "EventTime")
