"""How far a stream is behind its source: ticks written by a listener, and positions confirmed to the source."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from .store import Folder

#: Bytes of log that are taken for a second, and seconds between confirmations.
BYTES_PER_SECOND, HEARTBEAT = 1_000_000.0, 10.0
TICKS = "unit string, tick double, source_position string, applied_position string, source_unreachable boolean, applied_unreachable boolean, lag_bytes long, lag_seconds double, events long, quarantined long, unhandled array<string>"


def position_number(lsn: str) -> int:
    high, low = lsn.split("/")
    return (int(high, 16) << 32) + int(low, 16)


class LagMonitor:
    """Compares two positions (``X/Y`` in hexadecimal digits) at each tick and writes what it sees, a small file for each.

    ``source`` and ``applied`` ask for a position; one that raises is unreachable, and then, or if one is null, the lag is
    null.  ``counts`` gives the events applied and quarantined so far and the kinds of messages that were not handled.
    """

    def __init__(self, spark: SparkSession, root: str, unit: str, source: Callable[[], str | None], applied: Callable[[], str | None], counts: Callable[[], tuple[int, int, list[str]]] = lambda: (0, 0, []), rate: float = BYTES_PER_SECOND, clock: Callable[[], float] = time.time) -> None:
        self.folder, self.unit, self.source, self.applied = Folder(spark, root), unit, source, applied
        self.counts, self.rate, self.clock = counts, rate, clock
        self.last, self.unhandled, self.n = (0, 0), [], 0
        self.lock = threading.Lock()

    @staticmethod
    def _ask(provider: Callable[[], str | None]) -> tuple[str | None, bool]:
        try:
            return provider(), False
        except Exception:  # whatever it is, the side does not answer
            return None, True

    def tick(self) -> dict:
        with self.lock:
            (at, no_source), (done, no_applied) = self._ask(self.source), self._ask(self.applied)
            lag = max(0, position_number(at) - position_number(done)) if at is not None and done is not None else None
            events, quarantined, kinds = self.counts()
            self.unhandled += [k for k in kinds if k not in self.unhandled]
            out = {"unit": self.unit, "tick": self.clock(), "source_position": at, "applied_position": done, "source_unreachable": no_source, "applied_unreachable": no_applied, "lag_bytes": lag, "lag_seconds": lag / self.rate if lag is not None and self.rate > 0 else None, "events": max(0, events - self.last[0]), "quarantined": max(0, quarantined - self.last[1]), "unhandled": list(self.unhandled)}
            self.last = (events, quarantined)
            self.folder.write(f"ticks/{self.unit}-{self.n:09d}.json", json.dumps(out, sort_keys=True, separators=(",", ":")))
            self.n += 1
            return out


class LagListener(StreamingQueryListener):
    """Ticks a monitor at each progress of the streams it hears (all, or the one of a name) and confirms what they finished.

    ``confirm`` gets the end offset of the last finished batch, at most once in ``heartbeat`` seconds unless it moved.
    """

    def __init__(self, monitor: LagMonitor, name: str | None = None, confirm: Callable[[str], None] | None = None, heartbeat: float = HEARTBEAT) -> None:
        self.monitor, self.name, self.confirm, self.heartbeat = monitor, name, confirm, heartbeat
        self.flushed, self.told = None, float("-inf")

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.name is not None and p.name != self.name:
            return
        self.monitor.tick()
        end = p.sources[0].endOffset if p.sources else None
        now = self.monitor.clock()
        if end is not None and self.confirm is not None and (end != self.flushed or now - self.told >= self.heartbeat):
            self.flushed, self.told = end, now
            self.confirm(end)

    def onQueryIdle(self, event) -> None:
        self.monitor.tick()

    def onQueryTerminated(self, event) -> None:
        pass


def ticks(spark: SparkSession, root: str) -> DataFrame:
    """The ticks written so far."""
    return spark.read.schema(TICKS).json(f"{root.rstrip('/')}/ticks")


def cutover_ticks(rows: DataFrame, parity: DataFrame | None = None) -> DataFrame:
    """(unit, tick, lag, up, parity) for ``operators.cdc.cutover``: up is that both sides answered; ``parity``: (unit, parity)."""
    up = ~(F.col("source_unreachable") | F.col("applied_unreachable"))
    out = rows.select("unit", F.col("tick").cast("long").alias("tick"), F.col("lag_seconds").alias("lag"), up.alias("up"))
    return out.join(F.broadcast(parity), "unit", "left") if parity is not None else out.withColumn("parity", F.lit(True))
