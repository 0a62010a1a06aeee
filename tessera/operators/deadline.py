"""Work in chunks that stops at a deadline and keeps what is finished."""

from __future__ import annotations

import json
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.store import Folder


@dataclass
class Partial:
    """What a run left: chunks finished (now or in an earlier run), chunks that were stopped or not begun, chunks that failed and why."""

    finished: list[str] = field(default_factory=list)
    unfinished: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)


def hashed_chunks(df: DataFrame, key: str, n: int) -> dict[str, DataFrame]:
    """``n`` parts of a table by a hash of a key; each reads the table, so this pays where the work on a row outweighs reading it."""
    return {f"{i:05d}": df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)}


def run_until(spark: SparkSession, chunks: dict[str, DataFrame], root: str, seconds: float, parallel: int = 4) -> Partial:
    """Writes chunks under ``root``, ``parallel`` at once, until all are done or the time is over; jobs still running then are cancelled.

    A chunk that is whole has an entry in a ledger; ``results`` reads only those, and another run with the same
    ``root`` takes up the others.  A chunk that fails does not stop the rest.
    """
    folder, tag, end = Folder(spark, root), f"chunks-{uuid.uuid4().hex}", time.monotonic() + seconds
    context, done = spark.sparkContext, {n.removesuffix(".json") for n in folder.names("ledger")}
    out, stopped, lock = Partial(sorted(done & set(chunks))), threading.Event(), threading.Lock()

    def one(name: str, df: DataFrame) -> None:
        if stopped.is_set() or time.monotonic() >= end:
            return
        context.addJobTag(tag)  # tags belong to the thread
        context.setInterruptOnCancel(True)
        try:
            df.write.mode("overwrite").parquet(f"{root}/chunk={name}")
            if stopped.is_set():
                return
            with lock:
                folder.write(f"ledger/{name}.json", json.dumps({"chunk": name}))
                out.finished.append(name)
        except Exception as e:
            if not stopped.is_set():
                out.failed[name] = str(e).split("\n")[0]
        finally:
            context.removeJobTag(tag)

    with ThreadPoolExecutor(parallel) as pool:
        running = [pool.submit(one, n, d) for n, d in chunks.items() if n not in done]
        wait(running, timeout=max(0.0, end - time.monotonic()))
        with lock:
            stopped.set()
        # a job may start just after the tag was cancelled
        while not all(f.done() for f in running):
            context.cancelJobsWithTag(tag)
            wait(running, timeout=0.2)
    out.finished.sort()
    out.unfinished = sorted(set(chunks) - set(out.finished) - set(out.failed))
    return out


def results(spark: SparkSession, root: str) -> DataFrame | None:
    """The rows of all finished chunks, with their ``chunk``; None if there are none."""
    done = [n.removesuffix(".json") for n in Folder(spark, root).names("ledger")]
    if not done:
        return None
    schema = spark.read.parquet(f"{root}/chunk={done[0]}").schema.add("chunk", "string")
    return spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/chunk={n}" for n in done])
