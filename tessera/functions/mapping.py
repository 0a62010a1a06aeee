"""Column mappings: sketches, confidence, prompts, embeddings by hash, and checks of what transformers give."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Dimensions of an embedding by hash.
DIMS = 384


def sketch_ranks(columns: DataFrame, sketches: DataFrame, k: int = 3) -> DataFrame:
    """(column, rank, sketch, score): sketches of a column's type pair by pass rate and 0.05 for each of its
    blockers that they apply to, without those pruned for it; ties in the library's order.

    ``columns``: column, type_pair, blockers, pruned; ``sketches``: sketch, type_pair, pass_rate, applicable, place.
    """
    both = columns.join(F.broadcast(sketches), "type_pair").where(~F.array_contains("pruned", F.col("sketch")))
    score = F.col("pass_rate") + F.size(F.array_intersect("blockers", "applicable")) * 0.05
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("score"), "place"))
    return both.withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= k).select("column", "rank", "sketch", "score")


def confidence(base: Column, status: Column, iteration: Column, tier_failures: Column) -> Column:
    x = F.when(status == "ok", base).otherwise(base * 0.7) * F.greatest(F.lit(0.6), 1.0 - (iteration - 1) * 0.05)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x * (1.0 - tier_failures * 0.05)))


def lossless(legacy: Column, target: Column) -> Column:
    """Whether every value of the legacy type is one of the target type."""
    a, b = F.upper(legacy), F.upper(target)
    width = F.create_map(*[F.lit(x) for kv in (("SMALLINT", 1), ("INTEGER", 2), ("INT", 2), ("BIGINT", 3)) for x in kv])
    text = a.rlike("^(VARCHAR|STRING|CHAR)") & b.isin("STRING", "TEXT", "CLOB")
    return F.coalesce((a != "") & (b != "") & ((a == b) | text | F.coalesce(F.try_element_at(width, b) >= F.try_element_at(width, a), F.lit(False))), F.lit(False))


def prompt(name: Column, table: Column, kind: Column, raw: Column, nullable: Column, comment: Column, samples: Column, usages: Column) -> Column:
    """The text that is embedded for a column; ``samples`` and ``usages`` are arrays, of which 20 and 5 are shown."""
    n = F.size(usages)
    use = F.when(n == 0, "(none)").otherwise(F.concat(F.array_join(F.slice(usages, 1, 5), "; "), F.when(n > 5, F.concat(F.lit("; ... and "), (n - 5).cast("string"), F.lit(" more"))).otherwise("")))
    lines = [("COLUMN: ", name), ("TABLE: ", table), ("TYPE: ", F.concat(kind, F.lit(" (raw: "), raw, F.lit(")"))), ("NULLABLE: ", F.initcap(nullable.cast("string"))), ("COMMENT: ", F.coalesce(F.when(comment != "", comment), F.lit("(none)"))), ("SAMPLES: ", F.array_join(F.slice(samples, 1, 20), ", ")), ("CODE_USAGE: ", use)]
    return F.concat(*[x for head, value in lines for x in (F.lit(head), value, F.lit("\n"))])


def hashed_vector(text: str, dims: int = DIMS) -> np.ndarray:
    """Unit vector of a text from a stream of digests; equal texts have equal ones, and that is all it says."""
    stream = b"".join(hashlib.sha256(text.encode() + i.to_bytes(4, "big")).digest() for i in range(-(-dims * 4 // 32)))
    x = np.frombuffer(stream, np.uint32, dims).astype(np.float32) / np.float32(2**32 - 1) - np.float32(0.5)
    n = np.linalg.norm(x)
    return (x / n if n > 0 else x).astype(np.float32)


def embed(text: Column, backend: Callable[[str], np.ndarray] = hashed_vector) -> Column:
    """Vectors of texts by a backend, a function that executors can run."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else backend(t))

    return run(text)


def scored(stats: DataFrame, score: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Adds ``score`` by a function of the rows' statistics (a frame in, a series out), one Arrow batch at a time."""
    names = stats.columns
    run = F.pandas_udf(lambda s: score(s).astype("float64"), "double")
    return stats.withColumn("score", run(F.struct(*names)))


def property_checks(df: DataFrame, before: str, after: str, *, inverse: Column | None = None, precision: int | None = None, from_above: bool = False) -> DataFrame:
    """One row with the rows that break each property of a transformer: null_passthrough, no_null_emission, reversibility, within_target_precision.

    Values of a magnitude below ``10 ** precision`` are within it; with ``from_above``, all that are not greater than ``10 ** precision - 1``.
    """
    a, b = F.col(before), F.col(after)
    checks = [F.count_if(a.isNull() & b.isNotNull()).alias("null_passthrough"), F.count_if(a.isNotNull() & b.isNull()).alias("no_null_emission")]
    if inverse is not None:
        checks.append(F.count_if(~inverse.eqNullSafe(a)).alias("reversibility"))
    if precision is not None:
        beyond = b > float(10**precision - 1) if from_above else F.abs(b) >= float(10**precision)
        checks.append(F.count_if(beyond).alias("within_target_precision"))
    return df.agg(*checks)


def pg_timestamp(micros: Column, timespec: str = "auto") -> Column:
    """Microseconds since the year 2000 as ISO 8601 text in UTC.

    ``timespec`` as in Python's ``isoformat``: ``auto`` leaves out a fraction of zero, ``microseconds`` always writes six digits.
    """
    if timespec not in ("auto", "microseconds"):
        raise ValueError(f"timespec {timespec!r}")
    at, rest = F.timestamp_micros(micros + F.lit(946684800000000)), F.pmod(micros, F.lit(1_000_000))
    # years beyond 9999 come with a sign
    text = F.regexp_replace(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), r"^\+", "")
    fraction = F.concat(F.lit("."), F.lpad(rest.cast("string"), 6, "0"))
    return F.concat(text, fraction if timespec == "microseconds" else F.when(rest != 0, fraction).otherwise(""), F.lit("+00:00"))


def padded_zone(text: Column) -> Column:
    """``+HH`` at the end becomes ``+HH:00``."""
    return F.regexp_replace(text, r"([+-]\d\d)$", "$1:00")
