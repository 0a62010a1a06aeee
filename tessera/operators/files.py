"""What to read again: files compared with what is known of them, and rules on paths and extensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Modification times that differ by less are equal.
TOLERANCE = 1e-6


def file_changes(walked: DataFrame, known: DataFrame) -> DataFrame:
    """(path, status) of both sides (path, digest, mtime): cached, changed, new, or stale (known, but gone).

    A file is cached if its digest and its time are those known.
    """
    a = walked.select("path", F.struct("digest", "mtime").alias("w"))
    b = known.select("path", F.struct("digest", "mtime").alias("k"))
    same = F.col("w.digest").eqNullSafe(F.col("k.digest")) & (F.abs(F.col("w.mtime") - F.col("k.mtime")) < TOLERANCE)
    status = F.when(F.col("w").isNull(), "stale").when(F.col("k").isNull(), "new").when(F.coalesce(same, F.lit(False)), "cached").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def rebuild_reasons(meta: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(key, reason) for each expected setting that ``meta`` (key, value) lacks or has otherwise; no row: nothing to rebuild."""
    want = meta.sparkSession.createDataFrame(list(expected.items()), "key string, expected string")
    both = want.join(meta.select("key", "value"), "key", "left")
    return both.select("key", F.when(F.col("value").isNull(), "missing").when(F.col("value") != F.col("expected"), "changed").alias("reason")).where("reason is not null")


def under_roots(path: Column, roots: list[str]) -> Column:
    """Whether a path is one of the roots or lies below one."""
    return reduce(lambda a, b: a | b, [(path == r.rstrip("/")) | F.startswith(path, F.lit(r.rstrip("/") + "/")) for r in roots], F.lit(False))


def path_severity(path: Column, repository: str, scratch: str) -> Column:
    """Of a file that should not be there: HIGH at the top of the repository or outside of all, MEDIUM below it, LOW in the scratch folder."""
    depth = F.size(F.split(F.substring(path, F.lit(len(repository.rstrip("/")) + 2), F.length(path)), "/"))
    return F.when(under_roots(path, [repository]), F.when(depth == 1, "HIGH").otherwise("MEDIUM")).when(under_roots(path, [scratch]), "LOW").otherwise("HIGH")


def path_score(severity: Column) -> Column:
    return F.when(severity == "HIGH", 18).when(severity == "MEDIUM", 12).when(severity == "LOW", 6).otherwise(10)


def worst_severity(severity: Column) -> Column:
    """An aggregate: the highest of HIGH, MEDIUM and LOW."""
    return F.max_by(severity, F.when(severity == "HIGH", 3).when(severity == "MEDIUM", 2).otherwise(1))


def extension(raw: Column) -> Column:
    """Lower case with a leading dot; ``?`` for none."""
    e = F.lower(F.ltrim(raw))
    return F.when(F.coalesce(raw, F.lit("")) == "", "?").when(F.startswith(e, F.lit(".")) | (e == "?"), e).otherwise(F.concat(F.lit("."), e))


def safe_extension(raw: Column) -> Column:
    """(shown, hex): bytes as valid text, and their hex if that changed them."""
    shown = F.make_valid_utf8(raw.cast("string"))
    return F.struct(shown.alias("shown"), F.when(shown.cast("binary") != raw, F.lower(F.hex(raw))).alias("hex"))


def ignored(path: Column, prefixes: list[str], size: Column, most: int) -> Column:
    """Why a walk leaves a file out: an ignored prefix, a declaration file, or its size; null if it does not."""
    skip = reduce(lambda a, b: a | b, [F.startswith(path, F.lit(p)) for p in prefixes], F.lit(False))
    return F.when(skip, "ignored").when(F.endswith(path, F.lit(".d.ts")), "declaration").when(size > most, "too_large")


def walk(spark, root: str, pattern: str, prefixes: list[str], most: int) -> DataFrame:
    """(path, length, mtime, skipped) of the files below ``root`` on any file system Spark reads; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length", "modificationTime")
    path = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/*", "/")
    inside = F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path))
    return files.select(inside.alias("path"), "length", F.col("modificationTime").alias("mtime"), ignored(inside, prefixes, F.col("length"), most).alias("skipped"))


def dotenv(lines: Column) -> Column:
    """Of an array of lines: name and value of those that set an upper-case name."""
    from ..functions.redact import unquote

    kept = F.filter(lines, lambda x: x.rlike("^[A-Z][A-Z0-9_]*="))
    return F.transform(kept, lambda x: F.struct(F.regexp_extract(x, "^([A-Z][A-Z0-9_]*)=", 1).alias("name"), unquote(F.regexp_extract(x, "^[A-Z][A-Z0-9_]*=(.*)$", 1)).alias("value")))
