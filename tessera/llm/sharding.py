"""Shards by extendible hashing.

The directory is indexed by the leading bits of a row's hash.  A bucket splits on one
more bit only while it is over the byte limit, so shards have prefixes of different
lengths.  Sizes are summed once into fine buckets; the directory is found from those
sums, and rows then look up their bucket.  Everything is DataFrame operations; only
rows of buckets that the fine bits could not split are taken to further bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 28  # bits taken from the hash at a time


def hash_bits(key: Column, word: int) -> Column:
    """The ``word``-th run of WORD bits of the md5 of the key."""
    digits = WORD // 4
    return F.conv(F.substring(F.md5(key.cast("string")), 1 + word * digits, digits), 16, 10).cast("long")


def _split(rows: DataFrame, limit: int, word: int, last: int) -> DataFrame:
    """rows: (..., key, n_bytes, prefix); adds shard and oversize."""
    total = rows.groupBy("prefix").agg(F.sum("n_bytes").alias("b")).agg(F.max("b")).first()[0] or 0
    bits = min(WORD, max(1, math.ceil(math.log2(max(1, total / limit))) + 8))
    rows = rows.withColumn("h", F.shiftright(hash_bits(F.col("key"), word), WORD - bits))
    fine = rows.groupBy("prefix", "h").agg(F.sum("n_bytes").alias("b"))
    steps = fine.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(bits)))).withColumn("lead", F.expr(f"shiftright(h, {bits} - depth)"))
    node = steps.groupBy("prefix", "depth", "lead").agg(F.sum("b").alias("b")).where(F.col("b") <= limit)
    leaf = steps.select("prefix", "h", "depth", "lead").join(node, ["prefix", "depth", "lead"]).groupBy("prefix", "h").agg(F.min("depth").alias("depth"))
    leaf = fine.join(leaf, ["prefix", "h"], "left").select("prefix", "h", "depth", (F.col("depth").isNull()).alias("open"))
    # only non-empty buckets exist: at most one for each row, and 2 ** bits
    rows = rows.join(leaf, ["prefix", "h"])
    code = F.expr(f"substring(lpad(bin(h), {bits}, '0'), 1, coalesce(depth, {bits}))")
    rows = rows.withColumn("shard", F.concat("prefix", code))
    done = rows.where("not open").withColumn("oversize", F.lit(False))
    rest = rows.where("open")
    names = [c for c in rows.columns if c not in ("prefix", "h", "depth", "open", "shard")]
    done = done.select(*names, "shard", "oversize")
    if word == last:
        return done.union(rest.withColumn("oversize", F.lit(True)).select(*names, "shard", "oversize"))
    if rest.isEmpty():
        return done
    return done.union(_split(rest.select(*names, F.col("shard").alias("prefix")), limit, word + 1, last).select(*names, "shard", "oversize"))


def extendible_shards(docs: DataFrame, key_col: str, n_bytes: Column, *, limit: int = 16 << 20) -> DataFrame:
    """Returns (key_col, n_bytes, shard, oversize), one row per input row.

    ``shard`` is the bucket's bit prefix (empty: a single shard).  A null size counts 0 and a
    null key hashes as an empty text.  Rows of one key stay together; a shard is ``oversize``
    only if its rows cannot be told apart by 4 * 28 hash bits, as with one row over the limit.
    """
    rows = docs.select(F.col(key_col).alias("own"), F.coalesce(F.col(key_col).cast("string"), F.lit("")).alias("key"), F.coalesce(n_bytes.cast("long"), F.lit(0)).alias("n_bytes"), F.lit("").alias("prefix"))
    out = _split(rows, limit, 0, 3)
    return out.select(F.col("own").alias(key_col), "n_bytes", "shard", "oversize")
