"""Canonical JSON, Merkle roots and hash chains."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import Steps


def canonical(fields: list[tuple[str, str]]) -> Column:
    """JSON with sorted keys and no spaces."""
    return F.to_json(F.struct(*[F.col(c).alias(k) for k, c in sorted(fields)]))


#: Leaves (a power of two) that one task joins at once.
BLOCK = 1 << 12


def _leaf_level(leaves: DataFrame, order: str, content: str) -> tuple[Steps, DataFrame, int]:
    """Hashes (i, h) of the leaves in order, and their number."""
    from .ordered import positions

    steps = Steps(leaves)
    level = positions(leaves.select(order, content), [], [order], "i").select("i", F.unhex(F.sha2(F.col(content), 256)).alias("h"))
    level = steps.put(level)
    return steps, level, level.count()


def _pairs(level: DataFrame) -> DataFrame:
    pair = level.groupBy(F.expr("i div 2").alias("p")).agg(F.min_by("h", "i").alias("l"), F.max_by("h", "i").alias("r"))
    return pair.select(F.col("p").alias("i"), F.unhex(F.sha2(F.concat("l", "r"), 256)).alias("h"))


def merkle_root(leaves: DataFrame, order: str, content: str, empty: str = "empty_scan") -> DataFrame:
    """One row (root): pairs of hashes are joined level by level, an odd last one with itself.

    ``empty`` is the text whose hash is the root of no leaves; logs that must agree pass the same text.
    Blocks of ``BLOCK`` leaves are joined to one hash each in one task, so a few rounds do for any number.
    """
    steps, level, n = _leaf_level(leaves, order, content)
    if not n:
        return leaves.sparkSession.range(1).select(F.sha2(F.lit(empty), 256).alias("root"))

    def joined(whole: bool):
        def run(table: pa.Table) -> pa.Table:
            rows = sorted(zip(table.column("i").to_pylist(), table.column("h").to_pylist(), strict=True))
            block, h, height = rows[0][0] // BLOCK, [x for _, x in rows], 0
            # the last block goes as high as the others, an odd hash with itself
            while len(h) > 1 or not whole and height < BLOCK.bit_length() - 1:
                h = [hashlib.sha256(h[k] + h[min(k + 1, len(h) - 1)]).digest() for k in range(0, len(h), 2)]
                height += 1
            return pa.table({"i": pa.array([block], pa.int64()), "h": pa.array(h, pa.binary())})

        return run

    while n > 1:
        level = steps.put(level.groupBy(F.expr(f"i div {BLOCK}").alias("b")).applyInArrow(joined(n <= BLOCK), "i long, h binary"))
        n = -(-n // BLOCK)
    return level.select(F.lower(F.hex("h")).alias("root"))


def chain_head(rows: DataFrame, group: list[str], order: str, content: str) -> DataFrame:
    """The last link of each group's chain; a chain is sequential by nature, groups run side by side."""
    links = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(content).alias("c")))).alias("links"))
    head = F.aggregate("links", F.lit("GENESIS"), lambda h, x: F.sha2(F.concat(h, x["c"]), 256))
    return links.select(*group, head.alias("head"))


def broken_links(receipts: DataFrame, group: str, order: str, first: str | None = None) -> DataFrame:
    """Receipts whose predecessor_hash is not the chain_hash before them, or is none; with ``first``, also those that
    begin a group and do not name it as their predecessor."""
    own = Window.partitionBy(group).orderBy(order)
    rows = receipts.withColumn("_b", F.lag("chain_hash").over(own)).withColumn("_n", F.row_number().over(own))
    form = F.coalesce(F.col("predecessor_hash").rlike("^[0-9a-f]{64}$"), F.lit(False))
    wrong = (F.col("_n") > 1) & (~F.col("predecessor_hash").eqNullSafe(F.col("_b")) | ~form)
    if first is not None:
        wrong = wrong | (F.col("_n") == 1) & ~F.col("predecessor_hash").eqNullSafe(F.lit(first))
    return rows.where(wrong).drop("_b", "_n")


def fingerprint(rows: DataFrame, order: str, line: str, size: int = 1000) -> DataFrame:
    """One row (root) for lines of any number: ``size`` lines in order, joined by line feeds, are one leaf of a Merkle tree.

    The lines of a leaf are hashed in one place; where all lines fit one leaf, that is the digest of the text.
    """
    from .ordered import positions

    at = positions(rows.select(order, line), [], [order], "_i").withColumn("leaf", F.expr(f"_i div {size}"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.col(line).alias("l")))), lambda x: x["l"]), "\n")
    return merkle_root(at.groupBy("leaf").agg(text.alias("c")), "leaf", "c")


def inclusion_proof(leaves: DataFrame, order: str, content: str, index: int) -> DataFrame:
    """(level, side, sibling): the hashes that lead from one leaf to the root; ``L`` stands left of what is known so far."""
    steps, level, n = _leaf_level(leaves, order, content)
    out, at, depth = None, index, 0
    if not 0 <= index < n:
        return leaves.sparkSession.createDataFrame([], "level int, side string, sibling string")
    while n > 1:
        other = at + 1 if at % 2 == 0 and at + 1 < n else at if at % 2 == 0 else at - 1
        one = level.where(F.col("i") == other).select(F.lit(depth).alias("level"), F.lit("R" if at % 2 == 0 else "L").alias("side"), F.lower(F.hex("h")).alias("sibling"))
        out = one if out is None else out.union(one)
        level = steps.put(_pairs(level))
        n, at, depth = -(-n // 2), at // 2, depth + 1
    return out if out is not None else leaves.sparkSession.createDataFrame([], "level int, side string, sibling string")


def verify_inclusion(claims: DataFrame) -> DataFrame:
    """Adds ``ok`` to rows (leaf hex, root hex, proof array of (side, sibling hex) from the leaf up)."""
    step = lambda h, p: F.when(p["side"] == "L", F.unhex(F.sha2(F.concat(F.unhex(p["sibling"]), h), 256))).when(p["side"] == "R", F.unhex(F.sha2(F.concat(h, F.unhex(p["sibling"])), 256)))
    got = F.lower(F.hex(F.aggregate("proof", F.unhex("leaf"), step)))
    return claims.withColumn("ok", F.coalesce(got == F.col("root"), F.lit(False)))


def manifest_status(manifests: DataFrame, leaves: DataFrame, files: DataFrame, roots: DataFrame) -> DataFrame:
    """(scan, reason): the first thing wrong with each manifest, else ``ok``.  Signatures are out of scope.

    ``manifests``: scan, merkle_root (null where the file is missing); ``leaves``: scan, finding_id, leaf_hash as the
    manifest lists them; ``files``: scan, finding_id, content; ``roots``: scan, root computed from the files.
    """
    seen = leaves.join(files, ["scan", "finding_id"], "left")
    bad = seen.groupBy("scan").agg(F.count_if(F.col("content").isNull()).alias("missing"), F.count_if(F.sha2(F.col("content").cast("binary"), 256) != F.col("leaf_hash")).alias("changed"))
    all_ = manifests.join(bad, "scan", "left").join(roots, "scan", "left")
    reason = F.when(F.col("merkle_root").isNull(), "missing_manifest").when(F.col("missing") > 0, "missing_finding").when((F.col("changed") > 0) | ~F.col("root").eqNullSafe(F.col("merkle_root")), "merkle_mismatch").otherwise("ok")
    return all_.select("scan", reason.alias("reason"))
