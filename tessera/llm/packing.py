"""Variable-capacity best-fit packing of texts into training sequences.

Items are packed longest first.  An item goes to the open bin it leaves least room in
(of equal ones, the bin that came to that room last).  If none holds it, a bin is opened: for
every permitted length that holds the item, the room beside it is filled, for trial, with the longest items
that are still to come, and the length of least cost for each token so placed is taken.  The
cost of a sequence of length ``c`` is ``overhead + c + c * c / attention``, so that a long bin
pays where it can be filled and a short one where not.  At the end each bin is cut down to the smallest permitted
length that holds its contents.

Items are dealt at random over groups of bounded size, which are packed separately, so
no task holds more than one group; the loss is at most one partly filled bin of a kind
for each group.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: What a sequence costs besides its tokens, and the length at which attention costs as much as they do.
OVERHEAD, ATTENTION = 64, 16384


def cost(length: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    return overhead + length + length * length / attention


def trial_fill(room: int, left: dict[int, int], present: int) -> int:
    """How much of a room the longest items still to come would fill; ``left`` counts items by length, ``present`` has a bit for each length."""
    fill, below = 0, room
    while room > 0 and (some := present & ((2 << min(below, room)) - 1)):
        n = some.bit_length() - 1
        take = min(left[n], room // n)
        fill, room, below = fill + take * n, room - take * n, n - 1
    return fill


def best_fit(lengths: list[int], permitted: tuple[int, ...], overhead: int = OVERHEAD, attention: int = ATTENTION) -> tuple[list[int], list[int], list[int]]:
    """For positive lengths in descending order: bin number and offset of each item; then the final length of each bin."""
    permitted = tuple(sorted(permitted))
    price = {c: cost(c, overhead, attention) for c in permitted}
    left: dict[int, int] = {}
    for n in lengths:
        left[n] = left.get(n, 0) + 1
    present = sum(1 << n for n in left)
    rooms: dict[int, list[int]] = {}
    mask, used, bins, offsets = 0, [], [], []
    for n in lengths:
        left[n] -= 1
        if not left[n]:
            present &= ~(1 << n)
        rest = mask >> n
        if rest:
            room = n + (rest & -rest).bit_length() - 1
            stack = rooms[room]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << room)
        else:
            room = min((c for c in permitted if c >= n), key=lambda c: (price[c] / (n + trial_fill(c - n, left, present)), c))
            b = len(used)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if room > n:
            rooms.setdefault(room - n, []).append(b)
            mask |= 1 << (room - n)
    return bins, offsets, [next(c for c in permitted if c >= u) for u in used]


def pack(docs: DataFrame, id_col: str, length: Column, *, permitted: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, attention: int = ATTENTION, group_items: int = 20_000) -> DataFrame:
    """Returns (id_col, piece, start, length, bin_id, bin_length, bin_offset), a row for each piece.

    A text longer than the largest permitted length is cut into pieces of that length and a
    rest.  A text of length 0 or null takes no room: one row with a null bin.  Repeated rows
    are packed each for itself; equal lengths are ordered by id and piece.  A null id is packed like any
    other; an empty table gives an empty result; other columns are not read.
    """
    top = max(permitted)
    items = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(length.cast("long"), F.lit(0)).alias("total"))
    items = items.withColumn("piece", F.explode(F.expr(f"sequence(0L, greatest((total - 1) div {top}, 0L))")))
    items = items.select("id", "piece", (F.col("piece") * top).alias("start"), F.least(F.col("total") - F.col("piece") * top, F.lit(top)).alias("length"))
    empty = items.where("length <= 0").select("id", "piece", "start", F.lit(0).cast("long").alias("length"), F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("bin_length"), F.lit(None).cast("int").alias("bin_offset"))
    items = items.where("length > 0")
    groups = max(1, -(-items.count() // group_items))
    items = items.withColumn("g", F.pmod(F.xxhash64("id", "piece"), F.lit(groups)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending")])
        bins, offsets, final = best_fit(table.column("length").to_pylist(), permitted, overhead, attention)
        base = table.column("g")[0].as_py() << 32
        more = [pa.array([base + b for b in bins], pa.int64()), pa.array([final[b] for b in bins], pa.int32()), pa.array(offsets, pa.int32())]
        return pa.Table.from_arrays([*(table.column(c) for c in ("id", "piece", "start", "length")), *more], ["id", "piece", "start", "length", "bin_id", "bin_length", "bin_offset"])

    packed = items.groupBy("g").applyInArrow(run, "id long, piece long, start long, length long, bin_id long, bin_length int, bin_offset int")
    return packed.union(empty).withColumnRenamed("id", id_col)
