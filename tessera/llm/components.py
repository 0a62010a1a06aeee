"""Connected components of an edge table, without a driver-side graph.

Alternates the large-star and small-star steps (Kiveris et al., 2014) until the
edges are stars around the smallest member.  A step is a grouped minimum, which
is combined before the shuffle, and a join that adaptive execution may split at
a hub.  Each round is written to the shared folder, so no lineage builds up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _stars(both: DataFrame, keep) -> DataFrame:
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``edges``: columns u, v of one type.  Returns (node, component) for every node of an edge;
    component is the smallest node reachable.  Null ends and loops are ignored.  An edge may repeat.
    """
    e = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = scratch.put(e, f"{name}-0")
    before, k = None, 0
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if state == before or not state[0]:
            break
        before, k = state, k + 1
        large = _stars(e.union(e.select("v", "u")), F.col("v") > F.col("u")).distinct()
        # small star: every neighbour at or below u, and u itself, gets the smallest of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("a"), "m").union(low.select("u", "m")).where("a != m")
        e = scratch.put(small.select(F.col("a").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-{k}")
        if k > 1:
            scratch.drop(f"{name}-{k - 2}")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct()).distinct()
