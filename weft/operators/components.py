"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations by node with map-side combine, written once; a round halves
distances at least, so the number of rounds is logarithmic in practice. Hubs
are aggregated, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.plans.lineage import cut


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Hook the larger (large) or the smaller neighbours of every node to the smallest node around it."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    if large:
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node that has an edge to another: component is the smallest node reachable."""
    pairs = cut(edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        pairs = cut(_star(_star(pairs, True), False))
        state = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if state == seen or not state[0]:
            break
        seen = state
    roots = pairs.select(F.col("b").alias("a")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select(F.col("a").alias("node"), F.col("a").alias("component")))
