"""The union of all maximum spanning forests of a graph, by Boruvka rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.components import connected_components
from weft.plans.lineage import cut


def boruvka(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The forest's rounds: (src, dst, weight, low) of all edges(src, dst, weight), and of each round (node, fragment) of its ends.

    In a round every fragment picks its largest edge by (weight, src, dst), which no
    two edges share, and fragments that picks join are one. low is the smallest
    weight on the forest's path between an edge's ends: that of the picks
    of all fragments that held one of them but not the other. An edge lies in some maximum
    spanning forest if and only if its weight is not below low. Each round halves the
    fragments at least.
    """
    none = F.lit(float("inf"))
    left = cut(edges.select("src", "dst", "weight", F.col("src").alias("a"), F.col("dst").alias("b"), none.alias("low")))
    settled, rounds = None, []
    nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
    held = cut(nodes.select("node", F.col("node").alias("fragment")))
    while not left.isEmpty():
        pick = F.struct("weight", "src", "dst", "a", "b")
        ends = left.select(F.col("a").alias("f"), pick.alias("p")).unionByName(left.select(F.col("b").alias("f"), pick.alias("p")))
        picks = cut(ends.groupBy("f").agg(F.max("p").alias("p")))
        joined = cut(connected_components(picks.select(F.col("p.a").alias("src"), F.col("p.b").alias("dst"))))
        per = cut(picks.select("f", F.col("p.weight").alias("pick")).join(joined.select(F.col("node").alias("f"), F.col("component").alias("new")), "f"))
        one, two = (per.select(F.col("f").alias(x), F.col("pick").alias(f"pick_{x}"), F.col("new").alias(f"new_{x}")) for x in ("a", "b"))
        moved = cut(left.join(one, "a").join(two, "b").select("src", "dst", "weight", F.col("new_a").alias("a"), F.col("new_b").alias("b"), F.least("low", "pick_a", "pick_b").alias("low")))
        new = moved.where("a = b").select("src", "dst", "weight", "low")
        settled = new if settled is None else settled.unionByName(new)
        left = moved.where("a <> b")
        held = cut(held.join(joined.select(F.col("node").alias("fragment"), F.col("component").alias("into")), "fragment", "left").select("node", F.coalesce("into", "fragment").alias("fragment")))
        rounds.append(held)
    return (settled if settled is not None else left.select("src", "dst", "weight", "low")), rounds


def spanning_union(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): the edges of all maximum spanning forests together."""
    return boruvka(edges)[0].where("weight >= low").select("src", "dst", "weight")
