"""Triangles and common neighbours, from the ends of smaller degree, so that hubs form no wedges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.graph import Graph


def oriented(graph: Graph) -> DataFrame:
    """(a, b) per edge, from the end of smaller degree, of equal ones the smaller node; a node has at most the root of twice the edges going out."""
    one, two = (graph.degrees.select(F.col("node").alias(e), F.struct("degree", F.col("node").alias("n")).alias(f"o_{e}")) for e in ("src", "dst"))
    up = F.col("o_src") < F.col("o_dst")
    ranked = graph.edges.select("src", "dst").join(one, "src").join(two, "dst")
    return ranked.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"))


def triangles(graph: Graph) -> DataFrame:
    """(a, b, c) once per triangle."""
    out = oriented(graph)
    wedges = out.join(out.withColumnRenamed("b", "c"), "a").where("b < c")
    ends = graph.edges.select(F.col("src").alias("b"), F.col("dst").alias("c"))
    return wedges.join(ends, ["b", "c"], "left_semi").select("a", "b", "c")


def ego_edges(graph: Graph) -> DataFrame:
    """(ego, src, dst), src < dst: the edges among the neighbours of each node; the edges of its ego network without itself."""
    corner = lambda e, x, y: F.struct(F.col(e).alias("ego"), F.least(x, y).alias("src"), F.greatest(x, y).alias("dst"))
    return triangles(graph).select(F.explode(F.array(corner("a", "b", "c"), corner("b", "a", "c"), corner("c", "a", "b"))).alias("t")).select("t.*")


def common_neighbours(graph: Graph) -> DataFrame:
    """(src, dst, both) of the edges whose ends have common neighbours: their triangles."""
    return ego_edges(graph).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("both"))
