"""Weighted undirected graphs as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.components import connected_components


def canonical_edges(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = "weight") -> DataFrame:
    """(src, dst, weight) with src < dst, one row per pair (largest weight), no loops, no null ends or weights.

    weight None gives every edge weight 1; a null weight beside given ends drops the row.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = edges.select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"), w.alias("weight"), F.col(src).alias("_s"), F.col(dst).alias("_d"))
    return rows.where("_s is not null and _d is not null and src <> dst and weight is not null").groupBy("src", "dst").agg(F.max("weight").alias("weight"))


#: Rows of a table that a task gets, about, where partitions grow with the table.
TASK_ROWS = 250_000


def task_parts(rows: DataFrame) -> int:
    """Partitions for rows of which a task gets TASK_ROWS at most, about; never fewer than Spark's own."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))


def shared_pairs(rows: DataFrame, key: str, node: str) -> DataFrame:
    """(src, dst, weight), src < dst: pairs of nodes by the number of keys that they share; partitions grow with the rows, so that what a task holds does not."""
    parts = task_parts(rows)
    held = rows.select(F.col(key).alias("key"), F.col(node).alias("src")).repartition(parts, "key").distinct()
    pairs = held.join(held.withColumnRenamed("src", "dst"), "key").where("src < dst").select("src", "dst")
    return pairs.repartition(parts, "src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


@dataclass
class Graph:
    """edges(src, dst, weight) as canonical_edges gives them, nodes(node, ...) with every end and any isolated nodes."""

    nodes: DataFrame
    edges: DataFrame
    meta: dict = field(default_factory=dict)

    @classmethod
    def from_edges(cls, edges: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = "weight", nodes: DataFrame | None = None) -> Graph:
        edges = canonical_edges(edges, src, dst, weight)
        ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
        if nodes is not None:
            ends = nodes.join(ends, "node", "full").select(*nodes.columns)
        return cls(ends, edges)

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @cached_property
    def adj(self) -> DataFrame:
        """(node, nbr, weight), each edge in both directions."""
        e = self.edges
        return e.select(F.col("src").alias("node"), F.col("dst").alias("nbr"), "weight").unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("nbr"), "weight"))

    @cached_property
    def degrees(self) -> DataFrame:
        """(node, degree, strength) of all nodes, isolated ones with 0."""
        per = self.adj.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))
        return self.nodes.select("node").join(per, "node", "left").select("node", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"))

    def subgraph(self, keep: DataFrame) -> Graph:
        """The graph induced on keep(node)."""
        kept = self.nodes.join(keep.select("node"), "node", "left_semi")  # nodes outside the graph go before the edges are met
        src, dst = (kept.select(F.col("node").alias(e)) for e in ("src", "dst"))
        e = self.edges.join(src, "src", "left_semi").join(dst, "dst", "left_semi")
        return Graph(kept, e.select("src", "dst", "weight"))

    def ego(self, centre: DataFrame) -> Graph:
        """The graph induced on centre(node) and its neighbours."""
        around = self.adj.join(centre.select("node").distinct(), "node", "left_semi").select(F.col("nbr").alias("node"))
        return self.subgraph(centre.select("node").union(around))

    def components(self) -> DataFrame:
        """(node, component): component is its smallest node; isolated nodes are their own."""
        found = connected_components(self.edges)
        return self.nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))

    def component_sizes(self) -> DataFrame:
        return self.components().groupBy("component").agg(F.count(F.lit(1)).alias("size"))

    def giant(self) -> Graph:
        """The largest component; of equal ones that with the smallest node."""
        comps = self.components()
        largest = comps.groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "component").limit(1)
        return self.subgraph(comps.join(F.broadcast(largest), "component", "left_semi"))

    def scope(self, giant: str = "auto") -> Graph:
        """auto: the giant component iff the graph is disconnected; true; false."""
        if giant == "false" or self.nodes.isEmpty():
            return self
        if giant == "auto" and self.component_sizes().limit(2).count() < 2:
            return self
        return self.giant()
