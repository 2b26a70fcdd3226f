"""Shortest paths of unweighted graphs as relations: distances, path counts, Brandes dependencies.

Everything is keyed by (scope, source, node), so that all sources, or the
induced subgraphs of all communities, run in one plan. The state of a run is
one row per reachable pair; sources can be given in batches to bound it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.graph import Graph
from weft.plans.lineage import cut

KEYS = ["scope", "source", "node"]


def scoped(graph: Graph, membership: DataFrame | None = None) -> DataFrame:
    """(scope, node, nbr): the graph as one scope, or each community's induced subgraph."""
    if membership is None:
        return graph.adj.select(F.lit(0).alias("scope"), "node", "nbr")
    m = membership.select(F.col("cid").alias("scope"), "node").distinct()
    return m.join(graph.adj.select("node", "nbr"), "node").join(m.withColumnRenamed("node", "nbr"), ["scope", "nbr"]).select("scope", "node", "nbr")


def shortest_paths(adj: DataFrame, sources: DataFrame) -> DataFrame:
    """(scope, source, node, d, sigma): distance and number of shortest paths from sources(scope, source), themselves included.

    One round per level: the frontier meets the adjacency, what has been
    visited is anti-joined, and the sums of path counts are partial before the
    shuffle.
    """
    adj = cut(adj)
    front = cut(sources.select("scope", "source", F.col("source").alias("node"), F.lit(0).alias("d"), F.lit(1.0).alias("sigma")))
    levels, last, level = [front], None, 0
    while True:
        level += 1
        step = front.join(adj, ["scope", "node"]).groupBy("scope", "source", F.col("nbr").alias("node")).agg(F.sum("sigma").alias("sigma"))
        recent = front.select(*KEYS) if last is None else front.select(*KEYS).unionByName(last.select(*KEYS))
        # a neighbour of level L is on level L - 1, L or L + 1, so two levels are all that can have been visited
        found = cut(step.join(recent, KEYS, "left_anti").select(*KEYS, F.lit(level).alias("d"), "sigma"))
        if found.isEmpty():
            break
        levels.append(found)
        last, front = front, found
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def distances(graph: Graph, sources: DataFrame | None = None) -> DataFrame:
    """(source, node, d) of all reachable pairs, from all nodes or from sources(node)."""
    start = (graph.nodes if sources is None else sources).select(F.lit(0).alias("scope"), F.col("node").alias("source"))
    return shortest_paths(scoped(graph), start).select("source", "node", "d")


def dependencies(adj: DataFrame, paths: DataFrame, targets: DataFrame | None = None, load: bool = False) -> DataFrame:
    """(scope, source, node, delta): Brandes dependencies of the sources on the nodes, sources left out.

    targets(scope, node) restricts the ends that count. load shares a node's
    flow equally among its predecessors instead of by their path counts. adj
    (scope, node, nbr), or (node, nbr) where all scopes have the same paths.
    """
    meet = [c for c in ("scope", "node") if c in adj.columns]
    paths = cut(paths)
    adj = cut(adj)
    ends = paths.withColumn("end", F.lit(1.0))
    if targets is not None:
        ends = paths.join(targets.select("scope", "node").distinct().withColumn("end", F.lit(1.0)), ["scope", "node"], "left").na.fill(0.0, ["end"])
    ends = cut(ends)
    deepest = paths.agg(F.max("d")).first()[0] or 0
    parts, below = [], None
    for d in range(deepest, 0, -1):
        here = ends.where(F.col("d") == d)
        if below is not None:
            here = here.join(below, KEYS, "left").na.fill(0.0, ["delta"])
        else:
            here = here.withColumn("delta", F.lit(0.0))
        if d < deepest:
            parts.append(here.select(*KEYS, "delta"))
        else:
            parts.append(here.select(*KEYS, F.lit(0.0).alias("delta")))
        up = here.join(adj, meet).select("scope", "source", F.col("nbr").alias("above"), "node", "sigma", "end", "delta")
        above = ends.where(F.col("d") == d - 1).select("scope", "source", F.col("node").alias("above"), F.col("sigma").alias("sigma_above"))
        up = up.join(above, ["scope", "source", "above"])
        if load:
            fans = up.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("fan"))
            up = up.join(fans, KEYS).withColumn("share", 1 / F.col("fan"))
        else:
            up = up.withColumn("share", F.col("sigma_above") / F.col("sigma"))
        below = cut(up.groupBy("scope", "source", F.col("above").alias("node")).agg(F.sum(F.col("share") * (F.col("end") + F.col("delta"))).alias("delta")))
    if not parts:
        return paths.select(*KEYS, F.lit(0.0).alias("delta")).limit(0)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.where("source <> node")
