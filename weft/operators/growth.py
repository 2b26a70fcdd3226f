"""Communities grown from many seeds at once: rows are keyed by (seed, node), and every round changes one node of each community that still changes.

A detector that takes its seeds one after the other, and skips those that
an earlier community covers, gives the same result when all seeds grow at once and first_come
settles which stay, as long as growth does not depend on other communities.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.graph import Graph
from weft.operators import blocks
from weft.operators.egonets import first_come
from weft.plans.lineage import cut


def surroundings(graph: Graph, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What lies inside and next to communities members(seed, node).

    (seed, node, degree, links, weight, inside): of members and their neighbours the edges into the
    community, their number and weight; and (seed, size, inner, every): members, twice the edges inside, and the sum of degrees.
    """
    rows = members.join(graph.adj, "node").groupBy("seed", F.col("nbr").alias("node")).agg(F.count(F.lit(1)).alias("links"), F.sum("weight").alias("weight"))
    rows = rows.join(members.withColumn("inside", F.lit(True)), ["seed", "node"], "full").na.fill(0, ["links", "weight"]).na.fill(False, ["inside"])
    rows = cut(rows.join(graph.degrees, "node").select("seed", "node", "degree", "strength", "links", "weight", "inside"))
    own = rows.where("inside").groupBy("seed").agg(F.count(F.lit(1)).alias("size"), F.sum("links").alias("inner"), F.sum("degree").alias("every"))
    return rows, own


def grow(graph: Graph, seeds: DataFrame, change: Callable[[DataFrame], DataFrame], rounds: int) -> DataFrame:
    """(seed, node): communities from seeds(node), each by itself at first; as grow_from."""
    return grow_from(graph, seeds.select(F.col("node").alias("seed"), "node"), change, rounds)


def grow_from(graph: Graph, members: DataFrame, change: Callable[[DataFrame], DataFrame], rounds: int) -> DataFrame:
    """(seed, node): communities that start as members(seed, node).

    change gets the rows of surroundings with size, inner and every of their community and returns (seed, node) of the one
    node a community that enters it, or leaves it if it is inside; communities without such a row are done.
    """
    members, done = cut(members.select("seed", "node")), None
    for _ in range(rounds):
        rows, own = surroundings(graph, members)
        turned = cut(change(rows.join(own, "seed")).select("seed", "node"))
        open_ = turned.select("seed")
        rest = members.join(open_, "seed", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        if turned.isEmpty():
            return done
        left = members.join(open_, "seed", "left_semi")
        members = cut(left.join(turned, ["seed", "node"], "left_anti").unionByName(turned.join(left, ["seed", "node"], "left_anti")))
    return done.unionByName(members)


def uncovered_first(grown: DataFrame, order: DataFrame) -> DataFrame:
    """grown without the communities whose seed lies in one that stays and comes before: order has (node, at), at distinct."""
    items = order.select(F.col("node").alias("id"), "at")
    held = grown.where("seed <> node").select(F.col("node").alias("c"), F.col("seed").alias("d"))
    at = lambda e: items.select(F.col("id").alias(e), F.col("at").alias(f"at_{e}"))
    blocks = held.join(at("c"), "c").join(at("d"), "d").where("at_d < at_c").select("c", "d")
    return grown.join(first_come(items, blocks, "at").withColumnRenamed("id", "seed"), "seed", "left_semi")


def disjoint_first(grown: DataFrame, order: DataFrame) -> DataFrame:
    """grown without the communities that share a node with one that stays and comes before: order has (node, at), at distinct.

    In a round all those stay that come first at each of their nodes, and whatever shares a node with them goes; no pairs are made.
    """
    left, stay = cut(grown.select("seed", "node").join(order.select(F.col("node").alias("seed"), "at"), "seed")), None
    while not left.isEmpty():
        first = left.groupBy("node").agg(F.min("at").alias("first"))
        ready = left.join(first, "node").groupBy("seed").agg(F.min(F.col("at") == F.col("first")).alias("all_first")).where("all_first").select("seed")
        taken = cut(left.join(ready, "seed", "left_semi").select("seed", "node"))
        stay = taken if stay is None else stay.unionByName(taken)
        settled = left.join(taken.select("node"), "node", "left_semi").select("seed").distinct()
        left = cut(left.join(settled, "seed", "left_anti"))
    return grown.limit(0) if stay is None else stay


def _fitness(inner: Column, every: Column, alpha: float) -> Column:
    return F.when(every > 0, F.round(inner / F.pow(every.cast("double"), F.lit(float(alpha))), 12)).otherwise(0.0)


def by_fitness(alpha: float) -> Callable[[DataFrame], DataFrame]:
    """Changes that raise inner / every ** alpha the most: of a member that leaves, but the seed, if any raises it, else of a neighbour that enters; ties by node."""

    def change(rows: DataFrame) -> DataFrame:
        inner, every, links, degree = (F.col(c) for c in ("inner", "every", "links", "degree"))
        now = _fitness(inner, every, alpha)
        after = F.when(F.col("inside"), _fitness(inner - 2 * links, every - degree, alpha)).otherwise(_fitness(inner + 2 * links, every + degree, alpha))
        able = rows.where((~F.col("inside") | (F.col("node") != F.col("seed"))) & (after > now + 1e-11))
        return able.withColumn("order", F.struct((~F.col("inside")).alias("a"), (-after).alias("b"), F.col("node").alias("c"))).groupBy("seed").agg(F.min_by("node", "order").alias("node"))

    return change


def by_belonging(least: float) -> Callable[[DataFrame], DataFrame]:
    """The neighbour with the largest share of its strength in the community enters, if that is `least` or more; ties by node."""

    def change(rows: DataFrame) -> DataFrame:
        share = F.round(F.col("weight") / F.col("strength"), 12)
        able = rows.where(~F.col("inside") & (share >= least))
        return able.groupBy("seed").agg(F.min_by("node", F.struct((-share).alias("a"), F.col("node").alias("b"))).alias("node"))

    return change


def by_density(least: float, share: float) -> Callable[[DataFrame], DataFrame]:
    """The neighbour with most edges into the community enters, if the community stays `least` dense with it and it has `share` of a member's mean number of edges; ties by node."""

    def change(rows: DataFrame) -> DataFrame:
        size, inner, links = (F.col(c) for c in ("size", "inner", "links"))
        dense = (inner + 2 * links) / (size * (size + 1)) >= least
        able = rows.where(~F.col("inside") & dense & ((inner == 0) | (links * (size - 1) >= share * inner)))
        return able.groupBy("seed").agg(F.min_by("node", F.struct((-links).alias("a"), F.col("node").alias("b"))).alias("node"))

    return change


def by_interaction(graph: Graph, weights: DataFrame, least: float) -> Callable[[DataFrame], DataFrame]:
    """The neighbour with most edges into the community enters, of equal ones that of larger weights(node, w), then by node,
    if it has an edge to `least` of the members and each of them is two steps away at most inside the community."""

    def change(rows: DataFrame) -> DataFrame:
        able = rows.where(~F.col("inside") & (F.col("links") / F.col("size") >= least)).select("seed", "node", "links", "size")
        members = rows.where("inside").select("seed", F.col("node").alias("member"))
        step = graph.adj.select("node", F.col("nbr").alias("member"))
        one = able.where("links < size").select("seed", "node").join(step, "node").join(members, ["seed", "member"])
        two = one.select("seed", "node", F.col("member").alias("via")).join(step.withColumnRenamed("node", "via"), "via").join(members, ["seed", "member"])
        reached = one.select("seed", "node", "member").unionByName(two.select("seed", "node", "member")).distinct().groupBy("seed", "node").agg(F.count(F.lit(1)).alias("reached"))
        near = able.join(reached, ["seed", "node"], "left").where((F.col("links") == F.col("size")) | (F.col("reached") == F.col("size"))).join(weights, "node")
        order = F.struct((-F.col("links")).alias("a"), (-F.col("w")).alias("b"), F.col("node").alias("c"))
        return near.groupBy("seed").agg(F.min_by("node", order).alias("node"))

    return change


def _entropy(part: Column, whole: Column) -> Column:
    """Entropy of the share part / whole of a node's edges in whole billionths of a bit, so that sums do not depend on their order."""
    p = part / whole
    bits = -p * F.log2(p) - (1 - p) * F.log2(1 - p)
    return F.when((p <= 0) | (p >= 1), 0).otherwise(F.round(bits * 1e9)).cast("long")


def entropy_changes(graph: Graph, rows: DataFrame, weighted: bool = False, laid: blocks.Layout | None = None) -> DataFrame:
    """rows of surroundings with `change`: of the sum over all nodes of the entropy of their edges' shares in the community,
    in billionths of a bit, if the node enters, or leaves if it is inside. Only its neighbours' shares change.

    Without weights a neighbour's part does not depend on the edge, so the sums go by blocks of communities, on laid if it is given, and no edge of a row becomes a row.
    """
    part, whole, w = (F.col("weight"), F.col("strength"), F.col("w")) if weighted else (F.col("links"), F.col("degree"), F.lit(1))
    step = graph.adj.select("node", F.col("nbr").alias("to"), F.col("weight").alias("w"))
    now, alone = _entropy(part, whole), _entropy(w, whole)
    enters, leaves = _entropy(part + w, whole) - now - alone, _entropy(part - w, whole) - now
    first = step.join(graph.degrees, "node").groupBy(F.col("to").alias("node")).agg(F.sum(alone).alias("first"))  # what a node adds where none of its neighbours has an edge inside
    if weighted:
        near = rows.where("links > 0").select("seed", "node", "degree", "strength", "links", "weight").join(step, "node")
        sums = near.groupBy("seed", F.col("to").alias("node")).agg(F.sum(enters).alias("enters"), F.sum(leaves).alias("leaves"))
        found = rows.join(sums, ["seed", "node"], "left")
    else:
        parts = {name: F.when(F.col("links") > 0, of).otherwise(F.lit(0)).cast("long") for name, of in (("of_enters", enters), ("of_leaves", leaves))}
        found = blocks.neighbour_sums(laid or laid_out(graph), rows.withColumns(parts), {"enters": "of_enters", "leaves": "of_leaves"}).drop(*parts)
    found = found.join(first, "node", "left").na.fill(0, ["first", "enters", "leaves"])
    return found.withColumn("change", F.when(F.col("inside"), F.col("leaves")).otherwise(F.col("first") + F.col("enters"))).select(*rows.columns, "change")


def laid_out(graph: Graph) -> blocks.Layout:
    return blocks.layout(graph.adj.select("node", "nbr"), graph.nodes)


def by_entropy(graph: Graph, weighted: bool = False, leaving: bool = False, steepest: bool = True) -> Callable[[DataFrame], DataFrame]:
    """A neighbour that lowers the entropy enters, or, leaving, a member but the seed that lowers it leaves: the one that lowers it most,
    or, not steepest, the one with the largest share of its edges inside; ties by node."""

    laid = None if weighted else laid_out(graph)

    def change(rows: DataFrame) -> DataFrame:
        able = entropy_changes(graph, rows, weighted, laid).where((F.col("inside") == F.lit(leaving)) & (F.col("node") != F.col("seed")) & (F.col("change") < 0))
        key = F.col("change").cast("double") if steepest else -(F.col("links") / F.col("degree"))
        return able.groupBy("seed").agg(F.min_by("node", F.struct(key.alias("a"), F.col("node").alias("b"))).alias("node"))

    return change
