"""Modularity by parallel local moving and contraction.

A level's graph has adj(node, nbr, weight) and nodes(node, strength); what lies
inside a node counts in its strength and moves with it. In a step every node has its best move
by the state before the step; of the communities one side of a hash gives nodes and
the other takes them, so that no two neighbouring communities change places. Where
many join the same community at once the step can lose modularity; then a
part of its moves is made, by a hash of the nodes, and in the end the best move alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.graph import Graph
from weft.plans.lineage import cut

#: Shares of the moves of a step that are tried, as long as modularity falls, before the best move alone.
SHARES = (1, 4)
LEAST_GAIN = 1e-9


def gains(adj: DataFrame, state: DataFrame, m2: float, resolution: float = 1.0) -> DataFrame:
    """(node, cid, to, gain) of every community next to a node: the change of modularity if the node moves there from its own.

    adj has (node, nbr, weight), state (node, cid, strength).
    """
    totals = state.groupBy("cid").agg(F.sum("strength").alias("total"))
    links = adj.join(state.select(F.col("node").alias("nbr"), F.col("cid").alias("to")), "nbr").groupBy("node", "to").agg(F.sum("weight").alias("w"))
    rows = links.join(state, "node").join(totals.select(F.col("cid").alias("to"), F.col("total").alias("there")), "to").join(totals.select("cid", F.col("total").alias("here")), "cid")
    own = rows.groupBy("node").agg(F.sum(F.when(F.col("to") == F.col("cid"), F.col("w")).otherwise(0.0)).alias("own"))
    k = F.col("strength")
    gain = 2 * (F.col("w") - F.col("own")) / m2 - 2 * resolution * k * (F.col("there") - (F.col("here") - k)) / (m2 * m2)
    return rows.join(own, "node").where("to <> cid").select("node", "cid", "to", gain.alias("gain"))


def _value(adj: DataFrame, state: DataFrame, m2: float, inner: float, resolution: float) -> float:
    """Modularity of the communities of a level; inner is the weight, both ways, that lies within its nodes."""
    one, two = state.select("node", F.col("cid").alias("a")), state.select(F.col("node").alias("nbr"), F.col("cid").alias("b"))
    inside = adj.join(one, "node").join(two, "nbr").where("a = b").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("inside"))
    squares = state.groupBy("cid").agg(F.sum("strength").alias("k")).agg(F.coalesce(F.sum(F.col("k") * F.col("k")), F.lit(0.0)).alias("squares"))
    row = inside.crossJoin(squares).first()  # two single rows
    return (row.inside + inner) / m2 - resolution * row.squares / (m2 * m2)


def _after(state: DataFrame, moves: DataFrame) -> DataFrame:
    return cut(state.join(moves.select("node", "to"), "node", "left").select("node", F.coalesce("to", "cid").alias("cid"), "strength"))


def move_level(adj: DataFrame, nodes: DataFrame, m2: float, inner: float, resolution: float, seed: int, steps: int) -> tuple[DataFrame, list[float]]:
    """(node, cid, strength) and the modularity after each step, from every node by itself; ends where no move gains, or after so many steps."""
    state = cut(nodes.select("node", F.col("node").alias("cid"), "strength"))
    values = [_value(adj, state, m2, inner, resolution)]
    for turn in range(steps):
        able = gains(adj, state, m2, resolution).where(F.col("gain") > LEAST_GAIN)
        best = cut(able.groupBy("node").agg(F.min(F.struct(-F.col("gain"), "to", "cid")).alias("m")).select("node", "m.to", "m.cid", (-F.col("m.col1")).alias("gain")))
        first = best.orderBy(F.desc("gain"), "node").first()
        if first is None:
            break
        takes = lambda c, turn=turn: F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), F.col(c)), F.lit(2)) == 0
        for share in SHARES:
            chosen = best.where(takes("to") & ~takes("cid") & (F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), F.lit(share), "node"), F.lit(share)) == 0))
            moved = _after(state, chosen)
            value = _value(adj, moved, m2, inner, resolution)
            if value > values[-1] + LEAST_GAIN:
                break
        else:
            moved, value = _after(state, best.where(F.col("node") == F.lit(first.node))), values[-1] + first.gain
        state = moved
        values.append(value)
    return state, values


def louvain(graph: Graph, seed: int = 42, resolution: float = 1.0, steps: int = 100) -> DataFrame:
    """(node, cid) of a partition by local moving and contraction until modularity no longer grows, at most `steps` steps a level; cid is a node of the community."""
    return louvain_levels(graph, seed, resolution, steps)[0]


def louvain_levels(graph: Graph, seed: int = 42, resolution: float = 1.0, steps: int = 100) -> tuple[DataFrame, list[list[float]]]:
    """louvain, and the modularity after every step of each level."""
    part = graph.nodes.select("node", F.col("node").alias("cid"))
    m2 = graph.degrees.agg(F.sum("strength")).first()[0] or 0.0
    if not m2:
        return part, []
    adj, nodes, inner, history = cut(graph.adj), cut(graph.degrees.select("node", "strength")), 0.0, []
    while True:
        state, values = move_level(adj, nodes, m2, inner, resolution, seed + len(history), steps)
        history.append(values)
        if len(values) < 2:
            return part, history
        part = cut(part.join(state.select(F.col("node").alias("cid"), F.col("cid").alias("into")), "cid").select("node", F.col("into").alias("cid")))
        one, two = state.select("node", F.col("cid").alias("a")), state.select(F.col("node").alias("nbr"), F.col("cid").alias("b"))
        between = cut(adj.join(one, "node").join(two, "nbr").groupBy("a", "b").agg(F.sum("weight").alias("weight")))
        inner += between.where("a = b").agg(F.sum("weight")).first()[0] or 0.0
        adj = cut(between.where("a <> b").select(F.col("a").alias("node"), F.col("b").alias("nbr"), "weight"))
        nodes = cut(state.groupBy(F.col("cid").alias("node")).agg(F.sum("strength").alias("strength")))
