"""Personalised PageRank of many seeds at once by residual push, and conductance sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.graph import Graph
from weft.plans.lineage import cut

#: Ranges that a sweep's order is cut into; prefix sums go over their totals first.
RANGES = 64
#: Rounds of pushes between two tables: the plan of a round reads the one before twice.
TOGETHER = 3


def push(graph: Graph, seeds: DataFrame, alpha: float = 0.85, epsilon: float = 1e-4, rounds: int = 1000) -> DataFrame:
    """(seed, node, p, r): scores p and residuals r of walks that go on with probability alpha, from seeds(seed, node), equal shares of each seed's nodes.

    In a round every node whose residual is epsilon or more of its degree keeps
    1 - alpha of it and passes alpha of it to its neighbours by weight, in the networks of all seeds at once.
    Then r < epsilon * degree everywhere, p is at most the true score x, and x - p sums to
    the residuals' sum: no score is off by more. Nodes without edges keep what they have.
    """
    spread = cut(graph.adj.join(graph.degrees.select("node", "strength"), "node").select("node", "nbr", (F.col("weight") / F.col("strength")).alias("share")))
    degrees = cut(graph.degrees.select("node", "degree"))
    sizes = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    start = seeds.distinct().join(degrees, "node").join(sizes, "seed")
    state = start.select("seed", "node", "degree", F.when(F.col("degree") == 0, 1 / F.col("n")).otherwise(0.0).alias("p"), F.when(F.col("degree") == 0, 0.0).otherwise(1 / F.col("n")).alias("r"))
    big = (F.col("r") >= epsilon * F.col("degree")) & (F.col("degree") > 0)
    for number in range(rounds):
        if number % TOGETHER == 0:
            state = cut(state)
            if state.where(big).isEmpty():
                break
        sent = state.where(big).join(spread, "node").groupBy("seed", F.col("nbr").alias("node")).agg(F.sum(alpha * F.col("r") * F.col("share")).alias("got"))
        kept = state.select("seed", "node", (F.col("p") + F.when(big, (1 - alpha) * F.col("r")).otherwise(0.0)).alias("p"), F.when(big, 0.0).otherwise(F.col("r")).alias("r"))
        both = kept.unionByName(sent.select("seed", "node", F.lit(0.0).alias("p"), F.col("got").alias("r")))
        state = both.groupBy("seed", "node").agg(F.sum("p").alias("p"), F.sum("r").alias("r")).join(degrees, "node").select("seed", "node", "degree", "p", "r")
    state = cut(state)
    return state.select("seed", "node", "p", "r")


def _upto(rows: DataFrame, by: list, *values: str) -> DataFrame:
    """rows with the sums of values over all rows of their seed up to them, in the order of `by`: ranges first, then inside each."""
    cuts = rows.repartitionByRange(RANGES, "seed", *by).sortWithinPartitions("seed", *by).withColumn("range", F.spark_partition_id())
    cuts = cut(cuts)  # a range is what one task has written, whatever is read again
    inside = Window.partitionBy("seed", "range").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = cuts.groupBy("seed", "range").agg(*(F.sum(v).alias(f"{v}_in") for v in values))
    earlier = Window.partitionBy("seed").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows of a seed at most
    per = per.select("seed", "range", *(F.coalesce(F.sum(f"{v}_in").over(earlier), F.lit(0)).alias(f"{v}_before") for v in values))
    out = cuts.join(per, ["seed", "range"])
    return out.select(*rows.columns, *((F.sum(v).over(inside) + F.col(f"{v}_before")).alias(f"{v}_upto") for v in values))


def sweep(graph: Graph, scores: DataFrame) -> DataFrame:
    """(seed, node, conductance): of each seed the prefix of least conductance in descending order of score, of equal ones the shortest.

    scores has (seed, node, score) and only nodes with an edge and a score above zero count; equal scores go by node. The
    edges inside a prefix end at their later node, so that a prefix sum counts them.
    """
    live = scores.where("score > 0").join(graph.degrees.select("node", "degree"), "node").where("degree > 0")
    live = cut(live.select("seed", "node", "degree", (-F.col("score")).alias("by")))
    place = F.struct("by", "node")
    one, two = (live.select("seed", F.col("node").alias(e), place.alias(f"at_{e}")) for e in ("src", "dst"))
    inner = graph.edges.select("src", "dst").join(one, "src").join(two, ["seed", "dst"])
    later = inner.select("seed", F.when(F.col("at_src") > F.col("at_dst"), F.col("src")).otherwise(F.col("dst")).alias("node")).groupBy("seed", "node").agg(F.count(F.lit(1)).alias("inner"))
    rows = live.join(later, ["seed", "node"], "left").na.fill(0, ["inner"])
    sums = _upto(rows, ["by", "node"], "degree", "inner")
    every = graph.degrees.agg(F.coalesce(F.sum("degree"), F.lit(0)).alias("every"))
    low = F.least(F.col("degree_upto"), F.col("every") - F.col("degree_upto"))
    value = F.when(low > 0, F.round((F.col("degree_upto") - 2 * F.col("inner_upto")) / low, 12)).otherwise(2.0)
    judged = cut(sums.crossJoin(every).withColumn("conductance", value))  # a single row
    best = judged.groupBy("seed").agg(F.min(F.struct("conductance", "by", "node")).alias("m"))
    out = judged.join(best, "seed").where(F.struct("by", "node") <= F.struct("m.by", "m.node"))
    return out.select("seed", "node", F.col("m.conductance").alias("conductance"))
