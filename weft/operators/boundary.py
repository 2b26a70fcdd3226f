"""From a crisp partition to overlapping communities: boundary, profiles, similarity, injection, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.similarity import METRICS, metric_name, node_weight, similarity
from weft.graph import Graph
from weft.plans.lineage import cut


def boundary_candidates(graph: Graph, part: DataFrame) -> DataFrame:
    """(node, cand): communities of neighbours that are not the node's own. part has (node, cid), one cid a node."""
    own, other = part.select("node", "cid"), part.select(F.col("node").alias("nbr"), F.col("cid").alias("cand"))
    return graph.adj.join(own, "node").join(other, "nbr").where("cid <> cand").select("node", "cand").distinct()


def profiles(graph: Graph, part: DataFrame) -> DataFrame:
    """(cid, nbr): all neighbours of a community's members."""
    return graph.adj.join(part.select("node", "cid"), "node").select("cid", "nbr").distinct()


def boundary_similarity(graph: Graph, part: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(node, cand, size_node, size_profile, both, <metric>...) for all boundary candidates.

    Compares a node's neighbours with a community's profile. Candidates that
    share nothing have similarity 0. The work starts from the candidates, so
    pairs that are not adjacent are never formed.
    """
    cand, profile = boundary_candidates(graph, part), profiles(graph, part)
    weights = graph.degrees.select(F.col("node").alias("nbr"), *((node_weight(F.col("degree"), m) * node_weight(F.col("degree"), m)).alias(f"w_{m}") for m in ("aa", "ra")))
    sums = lambda tag: [F.count(F.lit(1)).alias(f"size_{tag}"), F.sum("w_aa").alias(f"aa_{tag}"), F.sum("w_ra").alias(f"ra_{tag}")]
    weighted = graph.adj.select("node", "nbr").join(weights, "nbr")
    of_node = weighted.groupBy("node").agg(*sums("node"))
    of_profile = profile.join(weights, "nbr").groupBy(F.col("cid").alias("cand")).agg(*sums("profile"))
    both = cand.join(weighted, "node").join(profile.withColumnRenamed("cid", "cand"), ["cand", "nbr"]).groupBy("node", "cand").agg(F.count(F.lit(1)).alias("both"), F.sum("w_aa").alias("aa_both"), F.sum("w_ra").alias("ra_both"))
    rows = cand.join(both, ["node", "cand"], "left").join(of_node, "node").join(of_profile, "cand")
    rows = rows.withColumn("both", F.coalesce("both", F.lit(0).cast("long")))
    c = F.col
    values = [similarity(m, c("size_node"), c("size_profile"), c("both"), *((c(f"{m}_both"), c(f"{m}_node"), c(f"{m}_profile")) if m in ("aa", "ra") else ())).alias(m) for m in metrics]
    return rows.select("node", "cand", "size_node", "size_profile", "both", *values)


def inject(graph: Graph, part: DataFrame, metric: str = "cosine", theta_sim: float = 0.4) -> DataFrame:
    """(cid, node): the partition and every candidate of similarity theta_sim or more."""
    metric = metric_name(metric)
    more = boundary_similarity(graph, part, (metric,)).where(F.col(metric) >= theta_sim).select(F.col("cand").alias("cid"), "node")
    return part.select("cid", "node").unionByName(more).distinct()


def community_pairs(membership: DataFrame) -> DataFrame:
    """(cid1, cid2, shared): communities with common nodes, cid1 < cid2."""
    a, b = membership.select(F.col("cid").alias("cid1"), "node"), membership.select(F.col("cid").alias("cid2"), "node")
    return a.join(b, "node").where("cid1 < cid2").groupBy("cid1", "cid2").agg(F.count(F.lit(1)).alias("shared"))


def merge_pairs(graph: Graph, membership: DataFrame, metric: str, theta_sim: float, theta_overlap: float) -> DataFrame:
    """(cid1, cid2): pairs that pass both tests of merging; if there are none, the scan changes nothing."""
    metric = metric_name(metric)
    w = node_weight(F.col("degree"), metric)
    sized = membership.join(graph.degrees, "node").groupBy("cid").agg(F.count(F.lit(1)).alias("size"), F.sum(w * w).alias("norm"))
    shared = membership.select(F.col("cid").alias("cid1"), "node").join(membership.select(F.col("cid").alias("cid2"), "node"), "node").where("cid1 < cid2").join(graph.degrees, "node")
    shared = shared.groupBy("cid1", "cid2").agg(F.count(F.lit(1)).alias("both"), F.sum(w * w).alias("dot"))
    one, two = (sized.select(F.col("cid").alias(f"cid{i}"), F.col("size").alias(f"s{i}"), F.col("norm").alias(f"n{i}")) for i in (1, 2))
    rows = shared.join(one, "cid1").join(two, "cid2")
    sim = similarity(metric, F.col("s1"), F.col("s2"), F.col("both"), F.col("dot"), F.col("n1"), F.col("n2"))
    return rows.where((F.col("both") / F.least("s1", "s2") >= theta_overlap) & (sim >= theta_sim)).select("cid1", "cid2")


def merge(graph: Graph, membership: DataFrame, metric: str = "cosine", theta_sim: float = 0.4, theta_overlap: float = 0.3) -> DataFrame:
    """(cid, node) after the controlled merge scan, communities from large to small, of equal ones the smaller cid first.

    A community joins the first larger one that holds theta_overlap of it at
    similarity theta_sim, as the larger one is when its turn comes. The scan goes in rounds: a community's turn has come once all
    larger ones that share nodes with it are settled and, for each of
    those, no other unsettled one that shares nodes with it comes before. What has not come yet
    cannot change its choice, so the result is that of one after the other.
    """
    metric = metric_name(metric)
    if merge_pairs(graph, membership, metric, theta_sim, theta_overlap).isEmpty():
        return membership.select("cid", "node")
    w = node_weight(F.col("degree"), metric)
    members = cut(membership.join(graph.degrees, "node").select("cid", "node", (w * w).alias("w")))
    order = F.struct((-F.count(F.lit(1))).alias("size"), F.col("cid").alias("c"))
    state = cut(members.groupBy("cid").agg(order.alias("at")).withColumn("open", F.lit(True)))
    while True:
        sized = members.groupBy("cid").agg(F.count(F.lit(1)).alias("size"), F.sum("w").alias("norm")).join(state, "cid")
        one = members.join(state.where("open"), "cid").select(F.col("cid").alias("i"), "node", "w", F.col("at").alias("at_i"))
        two = members.join(state, "cid").select(F.col("cid").alias("j"), "node", F.col("at").alias("at_j"))
        pairs = cut(one.join(two, "node").where("at_j < at_i").groupBy("i", "j").agg(F.count(F.lit(1)).alias("both"), F.sum("w").alias("dot"), F.first("at_i").alias("at_i")))
        hosts = pairs.join(state.select(F.col("cid").alias("j"), F.col("at").alias("at_j"), F.col("open").alias("open_j")), "j")
        first = hosts.groupBy("j").agg(F.min("at_i").alias("first"))
        waits = hosts.join(first, "j").where(F.col("open_j") | (F.col("at_i") > F.col("first"))).select(F.col("i").alias("cid")).distinct()
        ready = cut(state.where("open").join(waits, "cid", "left_anti"))
        if ready.isEmpty():
            return members.select("cid", "node")
        a, b = (sized.select(F.col("cid").alias(x), F.col("size").alias(f"size_{x}"), F.col("norm").alias(f"norm_{x}")) for x in ("i", "j"))
        rows = hosts.join(ready.select(F.col("cid").alias("i")), "i", "left_semi").join(a, "i").join(b, "j")
        sim = similarity(metric, F.col("size_i"), F.col("size_j"), F.col("both"), F.col("dot"), F.col("norm_i"), F.col("norm_j"))
        fits = rows.where((F.col("both") / F.col("size_i") >= theta_overlap) & (sim >= theta_sim))
        joins = cut(fits.groupBy(F.col("i").alias("cid")).agg(F.min_by("j", "at_j").alias("into")))
        members = cut(members.join(joins, "cid", "left").select(F.coalesce("into", "cid").alias("cid"), "node", "w").distinct())
        settled = ready.select("cid", F.lit(True).alias("ready"))
        state = state.join(joins.select("cid"), "cid", "left_anti").join(settled, "cid", "left")
        state = cut(state.select("cid", "at", (F.col("open") & F.col("ready").isNull()).alias("open")))
