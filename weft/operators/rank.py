"""Rankings and recovery curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.graph import Graph
from weft.operators import centrality
from weft.operators.order import min_ranks, numbered
from weft.plans.lineage import cut


def to_ranking(scores: DataFrame, method: str, column: str | None = None) -> DataFrame:
    """(method, rank, node): best first, missing scores last, ties by node."""
    rows = numbered(scores.select("node", F.col(column or method).alias("score")), "rank", F.col("score").desc_nulls_last(), F.col("node"))
    return rows.select(F.lit(method).alias("method"), "rank", "node")


def top_k(scores: DataFrame, column: str, k: int, rank_scope: str = "view") -> DataFrame:
    """The k best nodes by column, with min-ranks <c>_rank of every score, in the view or, with rank_scope global, among all nodes."""
    names = [c for c in scores.columns if c != "node"]
    rows = scores
    if rank_scope == "global":
        for c in names:
            rows = min_ranks(rows, c, f"{c}_rank")
        rows = rows.select("node", *names, *(f"{c}_rank" for c in names))
    rows = rows.orderBy(F.desc(column), "node").limit(k)
    return rows if rank_scope == "global" else rows.withColumns({f"{c}_rank": F.rank().over(Window.orderBy(F.desc(c))) for c in names})  # k rows


def as_texts(scores: DataFrame, digits: int = 6) -> DataFrame:
    """Scores as texts of so many decimals; missing ones are empty."""
    return scores.select("node", *(F.coalesce(F.format_string(f"%.{digits}f", F.col(c)), F.lit("")).alias(c) for c in scores.columns if c != "node"))


def thinned(rows: DataFrame, order: str, most: int = 5_000) -> DataFrame:
    """Every s-th row in order, from the first, s being the whole part of their number over most: for drawing long histories. order counts 1, 2, ..."""
    step = max(1, rows.count() // most)
    return rows.where((F.col(order) - 1) % step == 0)


def recovery_curve(rankings: DataFrame, positives: DataFrame, k: int | None = None) -> DataFrame:
    """(method, k, hits): positives(node) among the first k of each ranking."""
    hit = positives.select("node").distinct().withColumn("hit", F.lit(1))
    rows = rankings if k is None else rankings.where(F.col("rank") <= k)
    up_to = Window.partitionBy("method").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(hit, "node", "left").select("method", F.col("rank").alias("k"), F.sum(F.coalesce("hit", F.lit(0))).over(up_to).cast("long").alias("hits"))


def curve_summary(curve: DataFrame, at: tuple[int, ...] = (10, 20)) -> DataFrame:
    """(method, auc, hits_at_<k>...): trapezoids from (0, 0); k beyond the curve counts its end. Best first."""
    before = F.lag("hits", 1, 0).over(Window.partitionBy("method").orderBy("k"))
    rows = curve.withColumn("step", (before + F.col("hits")) / 2)
    out = rows.groupBy("method").agg(F.sum("step").alias("auc"), *(F.coalesce(F.max(F.when(F.col("k") <= n, F.col("hits"))), F.lit(0)).alias(f"hits_at_{n}") for n in at))
    return out.orderBy(F.desc(f"hits_at_{at[0]}"), F.desc("auc"), "method")


def top_detail(rankings: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """(method, rank, node, hit, sets): the first k with the names of the sets(hallmark, gene) that hold them."""
    names = sets.groupBy(F.col("gene").alias("node")).agg(F.array_join(F.sort_array(F.collect_set("hallmark")), ";").alias("sets"))
    rows = rankings.where(F.col("rank") <= k).join(names, "node", "left")
    return rows.select("method", "rank", "node", F.col("sets").isNotNull().alias("hit"), F.coalesce("sets", F.lit("")).alias("sets"))


#: Centralities of the ranking panel and how to compute them.
METHODS = {
    "degree": centrality.degree_centrality, "closeness": centrality.closeness, "betweenness": centrality.betweenness, "harmonic": centrality.harmonic, "load": lambda g: centrality.betweenness(g, load=True),
    "eigenvector": centrality.eigenvector, "katz": centrality.katz, "information": lambda g: centrality.spectral(g, "information"),
    "communicability_betweenness": lambda g: centrality.spectral(g, "communicability_betweenness"), "subgraph": lambda g: centrality.spectral(g, "subgraph"),
}


def builtin_rankings(graph: Graph, methods: tuple[str, ...] = ("degree", "closeness", "betweenness")) -> tuple[DataFrame | None, dict[str, str]]:
    """Rankings of the methods by scores of twelve digits, so that ties do not hang on the order of sums, and the reason for each that failed and was left out."""
    out, failed = None, {}
    for m in methods:
        try:
            one = to_ranking(METHODS[m](graph).select("node", F.round(m, 12).alias(m)), m)
        except ValueError as e:
            failed[m] = str(e)
            continue
        out = one if out is None else out.unionByName(one)
    return out, failed


def community_rankings(graph: Graph, membership: DataFrame, alphas: tuple[float, ...] = (0.1, 0.2), aggregate: str = "mean", domain: str = "induced") -> DataFrame:
    """Rankings by the community-aware centralities of twelve digits, methods named <metric>_alpha=<alpha>."""
    out = None
    for alpha in alphas:
        scores = cut(centrality.community_centralities(graph, membership, alpha, domain, aggregate))
        for c in ("ccdc", "cccc", "ccbc"):
            one = to_ranking(scores.select("node", F.round(c, 12).alias(c)), f"{c}_alpha={alpha:g}", c)
            out = one if out is None else out.unionByName(one)
    return out
