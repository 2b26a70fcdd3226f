"""Classic and community-aware centralities: scores(node, <metric>)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.graph import Graph
from weft.operators import blocks
from weft.operators.local import one_group
from weft.operators.order import numbered
from weft.operators.paths import scoped
from weft.plans.lineage import cut


class Disconnected(ValueError):
    """Centralities of the whole graph need a connected one, or giant=True."""


def _single(graph: Graph, **aggregates) -> DataFrame:
    return graph.nodes.agg(F.count(F.lit(1)).alias("n"))


def degree_centrality(graph: Graph) -> DataFrame:
    """degree / (n - 1)."""
    return graph.degrees.crossJoin(_single(graph)).select("node", F.coalesce(F.try_divide("degree", F.col("n") - 1), F.lit(0.0)).alias("degree"))


#: Pairs of nodes that a batch of sources may reach; bounds the state of all-pairs runs.
BATCH_PAIRS = 100_000_000


def batches_of(graph: Graph, sources: DataFrame | None = None, pairs: int | None = None) -> list[DataFrame]:
    """The sources(node), all nodes if None, dealt by hash into batches of about pairs / nodes each."""
    nodes = cut(graph.nodes.select("node") if sources is None else sources.select("node"))
    n, k = graph.nodes.count(), nodes.count()
    parts = max(1, -(-n * k // (pairs or BATCH_PAIRS)))
    return [nodes.where(F.pmod(F.xxhash64("node"), F.lit(parts)) == i) for i in range(parts)] if parts > 1 else [nodes]


def _laid(graph: Graph) -> blocks.Layout:
    return blocks.layout(graph.adj.select("node", "nbr"), graph.nodes)


def _per_source(graph: Graph, dist: DataFrame | None, pairs: int | None) -> DataFrame:
    """(node, r, total, inverse): nodes reachable from each node, itself included, sum of their distances and of 1 / distance.

    Distances are the same both ways, so a batch of sources adds to every node.
    """
    if dist is not None:
        rows = dist.select(F.col("source").alias("node"), F.lit(1).alias("r"), F.col("d").alias("total"), F.when(F.col("d") > 0, 1 / F.col("d")).otherwise(0.0).alias("inverse"))
        return rows.groupBy("node").agg(F.sum("r").alias("r"), F.sum("total").alias("total"), F.sum("inverse").alias("inverse"))
    return blocks.path_sums(_laid(graph), blocks.whole(graph.nodes), flow=False, pairs=pairs).select("node", "r", "total", "inverse")


def closeness(graph: Graph, dist: DataFrame | None = None, pairs: int | None = None) -> DataFrame:
    """(r - 1) / sum of distances, times (r - 1) / (n - 1) where only r nodes are reachable; isolated nodes have 0."""
    return _closeness(graph, _per_source(graph, dist, pairs))


def _closeness(graph: Graph, per: DataFrame) -> DataFrame:
    """closeness from per(node, r, total): reachable nodes, itself included, and the sum of their distances."""
    rows = graph.nodes.select("node").join(per, "node", "left").crossJoin(_single(graph))
    r = F.col("r") - 1
    return rows.select("node", F.coalesce(F.try_divide(r, F.col("n") - 1) * F.try_divide(r, F.col("total")), F.lit(0.0)).alias("closeness"))


def harmonic(graph: Graph, dist: DataFrame | None = None, pairs: int | None = None) -> DataFrame:
    """Sum of 1 / distance."""
    per = _per_source(graph, dist, pairs).select("node", F.col("inverse").alias("harmonic"))
    return graph.nodes.select("node").join(per, "node", "left").na.fill(0.0, ["harmonic"])


def betweenness(graph: Graph, normalised: bool = True, load: bool = False, sources: DataFrame | None = None, pairs: int | None = None) -> DataFrame:
    """Share of shortest paths through a node (load: of equally split flow); sources(node) samples and rescales."""
    name = "load" if load else "betweenness"
    delta = blocks.path_sums(_laid(graph), blocks.whole(graph.nodes if sources is None else sources), load=load, pairs=pairs).select("node", F.col("delta").alias(name))
    return _betweenness(graph, delta, name, normalised, sources)


def _betweenness(graph: Graph, delta: DataFrame, name: str, normalised: bool, sources: DataFrame | None) -> DataFrame:
    """Of delta(node, <name>): the sums of the dependencies of all sources, or of those given."""
    rows = graph.nodes.select("node").join(delta, "node", "left").crossJoin(_single(graph))
    value = F.coalesce(F.col(name), F.lit(0.0))
    if sources is not None:
        rows = rows.crossJoin(sources.agg(F.count(F.lit(1)).alias("k")))
        value = value * F.col("n") / F.col("k")
    ends = (F.col("n") - 1) * (F.col("n") - 2)
    scaled = F.when(ends > 0, value / ends).otherwise(0.0) if normalised else value / 2
    return rows.select("node", scaled.alias(name))


def path_centralities(graph: Graph) -> DataFrame:
    """scores(node, closeness, betweenness) of one run over all sources."""
    sums = cut(blocks.path_sums(_laid(graph), blocks.whole(graph.nodes)))
    return _closeness(graph, sums.select("node", "r", "total")).join(_betweenness(graph, sums.select("node", F.col("delta").alias("betweenness")), "betweenness", True, None), "node")


def basic_centralities(graph: Graph, giant: bool = False) -> DataFrame:
    """scores(node, degree, closeness, betweenness); a disconnected graph raises unless giant."""
    if giant:
        graph = graph.giant()
    elif graph.component_sizes().limit(2).count() > 1:
        raise Disconnected("the graph is disconnected")
    return degree_centrality(graph).join(path_centralities(graph), "node")


def _with_loops(adj: DataFrame, graph: Graph) -> DataFrame:
    return adj.unionByName(graph.nodes.select("node", F.col("node").alias("nbr"), F.lit(1.0).alias("weight")))


def _step(adj: DataFrame, x: DataFrame) -> DataFrame:
    """One product; x stands once in the plan, so that several products make one plan of linear size."""
    return adj.join(x.withColumnRenamed("node", "nbr"), "nbr").groupBy("node").agg(F.sum(F.col("weight") * F.col("x")).alias("x"))


def eigenvector(graph: Graph, rounds: int = 2000, tolerance: float = 1e-6, cut_every: int = 4) -> DataFrame:
    """Power iteration of A + I on weights, Euclidean norm 1; stops when the change is below n * tolerance."""
    n = graph.nodes.count()
    adj = cut(_with_loops(graph.adj, graph))
    x = cut(graph.nodes.select("node", F.lit(1.0 / max(n, 1)).alias("x")))
    for _ in range(max(1, rounds // cut_every)):
        old = x
        for _ in range(cut_every):
            x = _step(adj, x)
        x = cut(x)
        norm = F.broadcast(x.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")))
        x = cut(x.crossJoin(norm).select("node", (F.col("x") / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)).alias("x")))
        moved = x.join(old.withColumnRenamed("x", "y"), "node").agg(F.sum(F.abs(F.col("x") - F.col("y")))).first()[0]
        if moved is None or moved < n * tolerance:
            break
    return x.withColumnRenamed("x", "eigenvector")


def largest_eigenvalue(graph: Graph, weighted: bool = False, rounds: int = 200, cut_every: int = 4) -> float:
    """Of the adjacency matrix, by power iteration of A + I."""
    adj = cut(_with_loops(graph.adj.select("node", "nbr", F.col("weight") if weighted else F.lit(1.0).alias("weight")), graph))
    x = cut(graph.nodes.select("node", F.lit(1.0).alias("x")))
    value = 0.0
    for _ in range(max(1, rounds // cut_every)):
        for _ in range(cut_every - 1):
            x = _step(adj, x)
        prior = cut(x)
        x = cut(_step(adj, prior))
        sums = x.join(prior.withColumnRenamed("x", "y"), "node").agg(F.sum(F.col("x") * F.col("y")), F.sum(F.col("y") * F.col("y")), F.sum(F.col("x") * F.col("x"))).first()
        new = sums[0] / sums[1] - 1 if sums[1] else 0.0
        x = cut(x.select("node", (F.col("x") / (sums[2] ** 0.5 or 1.0)).alias("x")))
        if abs(new - value) < 1e-9 * max(1.0, new):
            return new
        value = new
    return value


def katz(graph: Graph, beta: float = 1.0, rounds: int = 5000, tolerance: float = 1e-8, cut_every: int = 4, alpha: float | None = None) -> DataFrame:
    """x = alpha A x + beta on weights, alpha = min(.005, .9 / largest eigenvalue), scaled to norm 1."""
    alpha = min(0.005, 0.9 / max(largest_eigenvalue(graph, weighted=True), 1e-12)) if alpha is None else alpha
    adj, n = cut(graph.adj), graph.nodes.count()
    x = cut(graph.nodes.select("node", F.lit(0.0).alias("x")))
    for _ in range(max(1, rounds // cut_every)):
        old = x
        for _ in range(cut_every):
            pulled = adj.join(x.withColumnRenamed("node", "nbr"), "nbr").groupBy("node").agg(F.sum(F.col("weight") * F.col("x")).alias("p"))
            x = graph.nodes.select("node").join(pulled, "node", "left").select("node", (alpha * F.coalesce("p", F.lit(0.0)) + beta).alias("x"))
        x = cut(x)
        moved = x.join(old.withColumnRenamed("x", "y"), "node").agg(F.sum(F.abs(F.col("x") - F.col("y")))).first()[0]
        if moved is None or moved < n * tolerance:
            break
    norm = F.broadcast(x.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")))
    return x.crossJoin(norm).select("node", F.coalesce(F.try_divide("x", "norm"), F.lit(0.0)).alias("katz"))


def spectral(graph: Graph, method: str, most_nodes: int = 3_000) -> DataFrame:
    """information, communicability_betweenness or subgraph centrality by dense linear algebra; of large graphs subgraph centrality by components, the others are refused."""
    if graph.nodes.limit(most_nodes + 1).count() > most_nodes:
        if method == "subgraph":
            return subgraph_by_components(graph, most_nodes)
        raise ValueError(f"dense centralities take at most {most_nodes} nodes")
    kind = graph.nodes.schema["node"].dataType.simpleString()
    rows = graph.nodes.select("node", F.col("node").alias("nbr"), F.lit(0.0).alias("weight")).unionByName(graph.adj)

    def kernel(pdf):
        import numpy as np
        import pandas as pd

        nodes = sorted(set(pdf.node))
        index = {x: i for i, x in enumerate(nodes)}
        a = np.zeros((len(nodes), len(nodes)))
        a[[index[x] for x in pdf.node], [index[x] for x in pdf.nbr]] = (pdf.weight > 0) if method != "information" else pdf.weight
        np.fill_diagonal(a, 0)
        n = len(nodes)

        def expm(m):
            value, vector = np.linalg.eigh(m)
            return (vector * np.exp(value)) @ vector.T

        if method == "subgraph":
            out = np.diag(expm(a))
        elif method == "information":
            c = np.linalg.inv(np.diag(a.sum(1)) - a + 1.0)
            out = 1 / (np.diag(c) + (np.trace(c) - 2 / n) / n)
        elif method == "communicability_betweenness":
            whole, out = expm(a), np.zeros(n)
            for v in range(n):
                cutoff = a.copy()
                cutoff[v, :] = cutoff[:, v] = 0
                b = (whole - expm(cutoff)) / whole
                b[v, :] = b[:, v] = 0
                out[v] = b.sum() - np.trace(b)
            out /= max((n - 1) ** 2 - (n - 1), 1)
        else:
            raise ValueError(method)
        return pd.DataFrame({"node": nodes, method: out.astype(float)})

    return one_group(rows, kernel, f"node {kind}, `{method}` double")


def _closed_walks(a: np.ndarray) -> np.ndarray:
    """The diagonal of exp(a), a symmetric and nowhere negative: sums of squares of the lines of exp(a / 2), by products of positive terms, so that small values keep their digits."""
    halvings = max(0, math.ceil(math.log2(max(a.sum(1).max(initial=0) / 2, 1))))
    small, total = a / 2.0 ** (halvings + 1), np.eye(len(a))
    term = total
    for k in range(1, 21):  # the rows of small sum to 1 at most
        term = term @ small / k
        total = total + term
    with np.errstate(over="ignore", invalid="ignore"):
        for _ in range(halvings):
            total = total @ total
        return np.nan_to_num((total * total).sum(1), nan=np.inf, posinf=np.inf)


#: Places in which the components of a group begin.
GROUP = 1_024


def subgraph_by_components(graph: Graph, most_nodes: int) -> DataFrame:
    """Subgraph centrality: components of most_nodes nodes or fewer as dense matrices, neighbouring small ones in a group, larger ones by walks from blocks of nodes."""
    laid = _laid(graph)
    size = laid.places.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.floor(F.min("place") / GROUP).alias("group"))
    where = cut(laid.places.join(size, "component").select("node", "component", "group", "n"))
    small, large = where.where(F.col("n") <= most_nodes), where.where(F.col("n") > most_nodes).select("node")
    rows = small.select("group", "component", "node", F.col("node").alias("nbr")).unionByName(graph.adj.select("node", "nbr").join(small, "node").select("group", "component", "node", "nbr"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby("component"):
            nodes, ends = np.unique(np.concatenate([part.node, part.nbr]), return_inverse=True)
            a = np.zeros((len(nodes), len(nodes)))
            a[ends[: len(part)], ends[len(part) :]] = 1
            np.fill_diagonal(a, 0)
            out.append(pd.DataFrame({"node": nodes, "subgraph": _closed_walks(a)}))
        return pd.concat(out)

    done = rows.groupBy("group").applyInPandas(kernel, f"node {graph.nodes.schema['node'].dataType.simpleString()}, subgraph double")
    return done if large.isEmpty() else done.unionByName(blocks.closed_walks(laid, large).withColumnRenamed("value", "subgraph"))


def community_degree(graph: Graph, membership: DataFrame, alpha: float = 0.2) -> DataFrame:
    """scores(node, ccdc) of the nodes with a community: relational, without any paths."""
    m = membership.select("cid", "node").distinct()
    per = m.groupBy("cid").agg(F.count(F.lit(1)).alias("nk")).crossJoin(_single(graph))
    rows = m.join(graph.adj, "node").join(m.select("cid", F.col("node").alias("nbr"), F.lit(1).alias("inside")), ["cid", "nbr"], "left")
    rows = rows.groupBy("cid", "node").agg(F.count("inside").alias("din"), F.count(F.lit(1)).alias("degree")).join(per, "cid")
    span = F.col("nk") + alpha * (F.col("n") - F.col("nk")) - 1
    return rows.groupBy("node").agg(F.avg(F.when(span > 0, (F.col("din") + alpha * (F.col("degree") - F.col("din"))) / span)).alias("ccdc"))


def _path_sums(graph: Graph, m: DataFrame, domain: str, pairs: int | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sums over all sources: total(node, st, r) of distances, within(cid, node, si) of those to members of the same community,
    everywhere(node, bg) and within_b(cid, node, bi) of dependencies, of all ends and of the community's own."""
    laid = _laid(graph)
    sums = cut(blocks.path_sums(laid, blocks.whole(graph.nodes), pairs=pairs))
    mine = m.select(F.col("cid").alias("scope"), "node")
    if domain == "graph":  # each community's members as sources, whole-graph paths, ends within the community
        inner = blocks.path_sums(laid, mine, targets=mine, pairs=pairs).join(mine, ["scope", "node"], "left_semi")
    else:  # the communities' induced subgraphs, side by side as one graph
        ids = cut(numbered(mine, "id", F.col("scope"), F.col("node")))
        ends = scoped(graph, m).join(ids.withColumnRenamed("id", "a"), ["scope", "node"]).select("scope", "nbr", "a").join(ids.withColumnsRenamed({"node": "nbr", "id": "b"}), ["scope", "nbr"])
        every = ids.select(F.col("id").alias("node"))
        inner = blocks.path_sums(blocks.layout(ends.select(F.col("a").alias("node"), F.col("b").alias("nbr")), every), blocks.whole(every), pairs=pairs)
        inner = inner.select(F.col("node").alias("id"), "total", "delta").join(ids, "id")
    inner = cut(inner.select(F.col("scope").alias("cid"), "node", "total", "delta"))
    return (
        sums.select("node", F.col("total").alias("st"), "r"), inner.select("cid", "node", F.col("total").alias("si")),
        sums.select("node", (F.col("delta") / 2).alias("bg")), inner.select("cid", "node", (F.col("delta") / 2).alias("bi")),
    )


def community_centralities(graph: Graph, membership: DataFrame, alpha: float = 0.2, domain: str = "graph", aggregate: str = "mean", pairs: int | None = None) -> DataFrame:
    """scores(node, ccdc, cccc, ccbc): centralities that weigh what lies outside a node's communities by alpha.

    domain graph takes distances and paths in the whole graph, and nodes of no
    community get the global centrality; domain induced takes them in the
    induced subgraph, drops undefined terms and gives such nodes 0. A node's
    score is the mean (or max) over its communities; with domain graph an
    undefined closeness term makes the node's closeness null. Paths go in batches of
    sources, of `pairs` pairs of nodes each, of which only sums are kept.
    """
    alpha = min(max(alpha, 0.0), 1.0)
    m = cut(membership.select("cid", "node").distinct().join(graph.nodes.select("node"), "node", "left_semi"))
    one = _single(graph)
    per = m.groupBy("cid").agg(F.count(F.lit(1)).alias("nk")).crossJoin(one)
    span = F.col("nk") + alpha * (F.col("n") - F.col("nk")) - 1
    base = m.join(per, "cid")
    inside = m.join(graph.adj, "node").join(m.withColumnRenamed("node", "nbr"), ["cid", "nbr"]).groupBy("cid", "node").agg(F.count(F.lit(1)).alias("din"))
    rows = base.join(graph.degrees.select("node", "degree"), "node").join(inside, ["cid", "node"], "left").na.fill(0, ["din"])
    rows = rows.withColumn("ccdc", F.when(span > 0, (F.col("din") + alpha * (F.col("degree") - F.col("din"))) / span))
    total, within, everywhere, within_b = _path_sums(graph, m, domain, pairs)
    rows = rows.join(total, "node", "left").join(within, ["cid", "node"], "left").na.fill(0, ["st", "si"])
    far = F.col("si") + alpha * (F.col("st") - F.col("si"))
    rows = rows.withColumn("cccc", F.when(far > 0, span / far))
    rows = rows.join(everywhere, "node", "left").join(within_b, ["cid", "node"], "left").na.fill(0.0, ["bg", "bi"])
    n, nk = F.col("n"), F.col("nk")
    pg, pk = (n - 1) * (n - 2) / 2, (nk - 1) * (nk - 2) / 2
    bi = F.when(nk < 3, 0.0).otherwise(F.least(F.col("bi"), F.col("bg")))
    pk = F.when(nk < 3, 0.0).otherwise(pk) if domain == "graph" else pk
    room = pk + alpha * (pg - pk)
    rows = rows.withColumn("ccbc", F.when(room > 0, (bi + alpha * (F.col("bg") - bi)) / room))
    names = ("ccdc", "cccc", "ccbc")
    if aggregate == "max":
        scores = rows.groupBy("node").agg(*(F.max(c).alias(c) for c in names))
    elif domain == "graph":
        times = F.count(F.lit(1))
        scores = rows.groupBy("node").agg((F.sum("ccdc") / times).alias("ccdc"), F.when(F.count("cccc") == times, F.sum("cccc") / times).alias("cccc"), (F.sum("ccbc") / times).alias("ccbc"))
    else:
        scores = rows.groupBy("node").agg(*(F.avg(c).alias(c) for c in names))
    out = graph.nodes.select("node").join(scores.withColumn("member", F.lit(True)), "node", "left")
    if domain == "induced":
        return out.select("node", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in names))
    plain = _closeness(graph, total.select("node", "r", F.col("st").alias("total"))).join(degree_centrality(graph), "node").join(everywhere, "node", "left").crossJoin(one)
    out = out.join(plain, "node")
    fall = {"ccdc": F.col("degree"), "cccc": F.col("closeness"), "ccbc": F.when(pg > 0, F.coalesce("bg", F.lit(0.0)) / pg).otherwise(0.0)}
    return out.select("node", *(F.when(F.col("member"), F.coalesce(F.col(c), fall[c]) if c != "cccc" else F.col(c)).otherwise(fall[c]).alias(c) for c in names))
