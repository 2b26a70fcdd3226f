"""The detectors: relational plans, iterated plans, and kernels in one bounded group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.similarity import METRICS
from weft.graph import Graph
from weft.operators import boundary, cover, egonets, growth, metrics, moving, pagerank, spanning
from weft.operators.components import connected_components
from weft.operators.local import MOST_ROWS, TooLarge, one_group
from weft.operators.triangles import common_neighbours as common_neighbours_of_edges
from weft.operators.triangles import oriented
from weft.operators.triangles import triangles as corners_of
from weft.plans import kernels as local
from weft.plans.lineage import cut
from weft.plans.registry import Param, register


def kernel_cover(graph: Graph, kernel: Callable[..., list[set]], part: DataFrame | None = None) -> DataFrame:
    """membership of a kernel that takes the adjacency dictionary and, if given, the communities of part; refuses graphs above the limit of one group."""
    kind = graph.nodes.schema["node"].dataType.simpleString()
    alone = graph.nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("weight"))
    held = alone.withColumn("cid", F.lit(None).cast("string")) if part is None else alone.join(part.select(F.col("node").alias("src"), F.col("cid").cast("string").alias("cid")), "src", "left").select("src", "dst", "weight", "cid")
    rows = graph.edges.select("src", "dst", "weight", F.lit(None).cast("string").alias("cid")).unionByName(held)

    def run(pdf):
        import pandas as pd

        adj: dict = {v: {} for v in sorted(set(pdf.src) | set(pdf.dst))}
        given: dict = {}
        for a, b, w, c in zip(pdf.src.tolist(), pdf.dst.tolist(), pdf.weight.tolist(), pdf.cid.tolist(), strict=True):
            if a != b:
                adj[a][b] = adj[b][a] = w
            elif part_given:
                given.setdefault(c, set()).add(a)
        found = sorted((s for s in (kernel(adj, list(given.values())) if part_given else kernel(adj)) if s), key=lambda s: (-len(s), min(s)))
        return pd.DataFrame([(i, v) for i, s in enumerate(found) for v in sorted(s)], columns=["cid", "node"])

    part_given = part is not None
    return one_group(rows, run, f"cid int, node {kind}")


@register(
    "COBS", "Crisp to overlapping by boundary similarity", Param("sim_metric", "enum", "cosine", options=METRICS), Param("theta_sim", "float", 0.4, 0, 1), Param("theta_overlap", "float", 0.3, 0, 1), help="flagship"
)
def boundary_overlap(graph: Graph, sim_metric: str = "cosine", theta_sim: float = 0.4, theta_overlap: float = 0.3, part: DataFrame | None = None) -> DataFrame:
    part = cut(greedy(graph) if part is None else part)
    return boundary.merge(graph, cut(boundary.inject(graph, part, sim_metric, theta_sim)), sim_metric, theta_sim, theta_overlap)


@register("CN_OCD", "Common neighbours", Param("theta_overlap", "float", 0.3, 0, 1, help="has no effect"), Param("theta_sim", "float", 0.4, 0, 1))
def common_neighbours(graph: Graph, theta_overlap: float = 0.3, theta_sim: float = 0.4) -> DataFrame:
    """common_neighbour_cover, whose communities merge, smaller ones into the first larger one that is alike, until none is."""
    found = cut(common_neighbour_cover(graph, theta_sim))
    while not boundary.merge_pairs(graph, found, "cosine", theta_sim, 0.0).isEmpty():
        found = boundary.merge(graph, found, "cosine", theta_sim, 0.0)
    return found


def common_neighbour_cover(graph: Graph, theta_sim: float = 0.4) -> DataFrame:
    """(cid, node): components of the edges of Salton similarity theta_sim; those of two nodes grow by their common neighbours;
    nodes alone join all communities with most of their neighbours, as these are then, or stay alone."""
    parts = cut(salton_components(graph, theta_sim))
    size = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b"))
    named = parts.join(size, "component")
    near = graph.adj.select("node", "nbr")
    grown = size.where("n = 2").join(near.withColumnsRenamed({"node": "a", "nbr": "x"}), "a").join(near.withColumnsRenamed({"node": "b", "nbr": "x"}), ["b", "x"])
    grouped = cut(named.where("n > 1").select(F.col("component").alias("cid"), "node").unionByName(grown.select(F.col("component").alias("cid"), F.col("x").alias("node"))).distinct())
    free = named.where("n = 1").select("node")
    joined = cut(best_communities(graph, free, grouped))
    alone = free.join(joined, "node", "left_anti").select(F.col("node").alias("cid"), "node")
    return grouped.unionByName(joined).unionByName(alone).distinct()


def salton_edges(graph: Graph) -> DataFrame:
    """(src, dst, both, salton) per edge, by common neighbours."""
    one, two = (graph.degrees.select(F.col("node").alias(e), F.col("degree").alias(f"d_{e}")) for e in ("src", "dst"))
    rows = graph.edges.select("src", "dst").join(common_neighbours_of_edges(graph), ["src", "dst"], "left").na.fill(0, ["both"]).join(one, "src").join(two, "dst")
    return rows.select("src", "dst", "both", (F.col("both") / F.sqrt(F.col("d_src").cast("double") * F.col("d_dst"))).alias("salton"))


def salton_components(graph: Graph, theta_sim: float) -> DataFrame:
    """(node, component) of the edges of similarity theta_sim or more; the relational form of the first step of CN_OCD."""
    found = connected_components(salton_edges(graph).where(F.col("salton") >= theta_sim))
    return graph.nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def best_communities(graph: Graph, free: DataFrame, membership: DataFrame) -> DataFrame:
    """(cid, node): each free node's communities with most of its neighbours, all ties; a snapshot."""
    hits = free.select("node").join(graph.adj, "node").join(membership.select("cid", F.col("node").alias("nbr")), "nbr").groupBy("node", "cid").agg(F.count(F.lit(1)).alias("hits"))
    top = hits.groupBy("node").agg(F.max("hits").alias("hits"))
    return hits.join(top, ["node", "hits"]).select("cid", "node")


@register("GREEDY_MODULARITY", "Greedy modularity", Param("resolution", "float", 1.0, 0.1, 5), overlapping=False)
def greedy(graph: Graph, resolution: float = 1.0) -> DataFrame:
    """Communities never cross components, and gains inside one depend on the rest by the total weight alone, so each component is a group of its own."""
    kind = graph.nodes.schema["node"].dataType.simpleString()
    total = graph.edges.agg(F.sum("weight")).first()[0] or 0.0
    of = cut(graph.components())
    alone = of.select("component", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("weight"))
    rows = cut(graph.edges.select("src", "dst", "weight").join(of.withColumnRenamed("node", "src"), "src").select("component", "src", "dst", "weight").unionByName(alone))
    if (rows.groupBy("component").count().agg(F.max("count")).first()[0] or 0) > MOST_ROWS:
        raise TooLarge(f"a sequential kernel takes at most {MOST_ROWS} rows")

    def run(pdf):
        import pandas as pd

        adj: dict = {v: {} for v in sorted(set(pdf.src) | set(pdf.dst))}
        for a, b, w in zip(pdf.src.tolist(), pdf.dst.tolist(), pdf.weight.tolist(), strict=True):
            if a != b:
                adj[a][b] = adj[b][a] = w
        found = local.greedy_modularity(adj, resolution, total=total)
        return pd.DataFrame([(min(s), v) for s in found for v in sorted(s)], columns=["first", "node"])

    found = cut(rows.groupBy("component").applyInPandas(run, f"first {kind}, node {kind}"))
    return cover.relabel(found.withColumnRenamed("first", "cid"))


@register("DGM_CRISP", "Dismantling greedy modularity", Param("p", "float", 5.0, 0.1, 30), Param("exploration_prob", "float", 0.3, 0, 1), Param("seed", "int", 13579), Param("resolution", "float", 1.0, 0.1, 5), overlapping=False)
def dismantling(graph: Graph, p: float = 5.0, exploration_prob: float = 0.3, seed: int = 13579, resolution: float = 1.0) -> DataFrame:
    return kernel_cover(graph, lambda adj: local.dismantle_greedy(adj, p, exploration_prob, seed, resolution, True)[0])


def dismantling_history(graph: Graph, p: float = 5.0, exploration_prob: float = 0.3, seed: int = 13579, resolution: float = 1.0) -> DataFrame:
    """(iter, modularity, maximum_modularity)."""
    rows = graph.edges.select(F.col("src").cast("string"), F.col("dst").cast("string"), "weight")

    def run(pdf):
        import pandas as pd

        adj: dict = {v: {} for v in sorted(set(pdf.src) | set(pdf.dst))}
        for a, b, w in zip(pdf.src, pdf.dst, pdf.weight, strict=True):
            adj[a][b] = adj[b][a] = w
        return pd.DataFrame(local.dismantle_greedy(adj, p, exploration_prob, seed, resolution, True)[1], columns=["iter", "modularity", "maximum_modularity"])

    return one_group(rows, run, "iter int, modularity double, maximum_modularity double")


@register("DEMON", "Ego-net label propagation", Param("epsilon", "float", 0.25, 0, 1), Param("min_com_size", "int", 3, 2, 10), Param("rounds", "int", 20, 1, 100))
def demon(graph: Graph, epsilon: float = 0.25, min_com_size: int = 3, rounds: int = 20) -> DataFrame:
    """Labels of all ego networks at once; a community joins the largest that misses epsilon of it at most, round by round."""
    groups = egonets.propagate(egonets.ego_edges(graph), rounds)
    return egonets.merge_contained(egonets.ego_communities(graph, groups, min_com_size), 1 - epsilon)


@register("LFM", "Local fitness", Param("alpha", "float", 1.0, 0.1, 5), Param("rounds", "int", 1000, 1, 1000000))
def lfm(graph: Graph, alpha: float = 1.0, rounds: int = 1000) -> DataFrame:
    """Every node grows a community by inner / every ** alpha, a change a round; by node, those whose seed lies in one before them go."""
    grown = cut(growth.grow(graph, graph.nodes, growth.by_fitness(alpha), rounds))
    return growth.uncovered_first(grown, graph.nodes.select("node", F.col("node").alias("at"))).select(F.col("seed").alias("cid"), "node")


@register("KCLIQUE", "Clique percolation", Param("k", "int", 3, 3, 8))
def kclique(graph: Graph, k: int = 3) -> DataFrame:
    """Ordered self-joins from low to high degree build k-cliques; those that share k - 1 nodes are one community."""
    out = cut(oriented(graph))
    cliques = out.select(F.array("a", "b").alias("c"))
    for size in range(2, k):
        more = cliques.select("c", F.col("c")[0].alias("a")).join(out.withColumnRenamed("b", "x"), "a").select("c", "x")
        for i in range(1, size):
            more = _extend(more, out, i)
        cliques = more.select(F.array_append("c", F.col("x")).alias("c"))
    cliques = cut(cliques.select(F.sort_array("c").alias("c")).distinct().withColumn("id", F.xxhash64("c")))
    faces = cliques.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.filter("c", lambda x, j: j != i))).alias("face"))
    hub = faces.groupBy("face").agg(F.min("id").alias("least"))
    linked = faces.join(hub, "face").select(F.col("id").alias("src"), F.col("least").alias("dst")).where("src <> dst")
    comps = connected_components(linked)
    named = cliques.join(comps.withColumnRenamed("node", "id"), "id", "left").select(F.coalesce("component", "id").alias("cid"), F.explode("c").alias("node"))
    return named.distinct()


def _extend(more: DataFrame, out: DataFrame, i: int) -> DataFrame:
    return more.withColumn("a", F.col("c")[i]).join(out.withColumnRenamed("b", "x"), ["a", "x"], "left_semi").drop("a")


@register("LOUVAIN", "Parallel local moving", Param("seed", "int", 42), Param("resolution", "float", 1.0, 0.1, 5), Param("steps", "int", 100, 1, 10000), overlapping=False)
def louvain(graph: Graph, seed: int = 42, resolution: float = 1.0, steps: int = 100) -> DataFrame:
    return moving.louvain(graph, seed, resolution, steps).select("cid", "node")


@register("SLPA", "Speaker-listener label propagation", Param("t", "int", 50, 10, 200), Param("r", "float", 0.4, 0.05, 0.9), Param("seed", "int", 0))
def slpa(graph: Graph, t: int = 50, r: float = 0.4, seed: int = 0, cut_every: int = 5) -> DataFrame:
    """Synchronous: each round all neighbours speak a label drawn from their memory by a hash; listeners keep the most frequent."""
    adj = cut(graph.adj.select("node", "nbr"))
    memory = cut(graph.nodes.select("node", F.create_map(F.col("node"), F.lit(1)).alias("memory")))
    for step in range(1, t):
        draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "node", "nbr"), F.lit(step)).cast("int")
        entries = "map_entries(memory)"
        heard = adj.join(memory.withColumnRenamed("node", "nbr"), "nbr").withColumn("draw", draw)
        spoken = F.expr(f"element_at(filter(transform({entries}, (e, i) -> struct(e.key as label, aggregate(slice({entries}, 1, i + 1), 0, (a, x) -> a + x.value) as upto)), x -> x.upto > draw), 1).label")
        votes = heard.select("node", spoken.alias("label")).groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
        picked = votes.groupBy("node").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"))
        memory = memory.join(picked, "node", "left").select(
            "node", F.when(F.col("label").isNull(), F.transform_values("memory", lambda k, v: v + 1)).otherwise(F.map_from_entries(F.expr("transform(map_entries(map_concat(transform_values(map_filter(memory, (k, v) -> k <> label), (k, v) -> v), map(label, coalesce(memory[label], 0) + 1))), e -> e)"))).alias("memory")
        )
        if step % cut_every == 0:
            memory = cut(memory)
    kept = memory.select("node", F.explode("memory").alias("label", "n")).where(F.col("n") >= r * t)
    return kept.select(F.col("label").alias("cid"), "node")


@register("EGONET", "Ego networks", Param("level", "int", 1, 1, 3))
def ego_networks(graph: Graph, level: int = 1) -> DataFrame:
    reach = graph.nodes.select(F.col("node").alias("cid"), "node")
    for _ in range(level):
        step = reach.join(graph.adj.select("node", "nbr"), "node").select("cid", F.col("nbr").alias("node"))
        reach = cut(reach.unionByName(step).distinct())
    return reach


@register("NODEP", "Node perception", Param("threshold", "float", 0.25, 0, 1), Param("overlap_threshold", "float", 0.25, 0, 1), Param("rounds", "int", 20, 1, 100))
def node_perception(graph: Graph, threshold: float = 0.25, overlap_threshold: float = 0.25, rounds: int = 20) -> DataFrame:
    """Components of ego networks without their centre, with it, are sub-communities; those of Jaccard threshold (and overlap) link, and label propagation over the links joins them."""
    members = cut(egonets.ego_communities(graph, egonets.ego_components(graph), 2))
    shared, one, two = F.col("shared"), F.col("size_c"), F.col("size_d")
    test = (shared / (one + two - shared) >= threshold) & (shared / F.least(one, two) >= overlap_threshold)
    links = egonets.alike(members, threshold, test).select(F.lit(0).alias("scope"), F.col("c").alias("src"), F.col("d").alias("dst"))
    labels = egonets.propagate(links, rounds, "scope").select(F.col("node").alias("cid"), "label")
    return members.join(labels, "cid", "left").select(F.coalesce("label", "cid").alias("cid"), "node").distinct()


@register("ANGEL", "Ego-net merging by size", Param("threshold", "float", 0.25, 0, 1), Param("min_community_size", "int", 3, 2, 50), Param("rounds", "int", 20, 1, 100))
def angel(graph: Graph, threshold: float = 0.25, min_community_size: int = 3, rounds: int = 20) -> DataFrame:
    """As demon, but a community joins the larger one that shares most with it."""
    groups = egonets.propagate(egonets.ego_edges(graph), rounds)
    return egonets.merge_contained(egonets.ego_communities(graph, groups, min_community_size), 1 - threshold, by_overlap=True)


@register("CONGA", "Split betweenness", Param("number_communities", "int", 3, 2, 50))
def conga(graph: Graph, number_communities: int = 3) -> DataFrame:
    return kernel_cover(graph, lambda adj: local.split_girvan_newman(adj, number_communities))


@register("CONGO", "Local split betweenness", Param("number_communities", "int", 3, 2, 50), Param("height", "int", 2, 1, 10))
def congo(graph: Graph, number_communities: int = 3, height: int = 2) -> DataFrame:
    return kernel_cover(graph, lambda adj: local.split_girvan_newman(adj, number_communities, height))


@register("LAIS2", "Link aggregate and iterative scan")
def lais2(graph: Graph) -> DataFrame:
    return kernel_cover(graph, local.link_aggregate)


@register("LPANNI", "Label propagation with neighbour influence", Param("threshold", "float", 0.1, 0, 1), Param("rounds", "int", 10, 1, 100))
def lpanni(graph: Graph, threshold: float = 0.1, rounds: int = 10) -> DataFrame:
    """Labels carry belonging coefficients; neighbours speak theirs weighted by influence, weak ones are dropped."""
    sim = salton_edges(graph).select("src", "dst", (F.col("salton") + 1e-3).alias("s"))
    both = sim.unionByName(sim.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "s"))
    top = both.groupBy("src").agg(F.max("s").alias("top"))
    pull = cut(both.join(top, "src").select(F.col("src").alias("node"), F.col("dst").alias("nbr"), F.sqrt(F.col("s") / F.col("top")).alias("pull")))
    labels = cut(graph.nodes.select("node", F.col("node").alias("cid"), F.lit(1.0).alias("b")))
    for _ in range(rounds):
        heard = pull.join(labels.withColumnRenamed("node", "nbr"), "nbr").groupBy("node", "cid").agg(F.sum(F.col("pull") * F.col("b")).alias("x"))
        every = heard.groupBy("node").agg(F.sum("x").alias("total"), F.max("x").alias("most"), F.min_by("cid", F.struct(-F.col("x"), "cid")).alias("first"))
        kept = heard.join(every, "node").where((F.col("x") / F.col("total") >= F.greatest(F.lit(threshold), F.lit(0.0))) | (F.col("cid") == F.col("first")))
        whole = kept.groupBy("node").agg(F.sum("x").alias("sum"))
        new = kept.join(whole, "node").select("node", "cid", (F.col("x") / F.col("sum")).alias("b"))
        labels = cut(new.unionByName(labels.join(new.select("node").distinct(), "node", "left_anti")))
    return labels.select("cid", "node")


@register("CORE_EXP", "Core expansion", Param("tolerance", "float", 0.5, 0, 1))
def core_expansion(graph: Graph, tolerance: float = 0.5) -> DataFrame:
    """Components of edges of the highest similarity around each end are cores; free nodes join the best core until none moves."""
    sim = cut(salton_edges(graph))
    ends = sim.select(F.col("src").alias("node"), "salton").unionByName(sim.select(F.col("dst").alias("node"), "salton"))
    top = ends.groupBy("node").agg(F.max("salton").alias("top"))
    strong = sim.join(top.withColumnsRenamed({"node": "src", "top": "ts"}), "src").join(top.withColumnsRenamed({"node": "dst", "top": "td"}), "dst")
    cores = connected_components(strong.where((F.col("salton") > 0) & (F.col("salton") >= (1 - tolerance / 2) * F.greatest("ts", "td"))))
    members = cut(cores.select(F.col("component").alias("cid"), "node"))
    while True:
        free = graph.nodes.select("node").join(members.select("node").distinct(), "node", "left_anti")
        more = cut(best_communities(graph, free, members))
        if more.isEmpty():
            break
        members = cut(members.unionByName(more))
    return members.unionByName(free.select(F.col("node").alias("cid"), "node"))


@register("DCS", "Divide and conquer", Param("most", "int", 50, 2, 1000000), Param("rounds", "int", 50, 1, 1000))
def dcs(graph: Graph, most: int = 50, rounds: int = 50) -> DataFrame:
    """Synchronous label propagation divides the graph, and again every part of more than `most` nodes by the edges inside it, all parts at
    once, until none divides; then nodes join every other part that has half of their neighbours."""
    parts, done = cut(graph.components().select(F.col("component").alias("scope"), "node")), None
    while not parts.isEmpty():
        one, two = (parts.select(F.col("node").alias(e), F.col("scope").alias(f"s_{e}")) for e in ("src", "dst"))
        inside = graph.edges.join(one, "src").join(two, "dst").where("s_src = s_dst").select(F.col("s_src").alias("scope"), "src", "dst")
        labels = egonets.propagate(inside, rounds, "scope")
        found = cut(parts.join(labels.select("scope", "node", "label"), ["scope", "node"], "left").select("scope", "node", F.coalesce("label", "node").alias("label")))
        sized = found.groupBy("scope").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high"))
        whole = sized.where((F.col("size") <= most) | (F.col("low") == F.col("high"))).select("scope")
        settled = found.join(whole, "scope", "left_semi").select(F.col("scope").alias("cid"), "node")
        done = settled if done is None else done.unionByName(settled)
        parts = cut(found.join(whole, "scope", "left_anti").select(F.col("label").alias("scope"), "node"))
    done = cut(graph.nodes.select(F.col("node").alias("cid"), "node").limit(0) if done is None else done)
    more = graph.adj.join(done.withColumnRenamed("node", "nbr"), "nbr").groupBy("cid", "node").agg(F.count(F.lit(1)).alias("links")).join(graph.degrees, "node")
    return done.unionByName(more.where("2 * links >= degree").select("cid", "node")).distinct()


def closeness_of_ends(graph: Graph, use_weights: bool) -> DataFrame:
    """(node, w): the sum over a node's edges of their weights, or of the common neighbours of their ends."""
    if use_weights:
        return graph.degrees.select("node", F.round("strength", 9).alias("w"))
    corners = corners_of(graph).select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg((2 * F.count(F.lit(1))).alias("w"))
    return graph.nodes.select("node").join(corners, "node", "left").na.fill(0, ["w"])


@register("DPCLUS", "Density and periphery", Param("use_weights", "bool", False), Param("d_threshold", "float", 0.9, 0, 1), Param("cp_threshold", "float", 0.5, 0, 1), Param("rounds", "int", 1000, 1, 1000000))
def dpclus(graph: Graph, use_weights: bool = False, d_threshold: float = 0.9, cp_threshold: float = 0.5, rounds: int = 1000) -> DataFrame:
    """Clusters that leave the graph, pass by pass: every node grows one in what is left, by closeness_of_ends there those stay that share no
    node with one before them. A cluster grows as if those before it had left, so a pass is one after the other by the weights as it began. At the end nodes next to d_threshold of a core of three or more join it."""
    left, kept = graph, None
    while not left.edges.isEmpty():
        able = cut(closeness_of_ends(left, use_weights).join(left.degrees.where("degree > 0"), "node"))
        grown = cut(growth.grow(left, able, growth.by_density(d_threshold, cp_threshold), rounds))
        order = able.select("node", F.struct((-F.col("w")).alias("w"), (-F.col("degree")).alias("d"), "node").alias("at"))
        stay = cut(growth.disjoint_first(grown, order))
        kept = stay if kept is None else kept.unionByName(stay)
        rest = left.subgraph(left.nodes.select("node").join(stay, "node", "left_anti"))
        left = Graph(cut(rest.nodes), cut(rest.edges))
    if kept is None:
        return graph.nodes.select(F.col("node").alias("cid"), "node").limit(0)
    around, own = growth.surroundings(graph, kept)
    more = around.where("not inside").join(own, "seed").where((F.col("size") > 2) & (F.col("links") >= d_threshold * F.col("size")))
    return kept.unionByName(more.select("seed", "node")).select(F.col("seed").alias("cid"), "node")


@register("IPCA", "Interaction probability", Param("use_weights", "bool", False), Param("t_in", "float", 0.5, 0, 1), Param("rounds", "int", 1000, 1, 1000000))
def ipca(graph: Graph, use_weights: bool = False, t_in: float = 0.5, rounds: int = 1000) -> DataFrame:
    """Every node grows by the neighbour with most edges into its cluster, t_in of its members at least, of diameter two; by closeness_of_ends, those whose seed lies in one before them go."""
    weights = cut(closeness_of_ends(graph, use_weights))
    grown = cut(growth.grow(graph, graph.nodes, growth.by_interaction(graph, weights, t_in), rounds))
    return covers_of_two(growth.uncovered_first(grown, weights.select("node", F.struct((-F.col("w")).alias("w"), "node").alias("at"))))


def covers_of_two(grown: DataFrame) -> DataFrame:
    """(cid, node) of the communities of two nodes or more of (seed, node)."""
    return grown.join(grown.where("seed <> node").select("seed").distinct(), "seed", "left_semi").select(F.col("seed").alias("cid"), "node")


@register("EBGC", "Entropy growth", Param("rounds", "int", 1000, 1, 1000000))
def ebgc(graph: Graph, rounds: int = 1000) -> DataFrame:
    """Every node with the neighbour that shares most neighbours with it grows by the node with the largest share of its edges inside that lowers the entropy;
    by the number of triangles, then degree, those whose seed lies in one before them go."""
    both = common_neighbours_of_edges(graph)
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "both")).toDF("node", "nbr", "both")
    pairs = graph.adj.join(both, ["node", "nbr"], "left").na.fill(0, ["both"])
    start = cut(pairs.groupBy("node").agg(F.min_by("nbr", F.struct((-F.col("both")).alias("b"), "nbr")).alias("nbr")))
    members = start.select(F.col("node").alias("seed"), "node").unionByName(start.select(F.col("node").alias("seed"), F.col("nbr").alias("node")))
    grown = cut(growth.grow_from(graph, members, growth.by_entropy(graph, steepest=False), rounds))
    order = closeness_of_ends(graph, False).join(graph.degrees.where("degree > 0"), "node").select("node", F.struct((-F.col("w")).alias("w"), (-F.col("degree")).alias("d"), "node").alias("at"))
    return growth.uncovered_first(grown, order).select(F.col("seed").alias("cid"), "node")


@register("GRAPH_ENT", "Graph entropy", Param("use_weights", "bool", False), Param("rounds", "int", 1000, 1, 1000000))
def graph_entropy(graph: Graph, use_weights: bool = False, rounds: int = 1000) -> DataFrame:
    """Every node with its neighbours: while the graph entropy falls, the member that lowers it most leaves, then, when none does, the outer node that
    lowers it most enters; by degree, those whose seed lies in one before them go."""
    around = graph.nodes.select(F.col("node").alias("seed"), "node").unionByName(graph.adj.select(F.col("node").alias("seed"), F.col("nbr").alias("node")))
    fewer = growth.grow_from(graph, around, growth.by_entropy(graph, use_weights, leaving=True), rounds)
    grown = cut(growth.grow_from(graph, fewer, growth.by_entropy(graph, use_weights), rounds))
    return covers_of_two(growth.uncovered_first(grown, graph.degrees.select("node", F.struct((-F.col("degree")).alias("d"), "node").alias("at"))))


@register("COACH", "Core and attachment", Param("density_threshold", "float", 0.7, 0, 1), Param("affinity_threshold", "float", 0.225, 0, 1), Param("closeness_threshold", "float", 0.5, 0, 1))
def coach(graph: Graph, density_threshold: float = 0.7, affinity_threshold: float = 0.225, closeness_threshold: float = 0.5) -> DataFrame:
    """Dense cores of neighbourhood graphs; of cores alike the first by density times size stays; outside nodes close to most of a core join it."""
    cores = cut(egonets.dense_cores(graph, density_threshold))
    members = cut(cover.drop_duplicates(cores.select("cid", "node")))
    weight = cores.join(members, ["cid", "node"], "left_semi").groupBy("cid").agg((F.first("density") * F.count(F.lit(1))).alias("weight"))
    affinity = F.col("shared") * F.col("shared") / (F.col("size_c") * F.col("size_d"))
    pairs = egonets.alike(members, affinity_threshold, affinity >= affinity_threshold - 1e-12)
    kept = egonets.first_come(weight.select(F.col("cid").alias("id"), F.struct((-F.round("weight", 9)).alias("w"), "cid").alias("order")), pairs, "order")
    core = cut(members.join(kept.withColumnRenamed("id", "cid"), "cid", "left_semi"))
    sizes = core.groupBy("cid").agg(F.count(F.lit(1)).alias("size"))
    near = core.join(graph.adj.select("node", "nbr"), "node").groupBy("cid", F.col("nbr").alias("node")).agg(F.count(F.lit(1)).alias("links"))
    more = near.join(sizes, "cid").where(F.col("links") / F.col("size") >= closeness_threshold).select("cid", "node")
    return core.select("cid", "node").unionByName(more).distinct()


@register("UMSTMO", "Union of maximum spanning trees")
def umstmo(graph: Graph) -> DataFrame:
    """Of the fragments of each round towards the maximum spanning forest of similarities the cover of highest overlapping modularity.

    Nodes whose strongest edges are tied, all of which lie in the union of all
    maximum spanning forests, are in the fragments at the other ends as well.
    """
    rows = cut(strengths(graph))
    found, rounds = spanning.boruvka(rows)
    union = found.where("weight >= low")
    ends = union.select(F.col("src").alias("node"), F.col("dst").alias("nbr"), "weight").unionByName(union.select(F.col("dst").alias("node"), F.col("src").alias("nbr"), "weight"))
    ties = cut(ends.join(ends.groupBy("node").agg(F.max("weight").alias("weight")), ["node", "weight"]).select("node", "nbr"))
    best, value = graph.nodes.select(F.col("node").alias("cid"), "node"), float("-inf")
    for held in rounds:
        own = graph.nodes.select("node").join(held, "node", "left").select(F.coalesce("fragment", "node").alias("cid"), "node")
        more = ties.join(held.select(F.col("node").alias("nbr"), F.col("fragment").alias("cid")), "nbr").select("cid", "node")
        cover_ = cut(own.unionByName(more).distinct())
        now = metrics.shen_modularity(graph, cover_).first()[0]
        if now > value + 1e-12:
            best, value = cover_, now
    return best


def first_contraction(graph: Graph) -> DataFrame:
    """(cid, node): components of each node's strongest edge by (weight, similarity, ends)."""
    sim = salton_edges(graph).join(graph.edges, ["src", "dst"])
    key = F.struct("weight", "salton", F.col("src"), F.col("dst"))
    ends = sim.select(F.col("src").alias("node"), key.alias("k")).unionByName(sim.select(F.col("dst").alias("node"), key.alias("k")))
    found = connected_components(ends.groupBy("node").agg(F.max("k").alias("k")).select("k.src", "k.dst").distinct())
    return graph.nodes.select("node").join(found, "node", "left").select(F.coalesce("component", "node").alias("cid"), "node")


def strengths(graph: Graph) -> DataFrame:
    """(src, dst, weight): edge weights times the similarity of the closed neighbourhoods of their ends, to nine digits, so that equal ones tie."""
    one, two = (graph.degrees.select(F.col("node").alias(e), F.col("degree").alias(f"d_{e}")) for e in ("src", "dst"))
    rows = graph.edges.join(common_neighbours_of_edges(graph), ["src", "dst"], "left").na.fill(0, ["both"]).join(one, "src").join(two, "dst")
    similar = (F.col("both") + 2) / F.sqrt((F.col("d_src") + 1.0) * (F.col("d_dst") + 1.0))
    return rows.select("src", "dst", F.round(F.col("weight") * similar, 9).alias("weight"))


@register("WALKSCAN", "Walk scores and density clustering", Param("nb_steps", "int", 2, 1, 10), Param("eps", "float", 0.1, 0, 10), Param("min_samples", "int", 3, 1, 50), Param("seed_node", "node", None))
def walkscan(graph: Graph, nb_steps: int = 2, eps: float = 0.1, min_samples: int = 3, seed_node=None) -> DataFrame:
    """Probabilities of walks from the seed as features; points with min_samples within eps, by grid cells, form the clusters."""
    start = graph.nodes.agg(F.min("node").alias("node")) if seed_node is None else graph.nodes.where(F.col("node") == seed_node).select("node")
    spread = graph.adj.join(graph.degrees.select("node", "strength"), "node").select("node", "nbr", (F.col("weight") / F.col("strength")).alias("p"))
    walk, features = start.withColumn("x", F.lit(1.0)), None
    for step in range(1, nb_steps + 1):
        walk = cut(walk.join(spread, "node").groupBy(F.col("nbr").alias("node")).agg(F.sum(F.col("x") * F.col("p")).alias("x")))
        one = walk.withColumnRenamed("x", f"x{step}")
        features = one if features is None else features.join(one, "node", "full")
    names = [f"x{s}" for s in range(1, nb_steps + 1)]
    points = cut(features.na.fill(0.0, names).select("node", F.array(*names).alias("x")).withColumn("cell", F.floor(F.col("x")[0] / max(eps, 1e-12))))
    other = points.select(F.col("node").alias("n2"), F.col("x").alias("x2"), F.explode(F.expr("sequence(cell - 1, cell + 1)")).alias("cell"))
    close = points.join(other, "cell").where(F.sqrt(F.expr("aggregate(zip_with(x, x2, (a, b) -> (a - b) * (a - b)), 0D, (s, v) -> s + v)")) <= eps).select("node", "n2")
    close = cut(close)
    core = close.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_samples).select("node")
    both = close.join(core, "node", "left_semi").join(core.withColumnRenamed("node", "n2"), "n2", "left_semi")
    comps = core.join(connected_components(both, "node", "n2"), "node", "left").select("node", F.coalesce("component", "node").alias("cid"))
    border = close.join(comps.withColumnRenamed("node", "n2"), "n2").join(core, "node", "left_anti").groupBy("node").agg(F.min("cid").alias("cid"))
    return comps.select("cid", "node").unionByName(border.select("cid", "node"))


@register("WCOMMUNITY", "Belonging degree", Param("min_bel_degree", "float", 0.7, 0, 1), Param("threshold_bel_degree", "float", 0.7, 0, 1), Param("weightName", "enum", "weight", options=("weight",)), Param("rounds", "int", 1000, 1, 1000000))
def wcommunity(graph: Graph, min_bel_degree: float = 0.7, threshold_bel_degree: float = 0.7, weightName: str = "weight", rounds: int = 1000) -> DataFrame:  # noqa: N803
    """Every node grows by the neighbour that belongs most to its community; by strength, those whose seed lies in one before them go; then all nodes join that belong enough."""
    grown = cut(growth.grow(graph, graph.nodes, growth.by_belonging(min_bel_degree), rounds))
    kept = cut(growth.uncovered_first(grown, graph.degrees.select("node", F.struct((-F.col("strength")).alias("s"), "node").alias("at"))))
    around, _ = growth.surroundings(graph, kept)
    more = around.where((F.col("strength") > 0) & (F.col("weight") / F.col("strength") >= threshold_bel_degree)).select("seed", "node")
    return kept.unionByName(more).distinct().select(F.col("seed").alias("cid"), "node")


@register("MULTICOM", "Local communities of a seed", Param("seed_node", "node", None), Param("alpha", "float", 0.85, 0, 1), Param("epsilon", "float", 1e-4, 1e-9, 1), Param("alike", "float", 0.8, 0, 1))
def multicom(graph: Graph, seed_node=None, alpha: float = 0.85, epsilon: float = 1e-4, alike: float = 0.8) -> DataFrame:
    """Communities around one seed: sweeps of the walks from it and from each of its neighbours, all at once; they come in that order, neighbours
    by node, and a neighbour counts unless it lies in a community before it that counts; of communities alike the first stays."""
    first = seed_of(graph, seed_node)
    near = graph.adj.join(first, "node").select(F.col("nbr").alias("node"))
    seeds = cut(first.withColumn("turn", F.lit(0)).unionByName(near.withColumn("turn", F.lit(1))))
    scores = pagerank.push(graph, seeds.select(F.col("node").alias("seed"), "node"), alpha, epsilon)
    degrees = graph.degrees.select("node", "degree")
    found = pagerank.sweep(graph, scores.join(degrees, "node").where("degree > 0").select("seed", "node", (F.col("p") / F.col("degree")).alias("score")))
    found = cut(found.select(F.col("seed").alias("cid"), "node"))
    items = seeds.select(F.col("node").alias("id"), F.struct("turn", "node").alias("order"))
    inside = found.join(seeds.select("node"), "node", "left_semi").select(F.col("cid").alias("c"), F.col("node").alias("d")).where("c <> d")
    order = lambda e: items.select(F.col("id").alias(e), F.col("order").alias(f"o_{e}"))
    blocks = inside.join(order("c"), "c").join(order("d"), "d").where("o_c < o_d").select("c", "d")
    kept = egonets.first_come(items, blocks, "order")
    found = cut(found.join(kept.withColumnRenamed("id", "cid"), "cid", "left_semi"))
    shared, one, two = F.col("shared"), F.col("size_c"), F.col("size_d")
    same = egonets.alike(found, alike, shared / (one + two - shared) > alike)
    stay = egonets.first_come(items.join(found.select(F.col("cid").alias("id")).distinct(), "id", "left_semi"), same, "order")
    return found.join(stay.withColumnRenamed("id", "cid"), "cid", "left_semi")


def seed_of(graph: Graph, seed_node) -> DataFrame:
    """(node): the given node if the graph has it, else its smallest."""
    given = graph.nodes.where(F.col("node") == F.lit(seed_node)).select("node") if seed_node is not None else None
    return graph.nodes.agg(F.min("node").alias("node")).where("node is not null") if given is None or given.isEmpty() else given


@register(
    "OSSE", "Overlapping seed set expansion", Param("seed_node", "node", None), Param("ninf", "bool", False), Param("expansion", "enum", "ppr", options=("ppr", "vppr")), Param("stopping", "enum", "cond", options=("cond",), help="the sweep ends at least conductance, the only rule"),
    Param("nworkers", "int", 1, 1, 64, help="has no effect: Spark deals the work"), Param("nruns", "int", 13, 1, 1000, help="rounds of pushes at most, in fives"), Param("alpha", "float", 0.99, 0, 1), Param("delta", "float", 0.2, 0, 1),
    Param("epsilon", "float", 1e-4, 1e-9, 1),
)
def osse(graph: Graph, seed_node=None, ninf=False, expansion="ppr", stopping="cond", nworkers=1, nruns=13, alpha=0.99, delta=0.2, epsilon=1e-4, seeds: DataFrame | None = None) -> DataFrame:
    """Walks from each seed (with ninf from it and its neighbours), scores by degree (vppr: as they are), conductance sweep; of
    communities that differ by delta of the smaller one or less the first seed's stays. seeds(node) gives many seeds at once."""
    starts = cut(seed_of(graph, seed_node) if seeds is None else seeds.select("node").distinct())
    groups = starts.select(F.col("node").alias("seed"), "node")
    if ninf:
        groups = groups.unionByName(starts.join(graph.adj, "node").select(F.col("node").alias("seed"), F.col("nbr").alias("node")))
    scores = pagerank.push(graph, groups, alpha, epsilon, 5 * nruns)
    value = F.col("p") / F.col("degree") if expansion == "ppr" else F.col("p")
    found = pagerank.sweep(graph, scores.join(graph.degrees.select("node", "degree"), "node").where("degree > 0").select("seed", "node", value.alias("score")))
    found = cut(found.select(F.col("seed").alias("cid"), "node"))
    same = egonets.contained(found, 1 - delta).select("c", "d")
    items = found.select(F.col("cid").alias("id")).distinct().withColumn("order", F.col("id"))
    return found.join(egonets.first_come(items, same, "order").withColumnRenamed("id", "cid"), "cid", "left_semi")


@register(
    "NOCD_GNN", "Graph convolutional affiliations", Param("k", "int", 3, 2, 20), Param("features", "enum", "degree", options=("degree", "onehot", "random")), Param("rand_dim", "int", 16, 1, 512), Param("hidden_dim", "int", 64, 1, 1024),
    Param("n_layers", "int", 2, 1, 8), Param("dropout", "float", 0.5, 0, 0.95), Param("lr", "float", 0.01, 0, 1), Param("epochs", "int", 200, 1, 5000), Param("weight_decay", "float", 0.0, 0, 1), Param("overlap_ratio", "float", 0.8, 0, 1),
    Param("neg_ratio", "float", 1.0, 0, 10), Param("device", "enum", "auto", options=("auto", "cpu")), Param("seed", "int", 42),
)
def nocd(graph: Graph, k=3, features="degree", rand_dim=16, hidden_dim=64, n_layers=2, dropout=0.5, lr=0.01, epochs=200, weight_decay=0.0, overlap_ratio=0.8, neg_ratio=1.0, device="auto", seed=42) -> DataFrame:
    return kernel_cover(graph, lambda adj: local.graph_network(adj, k, features, rand_dim, hidden_dim, n_layers, dropout, lr, epochs, weight_decay, overlap_ratio, neg_ratio, seed))


@register(
    "COVER_REFINE", "Cover refinement", Param("init", "enum", "louvain", options=("louvain", "greedy")), Param("seed", "int", 42), Param("max_iter", "int", 10, 1, 100), Param("tau_add", "float", 0.0), Param("tau_remove", "float", 0.0),
    Param("margin", "float", 0.005, 0, 1), Param("lam", "float", 0.01, 0, 1), Param("kmax", "int", 3, 1, 20), Param("neighbours_only", "bool", True), Param("min_links", "int", 1, 0, 100), Param("min_affinity", "float", 0.0, 0, 1),
    Param("calibrate", "bool", False), Param("target", "float", 0.1, 0, 1), Param("tolerance", "float", 0.02, 0, 1), Param("trials", "int", 8, 1, 50), Param("tau_low", "float", -0.05), Param("tau_high", "float", 0.0), Param("trial_iter", "int", 4, 1, 50),
)
def cover_refine(graph: Graph, init: str = "louvain", seed: int = 42, **params) -> DataFrame:
    """Starts from parallel local moving, or greedy modularity."""
    part = moving.louvain(graph, seed) if init == "louvain" else greedy(graph)
    return kernel_cover(graph, lambda adj, parts: local.refine_cover(adj, parts, **params), part)
