"""Blocks of sources over several chunks and components, restricted ends, walks, and pairs of shared keys, on small cases."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_egonets import graph_of, random_graph
from weft import catalog
from weft import graph as graphs
from weft.operators import blocks, centrality
from weft.operators.paths import dependencies, scoped, shortest_paths
from weft.plans import detect, kernels
from weft.plans.lineage import cut


def apart(copies):
    """Copies of a random graph side by side, nodes of one between those of the others."""
    one = random_graph(3, 14, 2, 0.5, 0.1)
    return {v * copies + i: {u * copies + i for u in near} for i in range(copies) for v, near in one.items()}


def test_a_batch_counts_the_pairs_that_can_meet(spark):
    g = graph_of(spark, apart(3))
    laid = blocks.layout(g.adj.select("node", "nbr"), g.nodes)
    largest = laid.places.groupBy("component").count().agg(F.max("count")).first()[0]
    assert largest <= 14 and len(blocks.batches(laid, blocks.in_blocks(laid, blocks.whole(g.nodes)), pairs=3 * 14 * 14)) == 1


def test_restricted_ends(spark):
    g = graph_of(spark, apart(2))
    m = g.nodes.select((F.col("node") % 3).alias("scope"), "node")
    adj = scoped(g)
    paths = shortest_paths(adj, m.select(F.lit(0).alias("scope"), F.col("node").alias("source"))).drop("scope").join(m.withColumnRenamed("node", "source"), "source").select("scope", "source", "node", "d", "sigma")
    want = {(r.scope, r.node): r.x for r in dependencies(g.adj.select("node", "nbr"), paths, m).groupBy("scope", "node").agg(F.sum("delta").alias("x")).collect() if r.x}
    got = {(r.scope, r.node): r.delta for r in blocks.path_sums(blocks.layout(g.adj.select("node", "nbr"), g.nodes), m, targets=m).collect() if r.delta}
    assert got == pytest.approx(want)


def test_closed_walks(spark):
    adj = apart(2)
    g = graph_of(spark, adj)
    at = {v: i for i, v in enumerate(sorted(adj))}
    a = np.zeros((len(at), len(at)))
    for v, near in adj.items():
        for u in near:
            a[at[v], at[u]] = 1
    value, vector = np.linalg.eigh(a)
    want = np.diag((vector * np.exp(value)) @ vector.T)
    got = {r.node: r.value for r in blocks.closed_walks(blocks.layout(g.adj.select("node", "nbr"), g.nodes), g.nodes).collect()}
    assert got == pytest.approx({v: want[i] for v, i in at.items() if v in got}) and len(got) == g.nodes.count()


def test_subgraph_centrality_by_components(spark, monkeypatch):
    adj = apart(2)
    g = graph_of(spark, adj)
    n = g.nodes.count()
    sizes = sorted((r["size"] for r in g.component_sizes().collect()), reverse=True)
    walked, walks = [], blocks.closed_walks
    monkeypatch.setattr(blocks, "closed_walks", lambda laid, nodes: walked.append(nodes.count()) or walks(laid, nodes))
    want = {r.node: r.subgraph for r in centrality.spectral(g, "subgraph", n).collect()}
    for most in (sizes[0], sizes[0] - 1):
        assert {r.node: r.subgraph for r in centrality.spectral(g, "subgraph", most).collect()} == pytest.approx(want)
    assert walked == [sum(s for s in sizes if s == sizes[0])]  # of a graph above the limit only components above it


def test_closed_walks_of_a_tail():
    n = 40  # a dense core with a tail, whose end has few closed walks
    a = np.zeros((n, n))
    a[:30, :30] = 1 - np.eye(30)
    for i in range(29, n - 1):
        a[i, i + 1] = a[i + 1, i] = 1
    term, want = [[int(i == j) for j in range(n)] for i in range(n)], [Fraction(0)] * n
    near = [[j for j in range(n) if a[i, j]] for i in range(n)]
    for k in range(160):
        want = [w + Fraction(term[i][i], math.factorial(k)) for i, w in enumerate(want)]
        term = [[sum(row[j] for j in near[i]) for i in range(n)] for row in term]
    assert centrality._closed_walks(a) == pytest.approx([float(w) for w in want], rel=1e-9)
    assert centrality._closed_walks(np.zeros((1, 1))).tolist() == [1.0]


def test_neighbour_sums(spark):
    adj = apart(2)
    g = graph_of(spark, adj)
    of = {(c, v): (v * 7919 + c * 31) % 1_000_000_007 - 500_000_000 for c in range(300) for v in adj if (v + c) % 3}
    rows = cut(spark.createDataFrame([(c, v, x, x % 5, f"{c} {v}") for (c, v), x in of.items()], "seed long, node long, a long, b long, name string"))
    got = blocks.neighbour_sums(blocks.layout(g.adj.select("node", "nbr"), g.nodes), rows, {"x": "a", "y": "b", "z": "a"}).collect()
    sums = {(c, v): sum(of.get((c, u), 0) for u in adj[v]) for c, v in of}
    assert {(r.seed, r.node): (r.x, r.z, r.name) for r in got} == {(c, v): (x, x, f"{c} {v}") for (c, v), x in sums.items()} and len(got) == len(of)
    assert {(r.seed, r.node): r.y for r in got} == {(c, v): sum(of.get((c, u), 0) % 5 for u in adj[v]) for c, v in of}


def test_greedy_by_components(spark):
    adj = apart(3)
    g = graph_of(spark, adj)
    weighted = {v: {} for v in sorted(r.node for r in g.nodes.collect())}
    for r in g.edges.collect():
        weighted[r.src][r.dst] = weighted[r.dst][r.src] = r.weight
    got = {}
    for r in detect.greedy(g).collect():
        got.setdefault(r.cid, set()).add(r.node)
    assert [got[i] for i in range(len(got))] == kernels.greedy_modularity(weighted)


def test_shared_pairs_in_more_partitions(spark, monkeypatch):
    monkeypatch.setattr(graphs, "TASK_ROWS", 10)
    rows = spark.createDataFrame([(k, n) for n in range(12) for k in range(9) if (n * 5 + k) % 4 == 0] + [(1, 3)] * 3, "k long, n long")
    made = graphs.shared_pairs(rows, "k", "n")
    keys = {n: {r.k for r in rows.collect() if r.n == n} for n in range(12)}
    want = {(a, b): float(len(keys[a] & keys[b])) for a in keys for b in keys if a < b and keys[a] & keys[b]}
    assert {(r.src, r.dst): r.weight for r in made.collect()} == want and made.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_communities_of_parts_in_more_partitions(spark, monkeypatch, tmp_path, broadcast):
    rows = [(p, f"brand {p % 3}", None if p == 4 else f"type {p % 5}") for p in range(60)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    g = graph_of(spark, {v: {v ^ 2} for v in range(0, 64) if v % 2 == 0})  # 60 and 62 are no parts
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(graphs, "TASK_ROWS", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        crisp, both = (f(spark, str(tmp_path), g) for f in (catalog.brands, catalog.brands_and_types))
        assert sorted((r.cid, r.node) for r in crisp.collect()) == sorted((b, p) for p, b, _ in rows if p % 2 == 0)
        assert sorted((r.cid or "", r.node) for r in both.collect()) == sorted((c or "", p) for p, *of in rows for c in of if p % 2 == 0)
        assert crisp.rdd.getNumPartitions() == both.rdd.getNumPartitions() == 6
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_only_nodes_of_the_graph_meet_the_edges(spark):
    g = graph_of(spark, {v: {v + 1} for v in range(20)})
    g = graphs.Graph(cut(g.nodes), cut(g.edges))
    keep = spark.range(10, 5000).selectExpr("if(id = 4999, null, id) AS node")
    sub = g.subgraph(keep.unionByName(keep))
    assert sorted((r.src, r.dst) for r in sub.edges.collect()) == [(v, v + 1) for v in range(10, 20)] and sorted(r.node for r in sub.nodes.collect()) == list(range(10, 21))
    plan = sub.edges._jdf.queryExecution().executedPlan()
    while "Join" not in plan.nodeName():
        plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.plan() if "QueryStage" in plan.nodeName() else plan.children().apply(0)
    plan = plan.right()
    while "BroadcastExchange" not in plan.nodeName():
        plan = plan.plan() if "QueryStage" in plan.nodeName() else plan.child()
    assert plan.metrics().get("numOutputRows").get().value() == 11
