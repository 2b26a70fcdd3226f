"""Paths, walks and sums inside bundles of components against blocks of sources and chunks of nodes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_blocks_pieces import apart
from tests.test_egonets import graph_of, random_graph
from weft import graph as graphs
from weft.operators import blocks, bundles, centrality
from weft.plans.lineage import cut


@pytest.fixture(scope="module")
def both(spark):
    """A graph of a hub, a tail, small components and one of more than a chunk, and its layout for bundles, for chunks, and for some of each."""
    adj = random_graph(5, blocks.CHUNK + 90, 4, 0.02, 0.004)
    n = len(adj)
    for v in range(1, n, 2):
        adj[0].add(v), adj[v].add(0)
    for v in range(n, n + 3):  # a tail
        adj[v] = {v - 1}
        adj[v - 1].add(v)
    for v, near in apart(3).items():
        adj[v + 5_000] = {u + 5_000 for u in near}
    adj[9_999] = set()
    g = graph_of(spark, adj)
    g = graphs.Graph(cut(g.nodes), cut(g.edges))
    out = []
    with pytest.MonkeyPatch.context() as patch:
        for nodes in (bundles.HELD_NODES, -1, 100):
            patch.setattr(bundles, "HELD_NODES", nodes)
            patch.setattr(bundles, "BUNDLE", 1 if nodes == 100 else 1_024)
            out.append(blocks.layout(g.adj.select("node", "nbr"), g.nodes))
    held = [x.held.count() for x in out]
    assert held[0] == g.nodes.count() and held[1] == 0 < held[2] < held[0] and [x.large for x in out] == [False, True, True]
    return g, out


@pytest.mark.parametrize("how", ["flow", "load", "closeness", "ends"])
def test_paths(both, how, monkeypatch):
    monkeypatch.setattr(bundles, "COST", 40_000)
    g, laid = both
    m = g.nodes.select((F.col("node") % 3).alias("scope"), "node") if how == "ends" else blocks.whole(g.nodes)
    got = []
    for x in laid:
        sums = blocks.path_sums(x, m, flow=how != "closeness", load=how == "load", targets=m if how == "ends" else None)
        got.append({(r.scope, r.node): (r.r, r.total, r.inverse, r.delta) for r in sums.collect()})
    for other in got[1:]:
        assert got[0].keys() == other.keys()
        for k, v in got[0].items():
            assert v == pytest.approx(other[k], rel=1e-9, abs=1e-9)


def test_walks(both):
    g, laid = both
    adj = np.zeros((10_000, 10_000), bool)
    for r in g.edges.collect():
        adj[r.src, r.dst] = adj[r.dst, r.src] = True
    some = np.array(sorted(r.node for r in g.nodes.collect()))
    want = dict(zip(some.tolist(), centrality._closed_walks(adj[np.ix_(some, some)].astype(float)).tolist(), strict=True))
    assert {r.node: r.value for r in blocks.closed_walks(laid[0], g.nodes).collect()} == pytest.approx(want, rel=1e-9)


def test_sums(both, spark, monkeypatch):
    monkeypatch.setattr(bundles, "ROWS", 700)
    g, laid = both
    rows = cut(g.nodes.crossJoin(spark.range(40).withColumnRenamed("id", "seed")).where("(node + seed) % 3 > 0").selectExpr("seed", "node", "(node * 7919 + seed * 31) % 1000003 - 500000 AS a", "seed % 5 AS b"))
    got = [sorted(tuple(r) for r in blocks.neighbour_sums(x, rows, {"x": "a", "y": "b", "z": "a"}).select("seed", "node", "x", "y", "z").collect()) for x in laid]
    assert len(got[0]) == rows.count() and got[0] == got[1] == got[2]


def test_a_group_gets_a_bounded_share_of_the_sources(both, monkeypatch):
    monkeypatch.setattr(bundles, "COST", 200_000)
    g, laid = both
    rows = bundles.dealt(blocks.whole(g.nodes).join(laid[0].held.drop("place"), "node").drop("node"))
    per = rows.groupBy(*bundles.KEYS).agg(F.count(F.lit(1)).alias("many"), F.max("edges").alias("edges")).collect()
    assert len(per) > 3 and all(r.many <= max(bundles.WIDEST, bundles.COST // r.edges) for r in per)


def test_lists_and_single_values_give_the_same_sums():
    rng = np.random.default_rng(1)
    near = np.triu(rng.random((60, 60)) < 0.2, 1)
    near[0, 1:] = True  # a node of many neighbours
    near |= near.T
    src, dst = np.nonzero(near)
    adj = bundles.Adjacency(pd.DataFrame({"chunk": [0, 0], "src": [x.astype(np.int16).tobytes() for x in (src[::2], src[1::2])], "dst": [x.astype(np.int32).tobytes() for x in (dst[::2], dst[1::2])]}), 0, 60, 512)
    x, to, few = rng.random((60, 9)), np.arange(5, 40), np.array([3, 7])
    assert np.allclose(adj.sums(x, np.arange(60)), near @ x)
    x[:] = 0
    x[3, 2], x[7, 4] = 2, 3
    assert np.allclose(adj.spread(x[few], few, to), (near @ x)[to]) and adj.spread(rng.random((60, 9)), np.arange(60), to) is None


def test_sources_of_walks_and_of_cheap_paths_are_shared_out(both):
    g, laid = both
    rows = blocks.whole(g.nodes).join(laid[0].held.drop("place"), "node").drop("node")
    for cost in (None, bundles.COST // bundles.STEPS):
        assert bundles.dealt(rows, cost).groupBy(*bundles.KEYS).count().agg(F.max("count")).first()[0] == bundles.WIDEST
