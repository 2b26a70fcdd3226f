"""All detectors on a small graph: they run, cover known nodes, and are reproducible."""

import pytest

from weft.graph import Graph
from weft.operators import cover, metrics
from weft.plans import registry, runner
from weft.plans.lineage import cut
from weft.sources.ingest import default_graph

KEYS = [d.key for d in registry.detectors()]


@pytest.fixture(scope="module")
def toy(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "e"), ("d", "f"), ("e", "f")]
    g = Graph.from_edges(spark.createDataFrame([(*e, 1.0) for e in edges], "src string, dst string, weight double"))
    return Graph(cut(g.nodes), cut(g.edges))


def groups(membership):
    out = {}
    for r in membership.collect():
        out.setdefault(r.cid, set()).add(r.node)
    return sorted(map(sorted, out.values()))


def test_registry():
    assert len(KEYS) == 30
    with pytest.raises(KeyError):
        registry.detector("NONE")
    with pytest.raises(ValueError, match="no parameter"):
        registry.detector("COBS").bind({"x": 1})
    with pytest.raises(ValueError):
        registry.detector("COBS").bind({"sim_metric": "nonsense"})


@pytest.mark.parametrize("key", KEYS)
def test_detector_runs(toy, key):
    small = {"SLPA": {"t": 10}, "NOCD_GNN": {"epochs": 20, "k": 2}, "LPANNI": {"rounds": 3}}.get(key, {})
    found = groups(registry.detect(toy, key, **small).membership)
    assert all(set(s) <= set("abcdef") for s in found)
    if key not in ("WALKSCAN",):
        assert found


def test_known_results(toy):
    two = [["a", "b", "c"], ["d", "e", "f"]]
    assert groups(registry.detect(toy, "GREEDY_MODULARITY").membership) == two
    assert groups(registry.detect(toy, "COBS").membership) == two
    assert groups(registry.detect(toy, "COBS", theta_sim=0.25, theta_overlap=0.6).membership) == [["a", "b", "c", "d"], ["c", "d", "e", "f"]]
    assert groups(registry.detect(toy, "COBS", theta_sim=0.25, theta_overlap=0.3).membership) == [list("abcdef")]
    assert groups(registry.detect(toy, "KCLIQUE").membership) == two
    assert groups(registry.detect(toy, "CN_OCD").membership) == two
    assert len(groups(registry.detect(toy, "EGONET").membership)) == 6
    assert groups(registry.detect(toy, "COVER_REFINE").membership) == two


def test_karate(spark):
    g = default_graph(spark)
    assert (g.nodes.count(), g.edges.count()) == (34, 78)
    part = registry.detect(g, "GREEDY_MODULARITY").membership
    q = metrics.modularity(g, part).first().modularity
    assert 0.37 < q < 0.43
    assert cover.is_crisp(part)


def test_runner(toy, tmp_path):
    runs, members = runner.run_all(toy, include=("GREEDY_MODULARITY", "EGONET"), seconds=120)
    rows = {r.algo_key: r for r in runs.collect()}
    assert rows["GREEDY_MODULARITY"].status == "ok" and abs(rows["GREEDY_MODULARITY"].modularity - 0.357143) < 1e-6
    assert rows["EGONET"].n_communities_raw == 6
    runner.export(toy, runs, members, f"file://{tmp_path}", "my set")
    assert (tmp_path / "my_set" / "summary").exists()


def test_kernels_are_whole():
    import random

    import numpy as np

    from weft.plans import kernels

    r = random.Random(2)
    adj = {v: {} for v in range(40)}
    for _ in range(260):
        a, b = r.sample(range(40), 2)
        if a // 10 == b // 10 or r.random() < 0.1:
            adj[a][b] = adj[b][a] = 1.0
    few, many = (kernels.graph_network(adj, 4, "onehot", neg_ratio=x) for x in (0.1, 10.0))
    assert few == many  # no sample of non-edges
    present = {(a, b) for a in range(30) for b in range(30) if (a + b) % 8}
    a, b = kernels.non_edges(30, present, 200, np.random.default_rng(1))
    assert len(a) == 200 and all(x != y and (x, y) not in present for x, y in zip(a.tolist(), b.tolist(), strict=True))


def test_multicom_starts_from_every_neighbour_that_no_community_holds(spark):
    from tests.test_egonets import graph_of

    hub: dict = {}

    def link(x, y):
        hub.setdefault(x, set()).add(y)
        hub.setdefault(y, set()).add(x)

    bounds = [0, 12, *range(20, 53, 8), 92]  # the seed's clique, some beside it, and one that holds those
    for a, b in zip(bounds, bounds[1:], strict=False):
        for x in range(a, b):
            for y in range(a, x):
                link(x, y)
    for a in bounds[1:-2]:
        link(0, a)
        for j in range(1, 7):
            link(a + j, bounds[-2] + j)
    found = groups(registry.detect(graph_of(spark, hub), "MULTICOM", seed_node=0).membership)
    assert len(found) >= 4 and all(any(u in c for c in found) for u in hub[0])


def test_stats_of_the_flagship(toy):
    found = registry.detect(toy, "COBS", stats=True, theta_sim=0.25, theta_overlap=0.6)
    assert found.stats == {"final_k": 2, "overlap_nodes": 2, "membership_count_dist": {1: 4, 2: 2}, "crisp_k": 2, "crisp_modularity": pytest.approx(0.357143, abs=1e-6), "boundary_nodes": 2}
    assert registry.detect(toy, "EGONET", stats=True).stats["final_k"] == 6


def planted(groups: int, size: int, inside: float, across: float, seed: int):
    import random

    r, n = random.Random(seed), groups * size
    adj = {v: {} for v in range(n)}
    for a in range(n):
        for b in range(a):
            if r.random() < (inside if a // size == b // size else across):
                adj[a][b] = adj[b][a] = 1.0
    return adj, [set(range(i * size, (i + 1) * size)) for i in range(groups)]


def test_greedy_modularity_against_brute_force():
    import random

    from weft.plans import kernels

    for seed in range(20):
        r = random.Random(seed)
        adj = {v: {} for v in range(9)}
        for a in range(9):
            for b in range(a):
                if r.random() < 0.4:
                    adj[a][b] = adj[b][a] = r.uniform(0.1, 2.0)  # no ties
        parts = [{v} for v in adj]
        while len(parts) > 1:  # every pair of linked communities, by modularity itself
            now = kernels.modularity(adj, parts)
            linked = [(i, j) for i in range(len(parts)) for j in range(i) if any(u in parts[j] for v in parts[i] for u in adj[v])]
            tried = {(i, j): kernels.modularity(adj, [s for k, s in enumerate(parts) if k not in (i, j)] + [parts[i] | parts[j]]) for i, j in linked}
            if not tried or max(tried.values()) < now:
                break
            i, j = max(tried, key=tried.get)
            parts = [s for k, s in enumerate(parts) if k not in (i, j)] + [parts[i] | parts[j]]
        assert sorted(map(sorted, kernels.greedy_modularity(adj))) == sorted(map(sorted, parts))


def test_dismantling():
    import random

    from weft.plans import kernels

    adj, truth = planted(4, 12, 0.5, 0.05, 3)
    parts = [*truth[:3], *({v} for v in truth[3])]
    for seed in range(30):
        out = kernels.dismantled(adj, parts, random.Random(seed))
        assert sorted(v for s in out for v in s) == sorted(adj)
        assert sum(s not in out for s in parts) == 1 and all(s in out for s in parts[3:])  # single nodes are not taken apart
    alone = [{v} for v in adj]
    assert kernels.dismantled(adj, alone, random.Random(0)) == alone
    start = kernels.modularity(adj, kernels.greedy_modularity(adj))
    best, history = kernels.dismantle_greedy(adj, p=2, exploration=0.5, seed=1, double_cross=True)
    assert [h[0] for h in history] == list(range(2 * len(adj)))
    assert all(x[2] <= y[2] for x, y in zip(history, history[1:], strict=False)) and history[-1][2] == kernels.modularity(adj, best) >= start
    assert kernels.dismantle_greedy(adj, p=2, exploration=0.5, seed=1, double_cross=True)[0] == best


@pytest.mark.parametrize("name", ["GREEDY_MODULARITY", "DGM_CRISP"])
def test_planted_groups_are_found(name):
    from weft.plans import kernels

    adj, truth = planted(4, 16, 0.6, 0.02, 5)
    found = {
        "GREEDY_MODULARITY": lambda: kernels.greedy_modularity(adj), "DGM_CRISP": lambda: kernels.dismantle_greedy(adj, p=1, double_cross=True)[0],
    }[name]()
    best = [max(len(t & s) / len(t | s) for s in found) for t in truth]
    assert min(best) >= 0.9
