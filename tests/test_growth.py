"""Communities grown from all seeds at once, and parts divided at once, against their rules done one seed and one part after the other."""

import math

import pytest

from tests.test_egonets import graph_of, groups_of, propagated, random_graph
from tests.test_graph_rounds import staying
from weft.graph import Graph
from weft.operators import growth
from weft.plans import registry
from weft.plans.lineage import cut


@pytest.fixture(scope="module", params=[2])
def made(spark, request):
    adj = random_graph(request.param, 20, 3, 0.6, 0.06)
    adj[20] = set()  # alone
    return adj, graph_of(spark, adj)


def shared(adj, v):
    return sum(len(adj[v] & adj[u]) for u in adj[v])


def around(adj, s):
    return {u for v in s for u in adj[v]} - s


def sorted_groups(found):
    return sorted(map(sorted, found))


def dense_clusters(adj, least, share):
    """Clusters one after the other in a graph that they leave; the order is made anew once no cluster of a pass is left."""

    def grown(left, seed):
        s = {seed}
        while True:
            n, inner = len(s), sum(u in s for v in s for u in left[v])
            able = []
            for u in around(left, s):
                links = len(left[u] & s)
                if (inner + 2 * links) / (n * (n + 1)) >= least and (not inner or links * (n - 1) >= share * inner):
                    able.append((-links, u))
            if not able:
                return s
            s.add(min(able)[1])

    left, cores = {v: set(n) for v, n in adj.items()}, []
    while any(left.values()):
        begun = {v: set(n) for v, n in left.items()}
        for seed in sorted((v for v in begun if begun[v]), key=lambda v: (-shared(begun, v), -len(begun[v]), v)):
            if seed in left and (s := grown(begun, seed)) <= set(left):
                assert s == grown(left, seed)  # as if those before it had left
                cores.append(s)
                left = {v: n - s for v, n in left.items() if v not in s}
    return [s | {u for u in around(adj, s) if len(s) > 2 and len(adj[u] & s) >= least * len(s)} for s in cores]


@pytest.mark.parametrize("least", [0.6])
def test_density(made, least):
    adj, g = made
    found = registry.detect(g, "DPCLUS", d_threshold=least).membership
    assert groups_of(found) == sorted_groups(dense_clusters(adj, least, 0.5))


@pytest.mark.parametrize("least", [0.4])
def test_interaction(made, least):
    adj, g = made

    def close(s, u):
        one = adj[u] & s
        return s <= one | {x for v in one for x in adj[v]} | {u}

    grown = {}
    for seed in adj:
        s = {seed}
        while able := [(-len(adj[u] & s), -shared(adj, u), u) for u in around(adj, s) if len(adj[u] & s) / len(s) >= least and close(s, u)]:
            s.add(min(able)[2])
        grown[seed] = s
    want = [s for s in staying(adj, grown, lambda v: (-shared(adj, v), v)).values() if len(s) > 1]
    assert groups_of(registry.detect(g, "IPCA", t_in=least).membership) == sorted_groups(want)


def entropy(adj, s, weight=None):
    """Of the shares of all nodes' edges in s, in billionths of a bit."""
    total = 0
    for v in adj:
        w = {u: weight[min(u, v), max(u, v)] if weight else 1 for u in adj[v]}
        p = sum(x for u, x in w.items() if u in s) / sum(w.values()) if w else 0
        if 0 < p < 1:
            total += round((-p * math.log2(p) - (1 - p) * math.log2(1 - p)) * 1e9)
    return total


def steepest(adj, s, seed, weight=None):
    for leaving in (True, False):
        while True:
            able = [(entropy(adj, s ^ {u}, weight) - entropy(adj, s, weight), u) for u in (s - {seed} if leaving else around(adj, s))]
            if not able or min(able)[0] >= 0:
                break
            s = s ^ {min(able)[1]}
    return s


def test_entropy_of_neighbourhoods(made):
    adj, g = made
    grown = {v: steepest(adj, {v, *adj[v]}, v) for v in adj}
    want = [s for s in staying(adj, grown, lambda v: (-len(adj[v]), v)).values() if len(s) > 1]
    assert groups_of(registry.detect(g, "GRAPH_ENT").membership) == sorted_groups(want)


def test_weighted_entropy(spark):
    adj = random_graph(5, 12, 3, 0.7, 0.1)
    weight = {(a, b): float(2 ** ((a * b) % 4)) for a in adj for b in adj[a] if a < b}
    g = Graph.from_edges(spark.createDataFrame([(*e, w) for e, w in weight.items()], "src long, dst long, weight double"), nodes=spark.createDataFrame([(v,) for v in adj], "node long"))
    g = Graph(cut(g.nodes), cut(g.edges))
    grown = {v: steepest(adj, {v, *adj[v]}, v, weight) for v in adj}
    want = [s for s in staying(adj, grown, lambda v: (-len(adj[v]), v)).values() if len(s) > 1]
    assert groups_of(registry.detect(g, "GRAPH_ENT", use_weights=True).membership) == sorted_groups(want)


def test_changes_of_entropy(spark, made):
    adj, g = made
    sets = {0: {0, 3, 6}, 1: {1}, 2: {v for v in adj if adj[v]}}
    rows, own = growth.surroundings(g, spark.createDataFrame([(c, v) for c, s in sets.items() for v in s], "seed long, node long"))
    got = {(r.seed, r.node): r.change for r in growth.entropy_changes(g, rows.join(own, "seed")).collect()}
    assert got == {(c, v): entropy(adj, s ^ {v}) - entropy(adj, s) for c, s in sets.items() for v in s | around(adj, s)}


def test_entropy_from_pairs(made):
    adj, g = made
    grown = {}
    for seed in adj:
        if not adj[seed]:
            continue
        s = {seed, min(adj[seed], key=lambda u: (-len(adj[seed] & adj[u]), u))}
        while able := [(-len(adj[u] & s) / len(adj[u]), u) for u in around(adj, s) if entropy(adj, s | {u}) < entropy(adj, s)]:
            s.add(min(able)[1])
        grown[seed] = s
    want = staying({v: adj[v] for v in grown}, grown, lambda v: (-shared(adj, v), -len(adj[v]), v))
    assert groups_of(registry.detect(g, "EBGC").membership) == sorted_groups(want.values())


@pytest.mark.parametrize("most", [3])
def test_division(made, most):
    adj, g = made
    parts, queue = [], []
    left = set(adj)
    while left:
        s, front = set(), {min(left)}
        while front:
            s |= front
            front = around(adj, s)
        left -= s
        queue.append(s)
    while queue:
        s = queue.pop()
        labels = propagated({v: adj[v] & s for v in s if adj[v] & s}, 50)
        found = {}
        for v in s:
            found.setdefault(labels.get(v, v), set()).add(v)
        if len(s) <= most or len(found) == 1:
            parts.append(s)
        else:
            queue += found.values()
    assert sorted(v for s in parts for v in s) == sorted(adj)
    want = [s | {v for v in around(adj, s) if 2 * len(adj[v] & s) >= len(adj[v])} for s in parts]
    assert groups_of(registry.detect(g, "DCS", most=most).membership) == sorted_groups(want)


@pytest.mark.parametrize("key", ["DPCLUS", "IPCA", "EBGC", "GRAPH_ENT", "DCS"])
def test_graph_without_edges(spark, key):
    g = Graph(spark.createDataFrame([(1,), (2,)], "node long"), spark.createDataFrame([], "src long, dst long, weight double"))
    found = groups_of(registry.detect(g, key).membership)
    assert found == ([[1], [2]] if key == "DCS" else [])
