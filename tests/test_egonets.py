"""Operators on all ego networks at once against the same rules, one ego and one community after the other."""

import random
from collections import Counter

import pytest

from weft.graph import Graph
from weft.operators import egonets, triangles
from weft.plans import registry
from weft.plans.lineage import cut


def random_graph(seed, n=28, groups=4, inside=0.7, across=0.04):
    r = random.Random(seed)
    adj = {v: set() for v in range(n)}
    for a in range(n):
        for b in range(a):
            if r.random() < (inside if a % groups == b % groups else across):
                adj[a].add(b)
                adj[b].add(a)
    for v in range(0, n, 7):  # a hub
        if v:
            adj[0].add(v)
            adj[v].add(0)
    return adj


def graph_of(spark, adj):
    edges = [(a, b, 1.0) for a in adj for b in adj[a] if a < b]
    g = Graph.from_edges(spark.createDataFrame(edges, "src long, dst long, weight double"), nodes=spark.createDataFrame([(v,) for v in adj], "node long"))
    return Graph(cut(g.nodes), cut(g.edges))


@pytest.fixture(scope="module", params=[1])
def made(spark, request):
    adj = random_graph(request.param)
    return adj, graph_of(spark, adj)


def groups_of(rows):
    out = {}
    for r in rows.select("cid", "node").collect():
        out.setdefault(r.cid, set()).add(r.node)
    return sorted(map(sorted, out.values()))


def inner(adj, nodes):
    return {v: adj[v] & nodes for v in nodes}


def propagated(adj, rounds):
    labels = {v: v for v in adj}
    for _ in range(rounds):
        new = {}
        for v in adj:
            votes = Counter(labels[u] for u in [v, *adj[v]])
            new[v] = min(votes, key=lambda x: (-votes[x], x))
        if new == labels:
            break
        labels = new
    return labels


def parts_of(adj):
    left, out = set(adj), []
    while left:
        found, queue = set(), [min(left)]
        while queue:
            v = queue.pop()
            if v not in found:
                found.add(v)
                queue += adj[v]
        left -= found
        out.append(found)
    return out


def local_communities(adj, find, least):
    """{(ego, label): members} without repeats, of each ego the groups that find makes of its network."""
    out = {}
    for ego in adj:
        for label, s in find(inner(adj, adj[ego])).items():
            if len(s) + 1 >= least:
                out[ego, label] = frozenset(s | {ego})
    return {min(k for k in out if out[k] == s): s for s in set(out.values())}


def by_label(adj, rounds=20):
    out = {}
    for v, x in propagated(adj, rounds).items():
        out.setdefault(x, set()).add(v)
    return out


def brute_merge(coms, share, by_overlap):
    while True:
        host = {}
        for c, s in coms.items():
            able = [d for d, t in coms.items() if (len(t), d) != (len(s), c) and (len(t) > len(s) or len(t) == len(s) and d < c) and len(s & t) >= share * len(s) - 1e-9]
            if able:
                host[c] = min(able, key=lambda d: (*([-len(coms[d] & s)] if by_overlap else []), -len(coms[d]), d))
        if not host:
            return sorted(map(sorted, coms.values()))
        root = {c: c for c in coms}
        for c in coms:
            while root[c] in host:
                root[c] = host[root[c]]
        joined = {}
        for c in coms:
            joined.setdefault(root[c], []).append(c)
        coms = {min(cs): frozenset().union(*(coms[c] for c in cs)) for cs in joined.values()}


def test_triangles_and_common_neighbours(made):
    adj, g = made
    want = {(a, b, c) for a in adj for b in adj[a] for c in adj[a] & adj[b] if a < b < c}
    got = [tuple(sorted(r)) for r in triangles.triangles(g).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    both = {(r.src, r.dst): r.both for r in triangles.common_neighbours(g).collect()}
    assert both == {(a, b): len(adj[a] & adj[b]) for a in adj for b in adj[a] if a < b and adj[a] & adj[b]}
    most = max(Counter(r.a for r in triangles.oriented(g).collect()).values())
    assert most <= (2 * g.edges.count()) ** 0.5


@pytest.mark.parametrize("rounds", [1, 20])
def test_propagation_in_all_egos(made, rounds):
    adj, g = made
    got = {(r.ego, r.node): r.label for r in egonets.propagate(egonets.ego_edges(g), rounds).collect()}
    want = {}
    for ego in adj:
        net = inner(adj, adj[ego])
        want |= {(ego, v): x for v, x in propagated(net, rounds).items() if net[v]}
    assert got == want


@pytest.mark.parametrize(("key", "by_overlap", "least"), [("DEMON", False, 3), ("ANGEL", True, 3)])
def test_demon_and_angel(made, key, by_overlap, least):
    adj, g = made
    params = {"epsilon": 0.3, "min_com_size": least} if key == "DEMON" else {"threshold": 0.3, "min_community_size": least}
    got = groups_of(registry.detect(g, key, **params).membership)
    assert got == brute_merge(local_communities(adj, by_label, least), 0.7, by_overlap)


def test_contained_and_alike_find_all_pairs(spark, made):
    adj, _ = made
    r = random.Random(3)
    coms = {i: frozenset(r.sample(sorted(adj[r.choice(range(28))] | {0}), k=1)) | frozenset(r.sample(range(24), r.randint(1, 12))) for i in range(50)}
    rows = spark.createDataFrame([(c, v) for c, s in coms.items() for v in s], "cid long, node long")
    for share in (0.3, 0.75):
        got = {(x.c, x.d, x.shared) for x in egonets.contained(rows, share).collect()}
        want = {(c, d, len(s & t)) for c, s in coms.items() for d, t in coms.items() if c != d and (len(t) > len(s) or len(t) == len(s) and d < c) and len(s & t) >= share * len(s) - 1e-9}
        assert got == want
        from pyspark.sql import functions as F

        jaccard = F.col("shared") / (F.col("size_c") + F.col("size_d") - F.col("shared"))
        got = {(x.c, x.d) for x in egonets.alike(rows, share, jaccard >= share).collect()}
        assert got == {(c, d) for c, s in coms.items() for d, t in coms.items() if c < d and len(s & t) / len(s | t) >= share}


def test_first_come(spark):
    r = random.Random(5)
    order = {i: r.random() for i in range(80)}
    pairs = {tuple(sorted(r.sample(range(80), 2))) for _ in range(150)}
    stay = set()
    for i in sorted(order, key=order.get):
        if not any((min(i, j), max(i, j)) in pairs for j in stay):
            stay.add(i)
    items = spark.createDataFrame(list(order.items()), "id long, at double")
    got = egonets.first_come(items, spark.createDataFrame(list(pairs), "c long, d long"), "at")
    assert {x.id for x in got.collect()} == stay


def test_node_perception(made):
    adj, g = made
    find = lambda net: {min(s): s for s in parts_of(net)}
    subs = local_communities(adj, find, 2)
    for t, o in ((0.4, 0.5),):
        links = {c: {d for d in subs if d != c and len(subs[c] & subs[d]) / len(subs[c] | subs[d]) >= t and len(subs[c] & subs[d]) / min(len(subs[c]), len(subs[d])) >= o} for c in subs}
        joined = {}
        for c, x in propagated(links, 20).items():
            joined.setdefault(x, set()).update(subs[c])
        assert groups_of(registry.detect(g, "NODEP", threshold=t, overlap_threshold=o).membership) == sorted(map(sorted, joined.values()))


def brute_cores(adj, least):
    out = {}
    for ego in adj:
        net = inner(adj, adj[ego] | {ego})
        average = sum(map(len, net.values())) / len(net)
        for part in parts_of(inner(net, {v for v in net if len(net[v]) >= average})):
            first = min(part)
            while len(part) > 2:
                degree = {v: len(net[v] & part) for v in part}
                density = sum(degree.values()) / (len(part) * (len(part) - 1))
                if density >= least:
                    out[ego, first] = (frozenset(part), density)
                    break
                part = {v for v in part if degree[v] > min(degree.values())}
    return out


def test_cores_of_all_neighbourhoods(made):
    adj, g = made
    for least in (0.7,):
        got = {}
        for r in egonets.dense_cores(g, least).collect():
            got.setdefault((r.cid.ego, r.cid.label), (set(), r.density))[0].add(r.node)
        want = brute_cores(adj, least)
        assert {k: (frozenset(s), pytest.approx(d)) for k, (s, d) in got.items()} == want and want


def test_coach(made):
    adj, g = made
    cores = brute_cores(adj, 0.7)
    kept = {}
    for s in {s for s, _ in cores.values()}:
        kept[min(k for k in cores if cores[k][0] == s)] = s
    stay = []
    for k in sorted(kept, key=lambda k: (-round(cores[k][1] * len(kept[k]), 9), k)):
        if all(len(kept[k] & s) ** 2 / (len(kept[k]) * len(s)) < 0.225 for s in stay):
            stay.append(kept[k])
    want = [s | {u for u in adj if len(adj[u] & s) / len(s) >= 0.5} for s in stay]
    assert groups_of(registry.detect(g, "COACH").membership) == sorted(map(sorted, want))


@pytest.mark.parametrize("key", ["DEMON", "COACH"])
def test_planted_groups_are_found_and_nothing_is_no_error(spark, key):
    adj = random_graph(9, 24, 3, 0.9, 0.0)
    found = groups_of(registry.detect(graph_of(spark, adj), key).membership)
    truth = [{v for v in adj if v % 3 == k} for k in range(3)]
    assert all(max(len(t & set(s)) / len(t | set(s)) for s in found) >= 0.8 for t in truth)
    empty = Graph(spark.createDataFrame([(1,)], "node long"), spark.createDataFrame([], "src long, dst long, weight double"))
    assert groups_of(registry.detect(empty, key).membership) == []
