"""Local moving, spanning forests, pushes, sweeps and the detectors on them against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tests.test_egonets import graph_of, groups_of, random_graph
from weft.graph import Graph
from weft.operators import metrics, moving, pagerank, spanning
from weft.plans import registry


@pytest.fixture(scope="module")
def made(spark):
    adj = random_graph(4, 28)
    return adj, graph_of(spark, adj)


def modularity(adj, of):
    m2 = sum(map(len, adj.values()))
    degrees = {}
    for v in adj:
        degrees[of[v]] = degrees.get(of[v], 0) + len(adj[v])
    return sum(of[u] == of[v] for v in adj for u in adj[v]) / m2 - sum(k * k for k in degrees.values()) / m2**2


def test_gains_are_changes_of_modularity(spark, made):
    adj, g = made
    of = {v: v % 5 for v in adj}
    state = spark.createDataFrame([(v, c, float(len(adj[v]))) for v, c in of.items()], "node long, cid long, strength double")
    got = {(r.node, r.to): r.gain for r in moving.gains(g.adj, state, float(sum(map(len, adj.values())))).collect()}
    want = {(v, of[u]): modularity(adj, of | {v: of[u]}) - modularity(adj, of) for v in adj for u in adj[v] if of[u] != of[v]}
    assert got == pytest.approx(want)


def test_local_moving_never_falls_and_finds_what_is_planted(spark, made):
    adj, g = made
    part, history = moving.louvain_levels(g)
    steps = list(itertools.chain(*history))
    assert all(a <= b for a, b in itertools.pairwise(steps))
    of = {r.node: r.cid for r in part.collect()}
    assert modularity(adj, of) == pytest.approx(steps[-1]) == pytest.approx(metrics.modularity(g, part).first()[0])
    from tests.sequential import louvain

    parts = louvain({v: dict.fromkeys(n, 1.0) for v, n in adj.items()})
    assert steps[-1] >= 0.98 * modularity(adj, {v: i for i, s in enumerate(parts) for v in s})
    truth = [{v for v in adj if v % 4 == k} for k in range(4)]
    assert all(max(len(t & set(s)) / len(t | set(s)) for s in groups_of(part)) >= 0.7 for t in truth)


def linked(edges, a, b):
    """Whether edges join a and b."""
    found, queue = {a}, [a]
    while queue:
        v = queue.pop()
        for x, y in edges:
            for u, w in ((x, y), (y, x)):
                if u == v and w not in found:
                    found.add(w)
                    queue.append(w)
    return b in found


@pytest.mark.parametrize("values", [3, 10**6])
def test_union_of_spanning_forests(spark, values):
    r = random.Random(values)
    edges = {(a, b): float(r.randint(1, values)) for a in range(24) for b in range(a + 1, 24) if r.random() < 0.25}
    rows = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight double")
    got = {(x.src, x.dst) for x in spanning.spanning_union(rows).collect()}
    assert got == {e for e, w in edges.items() if not linked([f for f, x in edges.items() if x > w], *e)}
    found, rounds = spanning.boruvka(rows)
    assert found.count() == len(edges) and len(rounds) <= 5
    assert len({x.fragment for x in rounds[-1].collect()}) == len({min(v for v in range(24) if linked(edges, u, v)) for e in edges for u in e})


def test_umstmo_overlaps_at_ties(spark):
    two = [(1, 2), (1, 3), (2, 3), (3, 4), (3, 5), (4, 5)]  # a node in the middle of two triangles
    g = Graph.from_edges(spark.createDataFrame([(*e, 1.0) for e in two], "src long, dst long, weight double"))
    found = groups_of(registry.detect(g, "UMSTMO").membership)
    assert found == [[1, 2, 3], [3, 4, 5]]


def exact_scores(adj, seeds, alpha):
    """Stationary scores of walks that start at the seeds again with probability 1 - alpha."""
    start = {v: (1 / len(seeds) if v in seeds else 0.0) for v in adj}
    x = dict(start)
    for _ in range(3000):
        y = {v: (1 - alpha) * start[v] for v in adj}
        for v in adj:
            for u in adj[v]:
                y[u] += alpha * x[v] / len(adj[v])
        x = y
    return x


def test_push_is_within_its_residuals(spark, made):
    adj, g = made
    seeds = {5: [5], 6: [6, 7, 8]}
    rows = spark.createDataFrame([(s, v) for s, vs in seeds.items() for v in vs], "seed long, node long")
    got = {}
    for x in pagerank.push(g, rows, 0.85, 1e-3).collect():
        got.setdefault(x.seed, {})[x.node] = (x.p, x.r)
    for s, vs in seeds.items():
        want, left = exact_scores(adj, vs, 0.85), sum(r for _, r in got[s].values())
        assert all(r < 1e-3 * len(adj[v]) for v, (_, r) in got[s].items())
        for v in adj:
            p = got[s].get(v, (0.0, 0.0))[0]
            assert -1e-9 <= want[v] - p <= left + 1e-9
        assert sum(want.values()) - sum(p for p, _ in got[s].values()) == pytest.approx(left)


def brute_sweep(adj, score):
    order = sorted((v for v in score if score[v] > 0 and adj[v]), key=lambda v: (-score[v], v))
    every, best, out = sum(map(len, adj.values())), (9.0,), None
    for i in range(1, len(order) + 1):
        s = set(order[:i])
        volume = sum(len(adj[v]) for v in s)
        low = min(volume, every - volume)
        value = round(sum(u not in s for v in s for u in adj[v]) / low, 12) if low else 2.0
        if value < best[0]:
            best, out = (value,), s
    return best[0], out


def test_sweep_of_many_seeds(spark, made):
    adj, g = made
    r = random.Random(1)
    scores = {s: {v: r.choice([0.0, 0.25, 0.5, r.random()]) for v in adj} for s in range(4)}
    rows = spark.createDataFrame([(s, v, x) for s in scores for v, x in scores[s].items()], "seed long, node long, score double")
    got = {}
    for x in pagerank.sweep(g, rows).collect():
        got.setdefault(x.seed, (x.conductance, set()))[1].add(x.node)
    assert {s: (pytest.approx(c), n) for s, (c, n) in got.items()} == {s: brute_sweep(adj, scores[s]) for s in scores}


def test_seed_expansion_finds_the_seeds_group(spark):
    adj = random_graph(9, 30, 3, 0.9, 0.01)
    g = graph_of(spark, adj)
    group = {v for v in adj if v % 3 == 1}
    for key, more in (("OSSE", {"ninf": True, "expansion": "vppr", "alpha": 0.8}), ("MULTICOM", {"epsilon": 1e-3})):
        found = groups_of(registry.detect(g, key, seed_node=4, **more).membership)
        assert any(4 in s and len(group & set(s)) >= 0.8 * len(group) and len(s) < len(adj) for s in found)  # the cut may take another group in
    from weft.plans import detect

    many = detect.osse(g, alpha=0.7, epsilon=1e-3, seeds=spark.createDataFrame([(v,) for v in (0, 1, 2, 4)], "node long"))
    found = groups_of(many)
    assert 1 <= len(found) <= 4


def test_refinement_starts_from_local_moving(spark, made):
    adj, g = made
    found = groups_of(registry.detect(g, "COVER_REFINE", max_iter=2).membership)
    assert {v for s in found for v in s} == set(adj)


def test_common_neighbour_merge_against_the_scan(spark):
    """Passes over communities from large to small until none merges, one after the other."""
    from weft.operators import boundary

    r = random.Random(6)
    adj = random_graph(3, 30)
    g = graph_of(spark, adj)
    coms = {c: set(r.sample(range(30), r.randint(2, 6))) for c in range(7)}
    rows = spark.createDataFrame([(c, v) for c, s in coms.items() for v in s], "cid long, node long")
    want, changed = {c: set(s) for c, s in coms.items()}, True
    while changed:
        changed, gone = False, set()
        order = sorted(want, key=lambda c: (-len(want[c]), c))
        for i, j in itertools.combinations(order, 2):
            if not {i, j} & gone and len(want[i] & want[j]) / (len(want[i]) * len(want[j])) ** 0.5 >= 0.4:
                want[i] |= want[j]
                gone.add(j)
                changed = True
        want = {c: s for c, s in want.items() if c not in gone}
    got = rows
    while not boundary.merge_pairs(g, got, "cosine", 0.4, 0.0).isEmpty():
        got = boundary.merge(g, got, "cosine", 0.4, 0.0)
    assert groups_of(got) == sorted(map(sorted, want.values()))
    assert got.where(F.col("cid").isNull()).isEmpty()


def staying(adj, grown, order):
    """Seeds in order, without those in a community before them."""
    out, covered = {}, set()
    for seed in sorted(adj, key=order):
        if seed not in covered:
            out[seed] = grown[seed]
            covered |= grown[seed]
    return out


def test_local_fitness(made):
    adj, g = made

    def fitness(s):
        every = sum(len(adj[v]) for v in s)
        return round(sum(u in s for v in s for u in adj[v]) / float(every) ** 0.9, 12) if every else 0.0

    grown = {}
    for seed in adj:
        s = {seed}
        while True:
            able = [(v not in s, -fitness(s ^ {v}), v) for v in s | {u for v in s for u in adj[v]} if v != seed and fitness(s ^ {v}) > fitness(s) + 1e-11]
            if not able:
                break
            s = s ^ {min(able)[2]}
        grown[seed] = s
    want = staying(adj, grown, lambda v: v)
    assert groups_of(registry.detect(g, "LFM", alpha=0.9).membership) == sorted(map(sorted, want.values()))


def test_belonging_degrees(made):
    adj, g = made
    belong = lambda v, s: round(len(adj[v] & s) / len(adj[v]), 12) if adj[v] else 0.0
    grown = {}
    for seed in adj:
        s = {seed}
        while near := [v for u in s for v in adj[u] - s if belong(v, s) >= 0.2]:
            s.add(min(near, key=lambda v: (-belong(v, s), v)))
        grown[seed] = s
    want = staying(adj, grown, lambda v: (-len(adj[v]), v))
    want = [s | {v for v in adj if adj[v] & s and len(adj[v] & s) / len(adj[v]) >= 0.6} for s in want.values()]
    found = registry.detect(g, "WCOMMUNITY", min_bel_degree=0.2, threshold_bel_degree=0.6).membership
    assert groups_of(found) == sorted(map(sorted, want))
