"""Toy graphs with exact expected values."""

import pytest

from weft.graph import Graph
from weft.operators import boundary, centrality, cover, metrics, rank
from weft.plans.lineage import cut
from weft.sources import ingest

T1 = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "e"), ("d", "f"), ("e", "f")]


def graph(spark, edges):
    return Graph.from_edges(spark.createDataFrame([(*e, 1.0) for e in edges], f"src {'string' if isinstance(edges[0][0], str) else 'long'}, dst {'string' if isinstance(edges[0][0], str) else 'long'}, weight double"))


@pytest.fixture(scope="module")
def t1(spark):
    made = graph(spark, T1)
    return Graph(cut(made.nodes), cut(made.edges))


def members(spark, *groups, kind="string"):
    return spark.createDataFrame([(i, v) for i, g in enumerate(groups) for v in g], f"cid int, node {kind}")


def values(df, column):
    return {r.node: r[column] for r in df.collect()}


def close(a, b):
    return a == pytest.approx(b, abs=1e-6)


def test_centralities(t1):
    got = centrality.basic_centralities(t1)
    assert close(values(got, "degree")["a"], 0.4) and close(values(got, "degree")["c"], 0.6)
    assert close(values(got, "closeness")["a"], 0.5) and close(values(got, "closeness")["d"], 0.714286)
    assert close(values(got, "betweenness")["a"], 0) and close(values(got, "betweenness")["c"], 0.6)
    h = values(centrality.harmonic(t1), "harmonic")
    assert close(h["b"], 3.166667) and close(h["c"], 4.0)
    assert close(values(centrality.betweenness(t1, load=True), "load")["c"], 0.6)
    e = values(centrality.eigenvector(t1), "eigenvector")
    assert e["c"] > e["a"] > 0 and close(sum(x * x for x in e.values()), 1)
    assert values(centrality.katz(t1), "katz")["c"] > values(centrality.katz(t1), "katz")["a"]
    for m in ("information", "communicability_betweenness", "subgraph"):
        s = values(centrality.spectral(t1, m), m)
        assert s["c"] > s["a"]


def test_disconnected(spark):
    g = graph(spark, [*T1, ("x", "y")])
    with pytest.raises(centrality.Disconnected):
        centrality.basic_centralities(g)
    assert g.giant().nodes.count() == 6 and g.scope().nodes.count() == 6 and g.scope("false").nodes.count() == 8
    assert close(values(centrality.closeness(g), "closeness")["x"], 1 / 7)


def test_community_centralities(spark, t1):
    crisp, overlapping = members(spark, "abc", "def"), members(spark, "abcd", "cdef")
    got = {r.node: r for r in centrality.community_centralities(t1, crisp, 0.2).collect()}
    assert close(got["a"].ccdc, 0.769231) and close(got["c"].ccdc, 0.846154)
    assert close(got["a"].cccc, 0.722222) and close(got["c"].cccc, 0.866667)
    assert close(got["a"].ccbc, 0) and close(got["c"].ccbc, 0.428571)
    got = {r.node: r for r in centrality.community_centralities(t1, overlapping, 0.2).collect()}
    assert close(got["a"].ccdc, 0.588235) and close(got["c"].ccdc, 0.647059)
    assert close(got["a"].cccc, 0.653846) and close(got["c"].cccc, 0.762183)
    assert close(got["a"].ccbc, 0) and close(got["c"].ccbc, 0.454545)
    got = {r.node: r for r in centrality.community_centralities(t1, crisp, 1.0).collect()}
    assert close(got["c"].ccdc, 0.6) and close(got["c"].cccc, 0.714286) and close(got["c"].ccbc, 0.6)


@pytest.mark.parametrize("domain", ["graph", "induced"])
def test_community_centralities_in_batches(spark, t1, domain):
    """Sums over batches of a few sources are those over all at once."""
    overlapping = members(spark, "abcd", "cdef")
    one, many = ({r.node: tuple(r)[1:] for r in centrality.community_centralities(t1, overlapping, 0.3, domain, pairs=p).collect()} for p in (None, 12))
    assert one.keys() == many.keys() and all(close(one[v][i], many[v][i]) for v in one for i in range(3))


def test_domains(spark):
    g = graph(spark, [(1, 2), (2, 3), (3, 4), (1, 4)])
    m = members(spark, [1, 3], kind="long")
    assert close(values(centrality.community_centralities(g, m, 0.2, "graph"), "cccc")[1], 0.583333)
    assert close(values(centrality.community_centralities(g, m, 0.2, "induced"), "cccc")[1], 1.75)


def test_places_and_ranks_by_ranges(spark):
    """Numbers over all rows as one window would give them, with ties, nulls and no rows."""
    import random

    from weft.operators import rank
    from weft.operators.order import min_ranks, numbered

    r = random.Random(1)
    rows = [(i, r.choice([None, 1.0, 2.5, 2.5, float(r.randint(0, 9))])) for i in range(300)]
    scores = spark.createDataFrame(rows, "node long, x double").repartition(5)
    best = sorted(rows, key=lambda t: (t[1] is None, -(t[1] or 0), t[0]))
    assert {(x.rank, x.node) for x in rank.to_ranking(scores, "m", "x").collect()} == {(i + 1, v) for i, (v, _) in enumerate(best)}
    want = {v: 1 + sum(y is not None and (x is None or y > x) for _, y in rows) for v, x in rows}
    assert {x.node: x.x_rank for x in min_ranks(scores, "x", "x_rank").collect()} == want
    top = rank.top_k(scores, "x", 7, "global").collect()
    assert [t.node for t in top] == [v for v, _ in best[:7]] and all(t.x_rank == want[t.node] for t in top)
    from pyspark.sql import functions as F

    assert numbered(scores.limit(0), "n", F.col("node")).collect() == []


def test_boundary(spark, t1):
    part = members(spark, "abc", "def")
    assert {(r.node, r.cand) for r in boundary.boundary_candidates(t1, part).collect()} == {("c", 1), ("d", 0)}
    row = next(r for r in boundary.boundary_similarity(t1, part).collect() if r.node == "c")
    want = {"cosine": 0.288675, "jaccard": 0.166667, "dice": 0.285714, "overlap": 0.333333, "aa": 0.214693, "ra": 0.167248}
    assert (row.size_node, row.size_profile, row.both) == (3, 4, 1)
    assert all(close(row[m], v) for m, v in want.items())
    assert boundary.inject(t1, part, "salton", 0.4).count() == 6
    assert boundary.inject(t1, part, "cosine", 0.25).count() == 8
    with pytest.raises(ValueError, match="unknown similarity"):
        boundary.inject(t1, part, "nonsense")


def test_metrics(spark, t1):
    crisp = members(spark, "abc", "def")
    row = metrics.panel(t1, crisp).first()
    assert close(row.shen_modularity, 0.357143) and close(row.modularity, 0.357143) and close(row.conductance, 0.142857)
    assert close(row.internal_edge_density, 1) and close(row.avg_transitivity, 1) and (row.n_communities, row.max_community_size) == (2, 3)
    assert close(row.coverage_ratio, 1) and row.overlap_intensity is None
    assert close(metrics.shen_modularity(t1, members(spark, "abcd", "def")).first()[0], 0.262755)
    assert close(metrics.shen_modularity(t1, members(spark, "abcd", "cdef")).first()[0], 0.142857)
    one = metrics.panel(t1, members(spark, "abcdef")).first()
    assert close(one.conductance, 0) and close(one.normalized_cut, 0) and close(one.modularity_overlap, 7 / 15)
    single = metrics.community_metrics(t1, members(spark, "a")).first()
    assert close(single.conductance, 1) and close(single.internal_edge_density, 0)


def test_cover(spark, t1):
    m = members(spark, "abc", "cba", "def", "d")
    assert cover.sizes(cover.postprocess(m, 2)).count() == 2
    assert {r.node for r in cover.uncovered(t1, members(spark, "abc")).collect()} == set("def")
    assert {(r.node, r.cid) for r in cover.primary(members(spark, "ab", "abc")).collect()} == {("a", 1), ("b", 1), ("c", 1)}
    assert {(r.c1, r.c2): r.weight for r in cover.contract(t1, members(spark, "abc", "def")).collect()} == {(0, 0): 3.0, (0, 1): 1.0, (1, 1): 3.0}
    assert {(r.c1, r.c2): r.weight for r in cover.contract(t1, members(spark, "abc", "def"), double_cross=True).collect()}[0, 1] == 2.0


def test_ranking(spark):
    ranking = spark.createDataFrame([("m", i + 1, v) for i, v in enumerate("pqrs")], "method string, rank int, node string")
    curve = rank.recovery_curve(ranking, spark.createDataFrame([("p",), ("r",), ("s",)], "node string"))
    assert [r.hits for r in curve.orderBy("k").collect()] == [1, 1, 2, 3]
    assert rank.curve_summary(curve).first().auc == 5.5


def test_ingest(spark, tmp_path):
    texts = spark.createDataFrame([("TP53; BRCA1\tx y\r\nTP53,,z",)], "text string")
    assert [r.identifier for r in ingest.split_identifiers(texts).orderBy("pos").collect()] == ["TP53", "BRCA1", "x y", "z"]
    lines = spark.createDataFrame([("H1\tabc\tDef",), ("# no",), ("lonely",), ("H2 abc ghi",)], "value string")
    assert sorted((r.hallmark, r.gene) for r in ingest.gene_sets(lines).collect()) == [("H1", "ABC"), ("H1", "DEF"), ("H2", "ABC"), ("H2", "GHI")]
    assert sorted(r.member for r in ingest.catalogue(spark.createDataFrame([("C1:  A B C",)], "value string")).collect()) == ["A", "B", "C"]
    (tmp_path / "net.tsv").write_text("i1\ti2\tA\tB\t9606\t900\ni1\ti2\tshort\ni2\ti3\tB\tC\t9606\t0.5\n")
    assert {(r.src, r.dst): r.weight for r in ingest.read_network_tsv(spark, f"file://{tmp_path}/net.tsv").collect()} == {("A", "B"): 0.9, ("B", "C"): 0.5}
    terms = spark.createDataFrame([("GO", "cell cycle (GO:0007049)"), (ingest.PATHWAYS, "Pathways in cancer Homo sapiens hsa05200"), (ingest.PATHWAYS, "Cancer 05200"), ("GO", "Cancer 05200"), (ingest.PATHWAYS, None)], "library string, term string")
    got = {(r.library, r.term): (r.term_id, r.term_name, r.url.rpartition("/")[2]) for r in ingest.parse_terms(terms).collect()}
    assert got["GO", "cell cycle (GO:0007049)"] == ("GO:0007049", "cell cycle", "GO:0007049")
    assert got[ingest.PATHWAYS, "Pathways in cancer Homo sapiens hsa05200"] == ("hsa05200", "Pathways in cancer", "pathway+hsa05200")
    assert got[ingest.PATHWAYS, "Cancer 05200"] == ("hsa05200", "Cancer", "pathway+hsa05200") and got["GO", "Cancer 05200"] == ("", "Cancer 05200", "")
    assert got[ingest.PATHWAYS, None] == ("", "", "")


def test_edges_are_canonical(spark):
    rows = [("b", "a", 1.0), ("a", "b", 3.0), ("c", "c", 1.0), (None, "a", 1.0), ("a", "c", None)]
    g = Graph.from_edges(spark.createDataFrame(rows, "src string, dst string, weight double"))
    assert [tuple(r) for r in g.edges.collect()] == [("a", "b", 3.0)]


def test_all_distances(spark, monkeypatch):
    import random

    from weft import catalog

    r = random.Random(4)
    edges = {(i, i + 1) for i in range(60, 75)} | {(80, 81)} | {tuple(sorted(r.sample(range(40, 60), 2))) for _ in range(30)}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = set()
    for source in near:
        seen, front = {source: 0}, [source]
        while front:
            front = [seen.setdefault(w, seen[v] + 1) and w for v in front for w in near[v] if w not in seen]
        want |= {(source, node, d) for node, d in seen.items()}
    assert max(d for *_, d in want) > 4 and max(near) > 40
    g = graph(spark, sorted(edges))
    monkeypatch.setattr(catalog, "part_graph", lambda *_: g)
    got = [(x.source, x.node, x.d) for x in catalog.queries()["bfs_distances"](spark, "").collect()]
    assert len(got) == len(want) and set(got) == want


def test_batches_of_sources_give_the_same_values(spark, t1):
    for f, name in ((centrality.closeness, "closeness"), (centrality.harmonic, "harmonic"), (centrality.betweenness, "betweenness")):
        whole, parts = values(f(t1), name), values(f(t1, pairs=8), name)
        assert len(centrality.batches_of(t1, pairs=8)) == 5 and all(close(whole[v], parts[v]) for v in whole)


def test_small_communities_keep_the_outer_part(spark, t1):
    got = {r.node: r for r in centrality.community_centralities(t1, members(spark, "cd", "a"), 0.2).collect()}
    assert close(got["c"].ccbc, 6 / 10) and close(got["d"].ccbc, 6 / 10) and close(got["a"].ccbc, 0)  # alpha B / (alpha P)


@pytest.mark.parametrize("seed", range(4))
def test_greedy_start_against_brute_force(spark, seed):
    import random

    r = random.Random(seed)
    edges = [(i, j, r.uniform(0.5, 3)) for i in range(9) for j in range(i) if r.random() < 0.45]
    g = Graph.from_edges(spark.createDataFrame(edges, "src long, dst long, weight double"))
    m = sum(w for *_, w in edges)
    nodes = sorted({v for a, b, _ in edges for v in (a, b)})

    def q(parts):
        return sum(sum(w for a, b, w in edges if a in p and b in p) / m - (sum(w * ((a in p) + (b in p)) for a, b, w in edges) / (2 * m)) ** 2 for p in parts)

    parts = [frozenset([v]) for v in nodes]
    while True:
        merged = [[x for x in parts if x not in (p, s)] + [p | s] for i, p in enumerate(parts) for s in parts[:i] if any((a in p and b in s) or (a in s and b in p) for a, b, _ in edges)]
        best = max(merged, key=q, default=None)
        if best is None or q(best) <= q(parts) + 1e-12:
            break
        parts = best
    from weft.plans.detect import greedy

    got = {}
    for row in greedy(g).collect():
        got.setdefault(row.cid, set()).add(row.node)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, parts))


@pytest.mark.parametrize("metric", ["cosine", "jaccard", "ra"])
def test_merge_scan_against_brute_force(spark, metric):
    import math
    import random

    r = random.Random(5)
    edges = {(i, j) for i in range(30) for j in range(i) if r.random() < 0.15}
    g = Graph.from_edges(spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src long, dst long, weight double"))
    degree = {v: sum(v in e for e in edges) for v in range(30)}
    groups = [set(r.sample(range(30), r.randint(2, 12))) for _ in range(14)]
    groups = [{v for v in x if degree[v]} for x in groups]
    sim = {
        "cosine": lambda a, b: len(a & b) / math.sqrt(len(a) * len(b)), "jaccard": lambda a, b: len(a & b) / len(a | b),
        "ra": lambda a, b: sum(degree[v] ** -2 for v in a & b) / math.sqrt(sum(degree[v] ** -2 for v in a) * sum(degree[v] ** -2 for v in b)),
    }[metric]
    order = sorted(range(len(groups)), key=lambda i: (-len(groups[i]), i))
    want, left = {i: set(groups[i]) for i in order}, []
    for i in order:
        into = next((j for j in left if want[i] & want[j] and len(want[i] & want[j]) / len(want[i]) >= 0.4 and sim(want[i], want[j]) >= 0.3), None)
        if into is None:
            left.append(i)
        else:
            want[into] |= want[i]
    m = spark.createDataFrame([(i, v) for i, x in enumerate(groups) for v in x], "cid int, node long")
    got = {}
    for row in boundary.merge(g, m, metric, 0.3, 0.4).collect():
        got.setdefault(row.cid, set()).add(row.node)
    assert got == {i: want[i] for i in left}
    assert len(left) < len(groups)


def test_pages_and_thinned_histories(spark):
    m = spark.createDataFrame([(c, f"{c}-{i}") for c in range(7) for i in range(7 - c)], "cid int, node string")
    assert [(r.community_id, r["size"]) for r in cover.page(m, 2, 3).orderBy("community_id").collect()] == [(4, 4), (5, 3), (6, 2)]
    assert [r.community_id for r in cover.page(m, 9, 3).collect()] == [7]
    curve = spark.createDataFrame([("m", k, k) for k in range(1, 101)], "method string, k int, hits int")
    assert sorted(r.k for r in rank.thinned(curve, "k", 30).collect()) == list(range(1, 101, 3))


def test_exports(spark, t1, tmp_path):
    from weft.plans import runner

    runs, found = runner.run_all(t1, include=("EGONET",), seconds=100)
    for _ in range(2):
        runner.export(t1, runs, found, str(tmp_path), "a b")
    assert spark.read.csv(f"{tmp_path}/a_b/summary", header=True).count() == 2  # grows
    assert spark.read.csv(f"{tmp_path}/a_b/nodes", header=True).count() == 6
    assert set(spark.read.csv(f"{tmp_path}/a_b/communities_long", header=True).columns) >= {"run_id", "community_id", "node"}
    scores = centrality.degree_centrality(t1)
    ranking = rank.to_ranking(scores, "degree")
    curve = rank.recovery_curve(ranking, t1.nodes.where("node < 'c'"))
    runner.export_evaluation(f"{tmp_path}/e", scores, ranking, curve, rank.curve_summary(curve))
    assert spark.read.csv(f"{tmp_path}/e/curves", header=True).count() == 6


def test_failed_metric_leaves_the_others(spark, t1, monkeypatch):
    monkeypatch.setattr(metrics, "shen_modularity", lambda *a: 1 / 0)
    row, failed = metrics.safe_panel(t1, members(spark, "abc", "def"))
    assert list(failed) == ["shen_modularity"] and row["shen_modularity"] is None and close(row["modularity"], 0.357143) and row["n_communities"] == 2


def test_cut_tables_can_be_cleared(spark):
    import os

    from weft.plans import lineage

    df = lineage.cut(spark.range(3).toDF("x"))
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and lineage.shared_folder(spark).endswith(spark.sparkContext.applicationId)
