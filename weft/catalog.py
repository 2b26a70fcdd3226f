"""Registered queries of the engine and their SQL counterparts.

The canonical graph has parts as nodes and, as edges, pairs of parts that share
two orders at least. Its crisp partition is the brand; its overlapping cover
has the brands and the types as communities.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.similarity import METRICS
from weft.graph import Graph, shared_pairs, task_parts
from weft.operators import boundary, centrality, cover, egonets, metrics, rank, spanning, triangles
from weft.plans import detect
from weft.plans.lineage import cut
from weft.sources import ingest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_graph(spark: SparkSession, sf_dir: str, least: int = 2) -> Graph:
    edges = cut(shared_pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey").where(F.col("weight") >= least))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return Graph(cut(nodes), edges)


def parts_of(spark: SparkSession, sf_dir: str, graph: Graph) -> DataFrame:
    """(node, p_brand, p_type) of the graph's parts, by node, in partitions that grow with the table."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), "p_brand", "p_type")
    return part.join(graph.nodes, "node", "left_semi").repartition(task_parts(part), "node")


def brands(spark: SparkSession, sf_dir: str, graph: Graph) -> DataFrame:
    return parts_of(spark, sf_dir, graph).select(F.col("p_brand").alias("cid"), "node")


def brands_and_types(spark: SparkSession, sf_dir: str, graph: Graph) -> DataFrame:
    return parts_of(spark, sf_dir, graph).select(F.explode(F.array("p_brand", "p_type")).alias("cid"), "node")


def flagship(spark: SparkSession, sf_dir: str, metric: str = "cosine", theta: float = 0.4) -> DataFrame:
    """Parts that belong to more than one brand community, with their number of communities."""
    g = part_graph(spark, sf_dir)
    m = boundary.inject(g, brands(spark, sf_dir, g), metric, theta)
    return cover.counts(g, m).where("memberships > 1").select("node", "memberships")


#: Thresholds at which each similarity injects some communities on the middle tables.
THETAS = {"cosine": 0.05, "jaccard": 0.01, "dice": 0.02, "overlap": 0.4, "aa": 0.05, "ra": 0.05}

_BASE = """
op AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
edges AS MATERIALIZED (SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*)::DOUBLE AS weight FROM op a JOIN op b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(*) >= 2),
adj AS MATERIALIZED (SELECT src AS node, dst AS nbr, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges),
deg AS MATERIALIZED (SELECT node, count(*) AS degree, sum(weight) AS strength FROM adj GROUP BY node),
brand AS (SELECT p_brand AS cid, p_partkey AS node FROM part WHERE p_partkey IN (SELECT node FROM deg)),
both_ AS (SELECT * FROM brand UNION ALL SELECT p_type, p_partkey FROM part WHERE p_partkey IN (SELECT node FROM deg)),
cand AS (SELECT DISTINCT a.node, q.cid AS cand FROM adj a JOIN brand p ON a.node = p.node JOIN brand q ON a.nbr = q.node WHERE p.cid <> q.cid),
profile AS (SELECT DISTINCT p.cid, a.nbr FROM adj a JOIN brand p ON a.node = p.node),
w AS (SELECT node AS nbr, 1 / (ln(1 + degree) * ln(1 + degree)) AS w_aa, 1.0::DOUBLE / (degree * degree) AS w_ra FROM deg),
of_node AS (SELECT node, count(*) AS size_node, sum(w_aa) AS aa_node, sum(w_ra) AS ra_node FROM adj JOIN w USING (nbr) GROUP BY node),
of_profile AS (SELECT cid AS cand, count(*) AS size_profile, sum(w_aa) AS aa_profile, sum(w_ra) AS ra_profile FROM profile JOIN w USING (nbr) GROUP BY cid),
shared AS (SELECT c.node, c.cand, count(*) AS both_n, sum(w_aa) AS aa_both, sum(w_ra) AS ra_both FROM cand c JOIN adj a ON a.node = c.node JOIN profile p ON p.cid = c.cand AND p.nbr = a.nbr JOIN w ON w.nbr = a.nbr GROUP BY 1, 2),
sims AS (
  SELECT node, cand, size_node, size_profile, coalesce(both_n, 0) AS "both",
    coalesce(both_n / sqrt(size_node::DOUBLE * size_profile), 0) AS cosine, coalesce(both_n::DOUBLE / (size_node + size_profile - both_n), 0) AS jaccard, coalesce(2.0::DOUBLE * both_n / (size_node + size_profile), 0) AS dice,
    coalesce(both_n::DOUBLE / least(size_node, size_profile), 0) AS "overlap", coalesce(aa_both / sqrt(aa_node * aa_profile), 0) AS aa, coalesce(ra_both / sqrt(ra_node * ra_profile), 0) AS ra
  FROM cand LEFT JOIN shared USING (node, cand) JOIN of_node USING (node) JOIN of_profile USING (cand)
),
cuts AS (
  SELECT cid, count(*) AS size, sum(inside) // 2 AS inner_n, sum(degree - inside) AS cut FROM (
    SELECT m.cid, m.node, count(x.node) AS inside, count(*) AS degree FROM both_ m JOIN adj a ON a.node = m.node LEFT JOIN both_ x ON x.cid = m.cid AND x.node = a.nbr GROUP BY 1, 2) GROUP BY cid
)
"""
_REC = ", comp AS (SELECT node, node AS c FROM deg UNION SELECT a.nbr, p.c FROM comp p JOIN adj a ON a.node = p.node WHERE p.c < a.nbr)"


def _r(name: str, digits: int = 9) -> str:
    return f"round({name}, {digits}) AS {name.strip(chr(34))}"


def _rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, sql: str | None = None, recursive: str = "") -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = f"WITH {'RECURSIVE' if recursive else ''} {_BASE}{recursive} {sql}"
        return f

    return put


def _on_graph(name: str, sql: str | None = None, recursive: str = "") -> Callable:
    def put(f: Callable[[Graph, SparkSession, str], DataFrame]) -> Callable:
        _add(name, sql, recursive)(lambda spark, sf_dir: f(part_graph(spark, sf_dir), spark, sf_dir))
        return f

    return put


@_on_graph("edges_canonical", "SELECT src, dst, weight FROM edges")
def _edges(g, spark, d):
    return g.edges


@_on_graph("degree_strength", "SELECT node, degree, strength FROM deg")
def _degrees(g, spark, d):
    return g.degrees


@_on_graph("boundary_nodes", "SELECT node, count(*) AS candidates FROM cand GROUP BY node")
def _boundary(g, spark, d):
    return boundary.boundary_candidates(g, brands(spark, d, g)).groupBy("node").agg(F.count(F.lit(1)).alias("candidates"))


@_on_graph("community_profile", "SELECT cid, count(*) AS size FROM profile GROUP BY cid")
def _profile(g, spark, d):
    return boundary.profiles(g, brands(spark, d, g)).groupBy("cid").agg(F.count(F.lit(1)).alias("size"))


@_on_graph("boundary_similarity", "SELECT node, cand, size_node, size_profile, \"both\", " + ", ".join(_r(f'"{m}"') for m in METRICS) + " FROM sims")
def _similarity(g, spark, d):
    return _rounded(boundary.boundary_similarity(g, brands(spark, d, g)), *METRICS)


def _injection(metric: str) -> None:
    theta = THETAS[metric]

    @_on_graph(f"overlap_injection_{metric}", f'SELECT cid, node FROM brand UNION SELECT cand, node FROM sims WHERE "{metric}" >= {theta}')
    def _inject(g, spark, d):
        return boundary.inject(g, brands(spark, d, g), metric, theta)


for _m in METRICS:
    _injection(_m)


@_add("flagship_overlap_counts", "SELECT node, count(DISTINCT cid) AS memberships FROM (SELECT cid, node FROM brand UNION SELECT cand, node FROM sims WHERE cosine >= 0.05) GROUP BY node HAVING count(DISTINCT cid) > 1")
def _flagship(spark, d):
    return flagship(spark, d, "cosine", 0.05)


@_on_graph("membership_histogram", "SELECT memberships, count(*) AS nodes FROM (SELECT node, count(DISTINCT cid) AS memberships FROM both_ GROUP BY node) GROUP BY memberships")
def _histogram(g, spark, d):
    return cover.count_histogram(g, brands_and_types(spark, d, g))


@_on_graph("community_pair_overlap", "SELECT a.cid AS cid1, b.cid AS cid2, count(*) AS shared FROM both_ a JOIN both_ b ON a.node = b.node AND a.cid < b.cid GROUP BY 1, 2")
def _pairs(g, spark, d):
    return boundary.community_pairs(brands_and_types(spark, d, g))


@_on_graph(
    "shen_modularity",
    """, o AS (SELECT node, count(*) AS t FROM both_ GROUP BY node), m2 AS (SELECT sum(strength) AS m2 FROM deg),
 i AS (SELECT sum(2 * weight / (ou.t * ov.t)) AS x FROM edges JOIN both_ a ON a.node = src JOIN both_ b ON b.node = dst AND a.cid = b.cid JOIN o ou ON ou.node = src JOIN o ov ON ov.node = dst),
 k AS (SELECT sum(k * k) AS y FROM (SELECT cid, sum(strength / t) AS k FROM both_ JOIN deg USING (node) JOIN o USING (node) GROUP BY cid))
 SELECT round(x / m2 - y / (m2 * m2), 9) AS shen_modularity FROM i, k, m2""",
)
def _shen(g, spark, d):
    return _rounded(metrics.shen_modularity(g, brands_and_types(spark, d, g)), "shen_modularity")


@_on_graph(
    "modularity_crisp",
    """, m AS (SELECT sum(weight) AS m FROM edges), i AS (SELECT sum(weight) AS x FROM edges JOIN brand a ON a.node = src JOIN brand b ON b.node = dst WHERE a.cid = b.cid),
 k AS (SELECT sum(k * k) AS y FROM (SELECT cid, sum(strength) AS k FROM brand JOIN deg USING (node) GROUP BY cid)) SELECT round(x / m - y / (4 * m * m), 9) AS modularity FROM i, k, m""",
)
def _modularity(g, spark, d):
    return _rounded(metrics.modularity(g, brands(spark, d, g)), "modularity")


@_on_graph(
    "community_metrics",
    """, o AS (SELECT node, count(*) AS t FROM both_ GROUP BY node), ins AS (SELECT m.cid, m.node, count(x.node) AS inside, count(*) AS degree FROM both_ m JOIN adj a ON a.node = m.node LEFT JOIN both_ x ON x.cid = m.cid AND x.node = a.nbr GROUP BY 1, 2),
 bal AS (SELECT cid, sum((2 * inside - degree)::DOUBLE / (degree * t)) AS balance FROM ins JOIN o USING (node) GROUP BY 1)
 SELECT cid, size, inner_n::BIGINT AS inner, cut::BIGINT AS cut, round(coalesce(2.0 * inner_n / nullif(size * (size - 1), 0), 0), 9) AS internal_edge_density,
 round(CASE WHEN size = 1 THEN 1 ELSE coalesce(cut::DOUBLE / nullif(2 * inner_n + cut, 0), 0) END, 9) AS conductance,
 round(CASE WHEN size = 1 THEN 1 ELSE coalesce(cut::DOUBLE / nullif(2 * inner_n + cut, 0), 0) END + coalesce(cut::DOUBLE / nullif(2 * (m - inner_n) + cut, 0), 0), 9) AS normalized_cut,
 round(balance / size * coalesce(2.0::DOUBLE * inner_n / nullif(size * (size - 1), 0), 0), 9) AS modularity_overlap
 FROM cuts JOIN bal USING (cid), (SELECT count(*) AS m FROM edges)""",
)
def _community(g, spark, d):
    return _rounded(metrics.community_metrics(g, brands_and_types(spark, d, g)), "internal_edge_density", "conductance", "normalized_cut", "modularity_overlap")


@_on_graph(
    "avg_transitivity",
    """, ine AS (SELECT a.cid, e.src, e.dst FROM edges e JOIN both_ a ON a.node = e.src JOIN both_ b ON b.node = e.dst AND a.cid = b.cid), ia AS (SELECT cid, src AS node, dst AS nbr FROM ine UNION ALL SELECT cid, dst, src FROM ine),
 idg AS (SELECT cid, node, count(*) AS d FROM ia GROUP BY 1, 2), tri AS (SELECT x.cid, x.node, count(*) AS t FROM ia x JOIN ia y ON x.cid = y.cid AND x.node = y.node JOIN ine e ON e.cid = x.cid AND e.src = x.nbr AND e.dst = y.nbr GROUP BY 1, 2)
 SELECT cid, round(avg(CASE WHEN d >= 2 THEN 2.0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END), 9) AS avg_transitivity FROM both_ LEFT JOIN idg USING (cid, node) LEFT JOIN tri USING (cid, node) GROUP BY cid""",
)
def _transitivity(g, spark, d):
    return _rounded(metrics.community_transitivity(g, brands_and_types(spark, d, g)), "avg_transitivity")


@_on_graph(
    "coverage_panel",
    """, n AS (SELECT d.node, count(DISTINCT b.cid) AS n FROM deg d LEFT JOIN brand b ON b.node = d.node AND b.cid < 'Brand#3' GROUP BY 1)
 SELECT round(avg((n > 0)::INT), 9) AS coverage_ratio, round(avg((n = 0)::INT), 9) AS uncovered_node_ratio, round(avg((n > 1)::INT), 9) AS overlap_node_ratio,
 round(avg(CASE WHEN n > 0 THEN n END), 9) AS avg_memberships_per_covered_node, round(avg(CASE WHEN n > 1 THEN n END), 9) AS overlap_intensity FROM n""",
)
def _coverage(g, spark, d):
    out = metrics.coverage(g, brands(spark, d, g).where("cid < 'Brand#3'"))
    return _rounded(out, *out.columns)


@_on_graph("primary_community", ", s AS (SELECT cid, count(*) AS size FROM both_ GROUP BY cid) SELECT node, cid FROM both_ JOIN s USING (cid) QUALIFY row_number() OVER (PARTITION BY node ORDER BY size DESC, cid) = 1")
def _primary(g, spark, d):
    return cover.primary(brands_and_types(spark, d, g))


@_on_graph("meta_graph", "SELECT least(a.cid, b.cid) AS c1, greatest(a.cid, b.cid) AS c2, sum(weight) AS weight FROM edges JOIN brand a ON a.node = src JOIN brand b ON b.node = dst GROUP BY 1, 2")
def _meta(g, spark, d):
    return cover.contract(g, brands(spark, d, g))


_SALTON = ", cn AS (SELECT e.src, e.dst, count(x.nbr) AS \"both\" FROM edges e LEFT JOIN (SELECT a.node AS s, b.node AS t, a.nbr FROM adj a JOIN adj b ON a.nbr = b.nbr) x ON x.s = e.src AND x.t = e.dst GROUP BY 1, 2)"


@_on_graph("salton_edges", _SALTON + ' SELECT src, dst, "both", round("both" / sqrt(u.degree::DOUBLE * v.degree), 9) AS salton FROM cn JOIN deg u ON u.node = src JOIN deg v ON v.node = dst')
def _salton(g, spark, d):
    return _rounded(detect.salton_edges(g), "salton")


@_on_graph(
    "common_neighbor_assign",
    ", h AS (SELECT f.node, b.cid, count(*) AS hits FROM brand f JOIN adj a ON a.node = f.node JOIN brand b ON b.node = a.nbr WHERE f.cid >= 'Brand#3' AND b.cid < 'Brand#3' GROUP BY 1, 2) SELECT cid, node FROM h QUALIFY rank() OVER (PARTITION BY node ORDER BY hits DESC) = 1",
)
def _assign(g, spark, d):
    b = brands(spark, d, g)
    return detect.best_communities(g, b.where("cid >= 'Brand#3'"), b.where("cid < 'Brand#3'"))


@_on_graph("ego_level1", "SELECT node AS cid, node FROM deg UNION SELECT node, nbr FROM adj")
def _ego(g, spark, d):
    return detect.ego_networks(g, 1)


_UP = """up AS MATERIALIZED (SELECT CASE WHEN (p.degree, src) < (q.degree, dst) THEN src ELSE dst END AS x, CASE WHEN (p.degree, src) < (q.degree, dst) THEN dst ELSE src END AS y FROM edges JOIN deg p ON p.node = src JOIN deg q ON q.node = dst),
three AS MATERIALIZED (SELECT list_sort([p.x, p.y, q.y]) AS t FROM up p JOIN up q ON q.x = p.x AND p.y < q.y JOIN edges e ON e.src = p.y AND e.dst = q.y)"""


@_on_graph("triangles", f", {_UP} SELECT t[1] AS a, t[2] AS b, t[3] AS c FROM three")
def _triangles(g, spark, d):
    found = triangles.triangles(g).select(F.sort_array(F.array("a", "b", "c")).alias("t"))
    return found.select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))


_EGO = f""", {_UP}, ego_edges AS (SELECT t[1] AS ego, t[2] AS src, t[3] AS dst FROM three UNION ALL SELECT t[2], t[1], t[3] FROM three UNION ALL SELECT t[3], t[1], t[2] FROM three),
near AS MATERIALIZED (SELECT ego, src AS node, dst AS nbr FROM ego_edges UNION ALL SELECT ego, dst, src FROM ego_edges),
one AS MATERIALIZED (SELECT ego, node, least(node, min(nbr)) AS label FROM near GROUP BY 1, 2),
votes AS (SELECT ego, node, label, count(*) AS n FROM (SELECT ego, node, label FROM one UNION ALL SELECT n.ego, n.node, o.label FROM near n JOIN one o ON o.ego = n.ego AND o.node = n.nbr) GROUP BY 1, 2, 3)"""


@_on_graph("ego_label_rounds", _EGO + " SELECT ego, node, label FROM votes QUALIFY row_number() OVER (PARTITION BY ego, node ORDER BY n DESC, label) = 1")
def _ego_labels(g, spark, d):
    return egonets.propagate(egonets.ego_edges(g), 2)


@_on_graph(
    "contained_communities",
    ", cov AS MATERIALIZED (SELECT * FROM brand UNION ALL SELECT p_type, p_partkey FROM part WHERE p_partkey IN (SELECT node FROM deg)), sz AS (SELECT cid, count(*) AS n FROM cov GROUP BY 1), sh AS (SELECT a.cid AS c, b.cid AS d, count(*) AS shared FROM cov a JOIN cov b ON a.node = b.node AND a.cid <> b.cid GROUP BY 1, 2) SELECT c, d, shared, x.n AS size_c, y.n AS size_d FROM sh JOIN sz x ON x.cid = c JOIN sz y ON y.cid = d WHERE (y.n > x.n OR y.n = x.n AND d < c) AND shared >= 0.1 * x.n",
)
def _contained(g, spark, d):
    return egonets.contained(brands_and_types(spark, d, g), 0.1)


_TRI = "tri AS MATERIALIZED (SELECT a.src AS a, a.dst AS b, b.dst AS c FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON c.src = a.src AND c.dst = b.dst)"
_NUMBERED = ", per AS (SELECT k, count(*) AS size, min(node) AS least FROM found GROUP BY k), ord AS (SELECT k, (row_number() OVER (ORDER BY size DESC, least, k) - 1)::INT AS cid FROM per) SELECT cid, node FROM found JOIN ord USING (k)"


@_on_graph(
    "kclique_communities",
    f""", found AS (SELECT DISTINCT k, unnest([a, b, c]) AS node FROM (SELECT a, b, c, min(k) AS k FROM lab JOIN id USING (t) GROUP BY ALL)) SELECT count(*) AS size, string_agg(node, ',' ORDER BY node) AS nodes FROM found GROUP BY k""",
    f""", {_TRI}, id AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY a, b, c) AS t FROM tri),
 side AS MATERIALIZED (SELECT t, a AS x, b AS y FROM id UNION ALL SELECT t, a, c FROM id UNION ALL SELECT t, b, c FROM id), link AS MATERIALIZED (SELECT DISTINCT p.t AS t, q.t AS u FROM side p JOIN side q USING (x, y)),
 lab AS (SELECT t, t AS k FROM id UNION SELECT l.u, p.k FROM lab p JOIN link l ON l.t = p.t WHERE p.k < l.u)""",
)
def _kclique(g, spark, d):
    per = detect.kclique(g, 3).distinct().groupBy("cid").agg(F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list("node")).cast("array<string>").alias("nodes"))
    return per.select("size", F.concat_ws(",", "nodes").alias("nodes"))


@_on_graph("degree_centrality", "SELECT node, round(degree::DOUBLE / (SELECT count(*) - 1 FROM deg), 9) AS degree FROM deg")
def _degree(g, spark, d):
    return _rounded(centrality.degree_centrality(g), "degree")


_BFS = """, dist(source, node, d) USING KEY (source, node) AS (
  SELECT node, node, 0 FROM deg UNION
  SELECT x.source, a.nbr, (min(x.d) + 1)::INT FROM dist x JOIN adj a ON a.node = x.node LEFT JOIN recurring.dist r ON r.source = x.source AND r.node = a.nbr WHERE r.node IS NULL GROUP BY 1, 2)"""


@_on_graph("bfs_distances", " SELECT source, node, d FROM dist", _BFS)
def _bfs(g, spark, d):
    from weft.operators.paths import distances

    return distances(g)


@_on_graph("components", " SELECT node, min(c) AS component FROM comp GROUP BY node", _REC)
def _components(g, spark, d):
    return g.components()


@_on_graph("giant_component", ", cc AS (SELECT node, min(c) AS component FROM comp GROUP BY node), s AS (SELECT component FROM cc GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1) SELECT src, dst, weight FROM edges WHERE src IN (SELECT node FROM cc WHERE component = (SELECT component FROM s))", _REC)
def _giant(g, spark, d):
    return g.giant().edges


@_on_graph("closeness", ", per AS (SELECT source AS node, count(*) - 1 AS r, sum(d) AS total FROM dist GROUP BY 1) SELECT node, round(r::DOUBLE / (SELECT count(*) - 1 FROM deg) * r / total, 9) AS closeness FROM per", _BFS)
def _closeness(g, spark, d):
    return _rounded(centrality.closeness(g), "closeness")


@_on_graph("harmonic", " SELECT source AS node, round(sum(1.0::DOUBLE / d), 6) AS harmonic FROM dist WHERE d > 0 GROUP BY 1", _BFS)
def _harmonic(g, spark, d):
    return _rounded(centrality.harmonic(g), "harmonic", digits=6)


@_on_graph("subgraph_small_parts", "SELECT src, dst, weight FROM edges WHERE src IN (SELECT p_partkey FROM part WHERE p_size <= 25) AND dst IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def _subgraph(g, spark, d):
    return g.subgraph(table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("node"))).edges


@_on_graph("ego_subgraph", ", hub AS MATERIALIZED (SELECT node FROM deg WHERE degree = (SELECT max(degree) FROM deg)), ego AS MATERIALIZED (SELECT node FROM hub UNION SELECT nbr FROM adj JOIN hub USING (node)) SELECT e.src, e.dst, e.weight FROM edges e JOIN ego a ON a.node = e.src JOIN ego b ON b.node = e.dst")
def _ego_subgraph(g, spark, d):
    hubs = g.degrees.join(g.degrees.agg(F.max("degree").alias("degree")), "degree", "left_semi")
    return g.ego(hubs.select("node")).edges


_RANK = ", r AS (SELECT node, row_number() OVER (ORDER BY degree DESC, node) AS k FROM deg), j AS (SELECT k, sum((p_size <= 10)::INT) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)::BIGINT AS hits FROM r JOIN part ON p_partkey = node)"


def _curve(g, spark, d):
    ranking = rank.to_ranking(g.degrees.select("node", "degree"), "degree")
    return rank.recovery_curve(ranking, table(spark, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("node")))


@_on_graph("jackknife_curve", _RANK + " SELECT 'degree' AS method, k::INT AS k, hits FROM j")
def _jackknife(g, spark, d):
    return _curve(g, spark, d)


@_on_graph("jackknife_auc", _RANK + ", t AS (SELECT *, (coalesce(lag(hits) OVER (ORDER BY k), 0) + hits) / 2.0 AS s FROM j) SELECT 'degree' AS method, sum(s)::DOUBLE AS auc, max(CASE WHEN k <= 10 THEN hits END) AS hits_at_10, max(CASE WHEN k <= 20 THEN hits END) AS hits_at_20 FROM t")
def _auc(g, spark, d):
    return rank.curve_summary(_curve(g, spark, d))


@_on_graph("topk_rank_view", ", r AS (SELECT node, degree, strength, rank() OVER (ORDER BY degree DESC)::INT AS degree_rank, rank() OVER (ORDER BY strength DESC)::INT AS strength_rank FROM deg) SELECT * FROM r ORDER BY degree DESC, node LIMIT 25")
def _topk(g, spark, d):
    return rank.top_k(g.degrees, "degree", 25, "global")


@_on_graph("topk_rank_in_view", ", r AS (SELECT node, degree, strength FROM deg ORDER BY degree DESC, node LIMIT 25) SELECT *, rank() OVER (ORDER BY degree DESC)::INT AS degree_rank, rank() OVER (ORDER BY strength DESC)::INT AS strength_rank FROM r")
def _topk_view(g, spark, d):
    return rank.top_k(g.degrees, "degree", 25)


@_on_graph("top_partner_selection", ", s AS (SELECT node FROM brand WHERE cid < 'Brand#3') SELECT CASE WHEN src IN (SELECT node FROM s) THEN dst ELSE src END AS node, max(weight) AS score FROM edges WHERE (src IN (SELECT node FROM s)) <> (dst IN (SELECT node FROM s)) GROUP BY 1 ORDER BY score DESC, node LIMIT 20")
def _partners(g, spark, d):
    return ingest.top_partners(g.edges, brands(spark, d, g).where("cid < 'Brand#3'"), 20)


@_add("mapping_audit")
def _audit(spark, d):
    c = table(spark, d, "customer")
    direct = c.where("c_acctbal > 0").select(F.col("c_name").alias("query"), F.col("c_nationkey").cast("string").alias("stringId"), F.col("c_mktsegment").alias("preferredName"), F.lit(1).alias("priority"))
    fallback = c.select(F.col("c_name").alias("query"), F.col("c_custkey").cast("string").alias("stringId"), F.col("c_mktsegment").alias("preferredName"), F.lit(2).alias("priority"))
    return ingest.mapping_audit(direct, fallback)


_SQL["mapping_audit"] = """
SELECT query, "stringId", "preferredName", priority FROM (
  SELECT c_name AS query, c_nationkey::VARCHAR AS "stringId", c_mktsegment AS "preferredName", 1 AS priority FROM customer WHERE c_acctbal > 0
  UNION ALL SELECT c_name, c_custkey::VARCHAR, c_mktsegment, 2 FROM customer)
QUALIFY row_number() OVER (PARTITION BY query ORDER BY priority, "preferredName", "stringId") = 1
"""


@_add("label_disambiguation")
def _labels(spark, d):
    return ingest.label_nodes(table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("stringId"), F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string"), F.floor(F.col("c_acctbal") / 500).cast("string")).alias("preferredName")))


_SQL["label_disambiguation"] = """
WITH x AS (SELECT c_custkey::VARCHAR AS "stringId", c_mktsegment || '-' || c_nationkey || '-' || floor(c_acctbal / 500)::BIGINT AS "preferredName" FROM customer)
SELECT *, CASE WHEN count(*) OVER (PARTITION BY "preferredName") = 1 THEN "preferredName" ELSE "preferredName" || '|' || "stringId" END AS label FROM x
"""


@_add("split_identifiers")
def _split(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.concat_ws(";", "p_name", "p_type", "p_brand", "p_type").alias("text"))
    return ingest.split_identifiers(parts, key="p_partkey").select("p_partkey", "pos", "identifier")


_SQL["split_identifiers"] = """
WITH x AS (SELECT p_partkey, string_split(replace(concat_ws(';', p_name, p_type, p_brand, p_type), ';', ','), ',') AS f FROM part),
y AS (SELECT p_partkey, generate_subscripts(f, 1) - 1 AS pos, trim(unnest(f)) AS identifier FROM x)
SELECT p_partkey, min(pos)::INT AS pos, identifier FROM y WHERE identifier <> '' GROUP BY p_partkey, identifier
"""


@_on_graph("ccdc_alpha02", """, per AS (SELECT cid, count(*) AS nk, (SELECT count(*) FROM deg) AS n FROM both_ GROUP BY cid), ins AS (SELECT m.cid, m.node, count(x.node) AS din, count(*) AS dg FROM both_ m JOIN adj a ON a.node = m.node LEFT JOIN both_ x ON x.cid = m.cid AND x.node = a.nbr GROUP BY 1, 2)
 SELECT node, round(avg((din + 0.2::DOUBLE * (dg - din)) / (nk + 0.2::DOUBLE * (n - nk) - 1)), 9) AS ccdc FROM ins JOIN per USING (cid) GROUP BY node""")
def _ccdc(g, spark, d):
    return _rounded(centrality.community_degree(g, brands_and_types(spark, d, g), 0.2), "ccdc")


@_on_graph("uncovered_nodes", "SELECT node FROM deg WHERE node NOT IN (SELECT node FROM brand WHERE cid < 'Brand#3')")
def _uncovered(g, spark, d):
    return cover.uncovered(g, brands(spark, d, g).where("cid < 'Brand#3'"))


_STRONG = _SALTON + """, sal AS MATERIALIZED (SELECT src, dst, weight, "both" / sqrt(u.degree::DOUBLE * v.degree) AS salton FROM cn JOIN edges USING (src, dst) JOIN deg u ON u.node = src JOIN deg v ON v.node = dst)"""
_LINKS = """, both_ways AS MATERIALIZED (SELECT src AS node, dst AS nbr FROM kept UNION ALL SELECT dst, src FROM kept),
 lab AS (SELECT node, node AS k FROM deg UNION SELECT l.nbr, p.k FROM lab p JOIN both_ways l ON l.node = p.node WHERE p.k < l.nbr), part_ AS MATERIALIZED (SELECT node, min(k) AS component FROM lab GROUP BY node)"""
_CN = _STRONG + ", kept AS MATERIALIZED (SELECT src, dst FROM sal WHERE salton >= 0.4)" + _LINKS


@_on_graph(
    "cn_ocd_cover",
    """, per AS (SELECT component, count(*) AS n, min(node) AS a, max(node) AS b FROM part_ GROUP BY 1),
 grp AS MATERIALIZED (SELECT component AS cid, node FROM part_ JOIN per USING (component) WHERE n > 1 UNION SELECT component, p.nbr FROM per JOIN adj p ON p.node = a JOIN adj q ON q.node = b AND q.nbr = p.nbr WHERE n = 2),
 free AS (SELECT node FROM part_ JOIN per USING (component) WHERE n = 1), hits AS (SELECT f.node, g.cid, count(*) AS h FROM free f JOIN adj a ON a.node = f.node JOIN grp g ON g.node = a.nbr GROUP BY 1, 2),
 best AS (SELECT cid, node FROM hits QUALIFY rank() OVER (PARTITION BY node ORDER BY h DESC) = 1)
 SELECT cid, node FROM grp UNION SELECT cid, node FROM best UNION SELECT node, node FROM free WHERE node NOT IN (SELECT node FROM best)""",
    _CN,
)
def _cn_cover(g, spark, d):
    return detect.common_neighbour_cover(g, 0.4)


@_on_graph("cn_ocd_components", " SELECT node, component FROM part_", _CN)
def _cn_components(g, spark, d):
    return detect.salton_components(g, 0.4)


@_on_graph(
    "umstmo",
    ", found AS (SELECT component AS k, node FROM part_)" + _NUMBERED,
    _STRONG + """, ends_ AS (SELECT src AS node, * FROM sal UNION ALL SELECT dst, * FROM sal),
 kept AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT * FROM ends_ QUALIFY row_number() OVER (PARTITION BY node ORDER BY weight DESC, salton DESC, src DESC, dst DESC) = 1))""" + _LINKS,
)
def _umstmo(g, spark, d):
    return cover.relabel(detect.first_contraction(g))


@_on_graph("umstmo_cover")
def _umstmo_cover(g, spark, d):
    return cover.relabel(detect.umstmo(g))


@_on_graph(
    "spanning_union",
    " SELECT e.src, e.dst, e.weight FROM edges e JOIN lab p ON p.w = e.weight AND p.node = e.src JOIN lab q ON q.w = e.weight AND q.node = e.dst WHERE p.c <> q.c",
    """, lab(w, node, c) USING KEY (w, node) AS (SELECT w, node, node FROM (SELECT DISTINCT weight AS w FROM edges), deg UNION
  SELECT l.w, a.nbr, min(l.c) FROM lab l JOIN adj a ON a.node = l.node AND a.weight > l.w JOIN recurring.lab r ON r.w = l.w AND r.node = a.nbr WHERE l.c < r.c GROUP BY 1, 2)""",
)
def _spanning_union(g, spark, d):
    return spanning.spanning_union(g.edges)


def queries() -> dict[str, Query]:
    from weft import catalog_ingest, catalog_suppliers  # noqa: F401  they add theirs

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
