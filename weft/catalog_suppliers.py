"""Registered queries of paths, centralities and covers on the graph of suppliers.

Nodes are suppliers; an edge joins two that serve unusually many orders together,
more than the mean of all pairs by 1.3 standard deviations. Its crisp partition
is the nation; its overlapping cover has the nations, up to number 19, and bands of
the balance above zero, so that some nodes have no community.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.catalog import _QUERIES, _SQL, _rounded, table
from weft.graph import Graph, shared_pairs
from weft.operators import boundary, centrality, cover, growth, metrics, rank
from weft.plans import detect
from weft.plans.lineage import cut

ALPHA = 0.2


def supplier_graph(spark: SparkSession, sf_dir: str) -> Graph:
    pairs = cut(shared_pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey"))
    least = pairs.agg((F.avg("weight") + 1.3 * F.stddev_pop("weight")).alias("least"))
    made = Graph.from_edges(pairs.crossJoin(least).where("weight >= least"))  # a single row
    return Graph(cut(made.nodes), cut(made.edges))


def nations(spark: SparkSession, sf_dir: str, g: Graph) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("cid"), F.col("s_suppkey").alias("node")).join(g.nodes, "node", "left_semi").select("cid", "node")


def bands(spark: SparkSession, sf_dir: str, g: Graph) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select((1000 + F.floor(F.col("s_acctbal") / 1000)).cast("long").alias("cid"), F.col("s_suppkey").alias("node"))
    return nations(spark, sf_dir, g).where("cid < 20").unionByName(rows.join(g.nodes, "node", "left_semi").select("cid", "node"))


_BASE = """
sop AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
spairs AS MATERIALIZED (SELECT a.l_suppkey AS src, b.l_suppkey AS dst, count(*)::DOUBLE AS weight FROM sop a JOIN sop b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2),
edges AS MATERIALIZED (SELECT * FROM spairs WHERE weight >= (SELECT avg(weight) + 1.3::DOUBLE * stddev_pop(weight) FROM spairs)),
adj AS MATERIALIZED (SELECT src AS node, dst AS nbr, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges),
deg AS MATERIALIZED (SELECT node, count(*) AS degree, sum(weight) AS strength FROM adj GROUP BY node),
nat AS MATERIALIZED (SELECT s_nationkey::BIGINT AS cid, s_suppkey AS node FROM supplier WHERE s_suppkey IN (SELECT node FROM deg)),
cov AS MATERIALIZED (SELECT * FROM nat WHERE cid < 20 UNION ALL SELECT (1000 + floor(s_acctbal / 1000))::BIGINT, s_suppkey FROM supplier WHERE s_acctbal > 0 AND s_suppkey IN (SELECT node FROM deg)),
nn AS (SELECT count(*)::DOUBLE AS n FROM deg)"""
_PATHS = """,
paths(source, node, d, sigma) USING KEY (source, node) AS (
  SELECT node, node, 0, 1.0::DOUBLE FROM deg UNION
  SELECT x.source, a.nbr, (min(x.d) + 1)::INT, sum(x.sigma) FROM paths x JOIN adj a ON a.node = x.node LEFT JOIN recurring.paths r ON r.source = x.source AND r.node = a.nbr WHERE r.node IS NULL GROUP BY 1, 2),
preds AS MATERIALIZED (SELECT p.source, p.node, q.node AS pred, q.sigma / p.sigma AS share, 1.0::DOUBLE / count(*) OVER (PARTITION BY p.source, p.node) AS even
  FROM paths p JOIN adj a ON a.node = p.node JOIN paths q ON q.source = p.source AND q.node = a.nbr AND q.d = p.d - 1 WHERE p.d > 1)"""


def _flow(name: str, start: str, share: str = "share", scope: str = "") -> str:
    """What starts at the ends of paths and goes back to the sources, hop by hop."""
    keys = f"{scope}, source" if scope else "source"
    own = f"f.{scope}, f.source" if scope else "f.source"
    return f""",
{name}(hop, {keys}, node, amount) AS (
  SELECT 0, {keys}, node, 1.0::DOUBLE FROM {start} UNION ALL
  SELECT f.hop + 1, {own}, p.pred, sum(f.amount * p.{share}) FROM {name} f JOIN preds p ON p.source = f.source AND p.node = f.node GROUP BY f.hop, {own}, p.pred)"""


_START = ", all_ends AS (SELECT source, node FROM paths WHERE d > 0)"


def _add(name: str, sql: str | None = None, recursive: str = ""):
    def put(f):
        _QUERIES[name] = lambda spark, sf_dir: f(supplier_graph(spark, sf_dir), spark, sf_dir)
        if sql:
            _SQL[name] = f"WITH RECURSIVE {_BASE}{recursive} {sql}"
        return f

    return put


@_add("supplier_edges", "SELECT src, dst, weight FROM edges")
def _edges(g, spark, d):
    return g.edges


@_add(
    "betweenness",
    " SELECT node, round(coalesce(b, 0) / ((n - 1) * (n - 2)), 9) AS betweenness FROM deg LEFT JOIN (SELECT node, sum(amount) AS b FROM flow WHERE hop > 0 GROUP BY 1) USING (node), nn",
    _PATHS + _START + _flow("flow", "all_ends"),
)
def _betweenness(g, spark, d):
    return _rounded(centrality.betweenness(g), "betweenness")


@_add(
    "load_centrality",
    " SELECT node, round(coalesce(b, 0) / ((n - 1) * (n - 2)), 9) AS load FROM deg LEFT JOIN (SELECT node, sum(amount) AS b FROM flow WHERE hop > 0 GROUP BY 1) USING (node), nn",
    _PATHS + _START + _flow("flow", "all_ends", "even"),
)
def _load(g, spark, d):
    return _rounded(centrality.betweenness(g, load=True), "load")


_CLOSE = "close AS (SELECT source AS node, sum(d)::DOUBLE AS st, count(*) - 1 AS r FROM paths GROUP BY 1)"


@_add(
    "basic_centralities",
    f""", {_CLOSE}, b AS (SELECT node, sum(amount) AS b FROM flow WHERE hop > 0 GROUP BY 1)
 SELECT node, round(degree / (n - 1), 9) AS degree, round(r / (n - 1) * r / st, 9) AS closeness, round(coalesce(b, 0) / ((n - 1) * (n - 2)), 9) AS betweenness FROM deg JOIN close USING (node) LEFT JOIN b USING (node), nn""",
    _PATHS + _START + _flow("flow", "all_ends"),
)
def _basic(g, spark, d):
    return _rounded(centrality.degree_centrality(g).join(centrality.path_centralities(g), "node"), "degree", "closeness", "betweenness")


@_add(
    "katz_centrality",
    " SELECT node, round(x / sqrt(sum(x * x) OVER ()), 7) AS katz FROM k WHERE step = 60",
    ", k(step, node, x) AS (SELECT 0, node, 0.0::DOUBLE FROM deg UNION ALL SELECT k.step + 1, a.node, 0.0005::DOUBLE * sum(a.weight * k.x) + 1 FROM k JOIN adj a ON a.nbr = k.node WHERE k.step < 60 GROUP BY k.step, a.node)",
)
def _katz(g, spark, d):
    return _rounded(centrality.katz(g, alpha=0.0005, tolerance=1e-12), "katz", digits=7)


@_add(
    "eigenvector_centrality",
    " SELECT node, round(x / sqrt(sum(x * x) OVER ()), 5) AS eigenvector FROM v WHERE step = 300",
    """, own AS MATERIALIZED (SELECT node, nbr, weight FROM adj UNION ALL SELECT node, node, 1.0::DOUBLE FROM deg),
 v(step, node, x) AS (SELECT 0, node, 1.0::DOUBLE FROM deg UNION ALL SELECT step + 1, node, x / max(x) OVER () FROM (SELECT v.step, o.node, sum(o.weight * v.x) AS x FROM v JOIN own o ON o.nbr = v.node WHERE v.step < 300 GROUP BY v.step, o.node))""",
)
def _eigenvector(g, spark, d):
    return _rounded(centrality.eigenvector(g, tolerance=1e-10, cut_every=8), "eigenvector", digits=5)


@_add(
    "subgraph_centrality",
    " SELECT a AS node, round(sum(x), 3) AS subgraph FROM walk WHERE a = b GROUP BY 1",
    ", walk(step, a, b, x) AS (SELECT 0, node, node, 1.0::DOUBLE FROM deg UNION ALL SELECT w.step + 1, w.a, j.nbr, sum(w.x) / (w.step + 1) FROM walk w JOIN adj j ON j.node = w.b WHERE w.step < 80 GROUP BY w.step, w.a, j.nbr)",
)
def _subgraph(g, spark, d):
    return _rounded(centrality.spectral(g, "subgraph"), "subgraph", digits=3)


_PER = f"""per AS (SELECT cid, count(*)::DOUBLE AS nk FROM cov GROUP BY 1),
 ins AS (SELECT m.cid, m.node, count(x.node) AS din FROM cov m JOIN adj a ON a.node = m.node LEFT JOIN cov x ON x.cid = m.cid AND x.node = a.nbr GROUP BY 1, 2),
 {_CLOSE}, glob_b AS (SELECT node, coalesce(sum(amount), 0) / 2 AS bg FROM deg LEFT JOIN (SELECT node, amount FROM flow WHERE hop > 0) USING (node) GROUP BY 1)"""
_TERMS = f"""terms AS (
  SELECT m.cid, m.node, nk, n, nk + {ALPHA}::DOUBLE * (n - nk) - 1 AS span, din, degree, coalesce(si, 0) AS si, st, CASE WHEN nk < 3 THEN 0 ELSE least(coalesce(bi, 0), bg) END AS bi, bg, (n - 1) * (n - 2) / 2 AS pg, CASE WHEN nk < 3 THEN 0 ELSE (nk - 1) * (nk - 2) / 2 END AS pk
  FROM cov m JOIN per USING (cid) JOIN ins USING (cid, node) JOIN deg USING (node) JOIN close USING (node) JOIN glob_b USING (node) LEFT JOIN near USING (cid, node) LEFT JOIN inner_b USING (cid, node), nn),
 vals AS (SELECT node, (din + {ALPHA}::DOUBLE * (degree - din)) / span AS ccdc, span / nullif(si + {ALPHA}::DOUBLE * (st - si), 0) AS cccc, (bi + {ALPHA}::DOUBLE * (bg - bi)) / (pk + {ALPHA}::DOUBLE * (pg - pk)) AS ccbc FROM terms)"""
_NAMES = ("ccdc", "cccc", "ccbc")
_ROUND = ", ".join(f"round({c}, 9) AS {c}" for c in _NAMES)


def _community(name: str, sql: str, recursive: str, *given) -> None:
    @_add(name, sql, recursive)
    def _run(g, spark, d):
        return _rounded(centrality.community_centralities(g, bands(spark, d, g), ALPHA, *given), *_NAMES)


_WHOLE = _PATHS + _START + _flow("flow", "all_ends") + ", inner_ends AS (SELECT a.cid, a.node AS source, b.node FROM cov a JOIN cov b ON a.cid = b.cid AND a.node <> b.node JOIN paths p ON p.source = a.node AND p.node = b.node)" + _flow("inner_flow", "inner_ends", scope="cid")
_GRAPH = f""", {_PER}, near AS (SELECT a.cid, a.node, sum(p.d)::DOUBLE AS si FROM cov a JOIN cov b ON a.cid = b.cid JOIN paths p ON p.source = a.node AND p.node = b.node GROUP BY 1, 2),
 inner_b AS (SELECT f.cid, f.node, sum(amount) / 2 AS bi FROM inner_flow f WHERE hop > 0 GROUP BY 1, 2), {_TERMS}"""
_community(
    "community_centralities",
    _GRAPH + f""", agg AS (SELECT node, avg(ccdc) AS ccdc, CASE WHEN count(cccc) = count(*) THEN avg(cccc) END AS cccc, avg(ccbc) AS ccbc FROM vals GROUP BY 1),
 rest AS (SELECT node, degree / (n - 1) AS ccdc, r / (n - 1) * r / st AS cccc, bg / ((n - 1) * (n - 2) / 2) AS ccbc FROM deg JOIN close USING (node) JOIN glob_b USING (node), nn WHERE node NOT IN (SELECT node FROM cov))
 SELECT node, {_ROUND} FROM (SELECT * FROM agg UNION ALL SELECT * FROM rest)""",
    _WHOLE,
)
_INDUCED_PATHS = """,
iadj AS MATERIALIZED (SELECT m.cid, a.node, a.nbr FROM cov m JOIN adj a ON a.node = m.node JOIN cov x ON x.cid = m.cid AND x.node = a.nbr),
ipaths(cid, source, node, d, sigma) USING KEY (cid, source, node) AS (
  SELECT cid, node, node, 0, 1.0::DOUBLE FROM cov UNION
  SELECT x.cid, x.source, a.nbr, (min(x.d) + 1)::INT, sum(x.sigma) FROM ipaths x JOIN iadj a ON a.cid = x.cid AND a.node = x.node LEFT JOIN recurring.ipaths r ON r.cid = x.cid AND r.source = x.source AND r.node = a.nbr WHERE r.node IS NULL GROUP BY 1, 2, 3),
ipreds AS MATERIALIZED (SELECT p.cid, p.source, p.node, q.node AS pred, q.sigma / p.sigma AS share FROM ipaths p JOIN iadj a ON a.cid = p.cid AND a.node = p.node JOIN ipaths q ON q.cid = p.cid AND q.source = p.source AND q.node = a.nbr AND q.d = p.d - 1 WHERE p.d > 1),
iflow(hop, cid, source, node, amount) AS (
  SELECT 0, cid, source, node, 1.0::DOUBLE FROM ipaths WHERE d > 0 UNION ALL
  SELECT f.hop + 1, f.cid, f.source, p.pred, sum(f.amount * p.share) FROM iflow f JOIN ipreds p ON p.cid = f.cid AND p.source = f.source AND p.node = f.node GROUP BY f.hop, f.cid, f.source, p.pred)"""
_INDUCED = f""", {_PER}, near AS (SELECT cid, source AS node, sum(d)::DOUBLE AS si FROM ipaths GROUP BY 1, 2), inner_b AS (SELECT cid, node, sum(amount) / 2 AS bi FROM iflow WHERE hop > 0 GROUP BY 1, 2), {_TERMS}"""
for _name, _how, _given in (("community_centralities_induced", "avg", ("induced",)), ("community_centralities_induced_max", "max", ("induced", "max"))):
    _community(
        _name,
        _INDUCED + f", agg AS (SELECT node, {', '.join(f'{_how}({c}) AS {c}' for c in _NAMES)} FROM vals GROUP BY 1) SELECT node, {', '.join(f'round(coalesce({c}, 0), 9) AS {c}' for c in _NAMES)} FROM deg LEFT JOIN agg USING (node)",
        _PATHS + _START + _flow("flow", "all_ends") + _INDUCED_PATHS,
        *_given,
    )


_PANEL = """, o AS (SELECT node, count(*) AS t FROM cov GROUP BY 1), m2 AS (SELECT sum(strength) AS m2, sum(degree) // 2 AS m FROM deg),
 si AS (SELECT sum(2 * weight / (ou.t * ov.t)) AS x FROM edges JOIN cov a ON a.node = src JOIN cov b ON b.node = dst AND a.cid = b.cid JOIN o ou ON ou.node = src JOIN o ov ON ov.node = dst),
 sk AS (SELECT sum(k * k) AS y FROM (SELECT cid, sum(strength / t) AS k FROM cov JOIN deg USING (node) JOIN o USING (node) GROUP BY cid)),
 sz AS (SELECT cid, count(*) AS size FROM cov GROUP BY 1), prim AS (SELECT node, cid FROM cov JOIN sz USING (cid) QUALIFY row_number() OVER (PARTITION BY node ORDER BY size DESC, cid) = 1),
 crisp AS (SELECT node, coalesce('c' || cid, 'n' || node) AS cid FROM deg LEFT JOIN prim USING (node)),
 ci AS (SELECT coalesce(sum(weight), 0) AS x FROM edges JOIN crisp a ON a.node = src JOIN crisp b ON b.node = dst WHERE a.cid = b.cid), ck AS (SELECT sum(k * k) AS y FROM (SELECT sum(strength) AS k FROM crisp JOIN deg USING (node) GROUP BY cid)),
 ins AS (SELECT m.cid, m.node, count(x.node) AS inside, count(*) AS degree FROM cov m JOIN adj a ON a.node = m.node LEFT JOIN cov x ON x.cid = m.cid AND x.node = a.nbr GROUP BY 1, 2),
 ine AS (SELECT a.cid, src, dst FROM edges JOIN cov a ON a.node = src JOIN cov b ON b.node = dst AND b.cid = a.cid), ia AS (SELECT cid, src AS node, dst AS nbr FROM ine UNION ALL SELECT cid, dst, src FROM ine),
 tri AS (SELECT x.cid, x.node, count(*) AS t FROM ia x JOIN ia y ON x.cid = y.cid AND x.node = y.node JOIN ine e ON e.cid = x.cid AND e.src = x.nbr AND e.dst = y.nbr GROUP BY 1, 2),
 one AS (SELECT cid, count(*) AS size, sum(inside) / 2 AS inner_n, sum(degree - inside) AS cut, sum((2 * inside - degree)::DOUBLE / (degree * o.t)) AS balance, avg(CASE WHEN inside > 1 THEN 2.0::DOUBLE * coalesce(tri.t, 0) / (inside * (inside - 1)) ELSE 0 END) AS trans
   FROM ins JOIN o USING (node) LEFT JOIN tri USING (cid, node) GROUP BY cid),
 calc AS (SELECT *, coalesce(2.0::DOUBLE * inner_n / nullif(size * (size - 1), 0), 0) AS density, CASE WHEN size = 1 THEN 1 ELSE coalesce(cut::DOUBLE / nullif(2 * inner_n + cut, 0), 0) END AS cond, coalesce(cut::DOUBLE / nullif(2 * (m - inner_n) + cut, 0), 0) AS rest FROM one, m2),
 memb AS (SELECT node, count(DISTINCT cid) AS k FROM deg LEFT JOIN cov USING (node) GROUP BY 1)
"""


@_add(
    "metric_panel",
    _PANEL + """ SELECT round((SELECT x FROM si) / m2 - (SELECT y FROM sk) / (m2 * m2), 9) AS shen_modularity, (SELECT round(avg(balance / size * density), 9) FROM calc) AS modularity_overlap,
 round((SELECT x FROM ci) / (m2 / 2) - (SELECT y FROM ck) / (m2 * m2), 9) AS modularity, (SELECT round(avg(density), 9) FROM calc) AS internal_edge_density, (SELECT round(avg(cond), 9) FROM calc) AS conductance,
 (SELECT round(avg(cond + rest), 9) FROM calc) AS normalized_cut, (SELECT round(avg(trans), 9) FROM calc) AS avg_transitivity, (SELECT count(*) FROM sz) AS n_communities, (SELECT max(size) FROM sz) AS max_community_size,
 (SELECT round(avg((k > 0)::INT), 9) FROM memb) AS coverage_ratio, (SELECT round(avg((k = 0)::INT), 9) FROM memb) AS uncovered_node_ratio, (SELECT round(avg((k > 1)::INT), 9) FROM memb) AS overlap_node_ratio,
 (SELECT round(avg(CASE WHEN k > 0 THEN k END), 9) FROM memb) AS avg_memberships_per_covered_node, (SELECT round(avg(CASE WHEN k > 1 THEN k END), 9) FROM memb) AS overlap_intensity FROM m2""",
)
def _panel(g, spark, d):
    out = metrics.panel(g, bands(spark, d, g))
    return _rounded(out, *(c for c in out.columns if c not in ("n_communities", "max_community_size")))


@_add("shen_modularity_penalised", _PANEL + " SELECT round((SELECT x FROM si) / m2 - (SELECT y FROM sk) / (m2 * m2) - 0.01::DOUBLE * (SELECT sum(t - 1) FROM o), 9) AS shen_modularity FROM m2")
def _penalised(g, spark, d):
    return _rounded(metrics.shen_modularity(g, bands(spark, d, g), 0.01), "shen_modularity")


@_add("crisp_projection", _PANEL + " SELECT node, cid FROM crisp")
def _crisp(g, spark, d):
    return cover.crisp_projection(g, bands(spark, d, g))


@_add("membership_lists", " SELECT node, string_agg(DISTINCT cid + 1, ',' ORDER BY cid + 1) AS memberships, count(DISTINCT cid) AS n_memberships FROM cov GROUP BY node")
def _lists(g, spark, d):
    return cover.membership_lists(bands(spark, d, g)).withColumn("memberships", F.concat_ws(",", F.col("memberships").cast("array<string>")))


@_add(
    "displayed_cover",
    """, twice AS (SELECT cid, node FROM cov UNION ALL SELECT cid + 5000, node FROM cov), same AS (SELECT min(cid) AS cid, size FROM (SELECT cid, string_agg(node, ',' ORDER BY node) AS l, count(*) AS size FROM twice GROUP BY 1) GROUP BY l, size),
 kept AS (SELECT cid, size, min(node) AS least FROM same JOIN twice USING (cid) WHERE size >= 3 GROUP BY ALL), ord AS (SELECT cid, (row_number() OVER (ORDER BY size DESC, least, cid) - 1)::INT AS k FROM kept)
 SELECT k AS cid, node FROM ord JOIN twice USING (cid)""",
)
def _displayed(g, spark, d):
    m = bands(spark, d, g)
    return cover.postprocess(m.unionByName(m.withColumn("cid", F.col("cid") + 5000)), 3)


@_add("meta_graph_double", " SELECT least(a.cid, b.cid) AS c1, greatest(a.cid, b.cid) AS c2, sum(CASE WHEN a.cid = b.cid THEN weight ELSE 2 * weight END) AS weight FROM edges JOIN nat a ON a.node = src JOIN nat b ON b.node = dst GROUP BY 1, 2")
def _double(g, spark, d):
    return cover.contract(g, nations(spark, d, g), double_cross=True)


@_add("supplier_interaction", " SELECT a.cid AS cid1, b.cid AS cid2, count(*) AS shared FROM cov a JOIN cov b ON a.node = b.node AND a.cid < b.cid GROUP BY 1, 2")
def _interaction(g, spark, d):
    return cover.interaction(bands(spark, d, g))


@_add("modularity_resolution", """, i AS (SELECT coalesce(sum(weight), 0) AS x FROM edges JOIN nat a ON a.node = src JOIN nat b ON b.node = dst WHERE a.cid = b.cid), k AS (SELECT sum(k * k) AS y FROM (SELECT sum(strength) AS k FROM nat JOIN deg USING (node) GROUP BY cid)), w AS (SELECT sum(weight) AS m FROM edges)
 SELECT round(x / m - 1.5::DOUBLE * y / (4 * m * m), 9) AS modularity FROM i, k, w""")
def _resolution(g, spark, d):
    return _rounded(metrics.modularity(g, nations(spark, d, g), 1.5), "modularity")


@_add(
    "merge_pairs",
    """, sz AS (SELECT cid, count(*) AS s FROM cov GROUP BY 1), sh AS (SELECT a.cid AS cid1, b.cid AS cid2, count(*) AS both_n FROM cov a JOIN cov b ON a.node = b.node AND a.cid < b.cid GROUP BY 1, 2)
 SELECT cid1, cid2 FROM sh JOIN sz x ON x.cid = cid1 JOIN sz y ON y.cid = cid2 WHERE both_n::DOUBLE / least(x.s, y.s) >= 0.3 AND both_n / sqrt(x.s::DOUBLE * y.s) >= 0.25""",
)
def _merge_pairs(g, spark, d):
    return boundary.merge_pairs(g, bands(spark, d, g), "salton", 0.25, 0.3)


@_add("ranking_panel", f""", {_CLOSE}, val AS (SELECT 'degree' AS method, node, degree::DOUBLE AS x FROM deg UNION ALL SELECT 'closeness', node, round(r / (n - 1) * r / st, 12) FROM deg JOIN close USING (node), nn)
 SELECT method, row_number() OVER (PARTITION BY method ORDER BY x DESC, node)::INT AS rank, node FROM val""", _PATHS)
def _rankings(g, spark, d):
    scores = {"degree": centrality.degree_centrality(g), "closeness": _rounded(centrality.closeness(g), "closeness", digits=12)}
    return rank.to_ranking(scores["degree"], "degree").unionByName(rank.to_ranking(scores["closeness"], "closeness"))


@_add("top_detail", """, r AS (SELECT node, row_number() OVER (ORDER BY degree DESC, node)::INT AS rank FROM deg), sets AS (SELECT 's' || cid AS hallmark, node FROM cov)
 SELECT 'degree' AS method, rank, node, count(hallmark) > 0 AS hit, coalesce(string_agg(hallmark, ';' ORDER BY hallmark), '') AS sets FROM r LEFT JOIN sets USING (node) WHERE rank <= 30 GROUP BY rank, node""")
def _detail(g, spark, d):
    sets = bands(spark, d, g).select(F.concat(F.lit("s"), F.col("cid").cast("string")).alias("hallmark"), F.col("node").alias("gene"))
    return rank.top_detail(rank.to_ranking(g.degrees.select("node", "degree"), "degree"), sets, 30)


@_add("community_page", """, per AS (SELECT cid, count(*) AS size, min(node) AS least FROM cov GROUP BY 1), ord AS (SELECT cid, size, row_number() OVER (ORDER BY size DESC, least, cid)::INT AS community_id FROM per)
 SELECT community_id, size, string_agg(node, ',' ORDER BY node) AS nodes FROM ord JOIN cov USING (cid) WHERE community_id BETWEEN 11 AND 20 GROUP BY ALL""")
def _page(g, spark, d):
    return cover.page(cover.relabel(bands(spark, d, g)), 2, 10).withColumn("nodes", F.concat_ws(",", F.col("nodes").cast("array<string>")))


@_add("degree_texts", ' SELECT node, printf(\'%.4f\', degree / (n - 1)) AS degree FROM deg, nn')
def _texts(g, spark, d):
    return rank.as_texts(centrality.degree_centrality(g), 4)


@_add("jackknife_thinned", ", j AS (SELECT row_number() OVER (ORDER BY degree DESC, node)::INT AS k, node FROM deg), h AS (SELECT k, sum((cid IS NOT NULL)::INT) OVER (ORDER BY k)::BIGINT AS hits, count(*) OVER () AS n FROM j LEFT JOIN (SELECT * FROM nat WHERE cid < 5) USING (node)) SELECT 'degree' AS method, k, hits FROM h WHERE (k - 1) % greatest(1, n // 40) = 0")
def _thinned(g, spark, d):
    curve = rank.recovery_curve(rank.to_ranking(g.degrees.select("node", "degree"), "degree"), nations(spark, d, g).where("cid < 5"))
    return rank.thinned(curve, "k", 40)


@_add("detector_runs")
def _runs(g, spark, d):
    from weft.plans.runner import run_all

    runs, _ = run_all(g, include=("COBS", "CN_OCD", "GREEDY_MODULARITY", "KCLIQUE", "EGONET", "UMSTMO", "COVER_REFINE"), seconds=120)
    return runs.select("algo_key", "status", "n_nodes", "n_edges", "n_communities", F.round("modularity", 6).alias("modularity"))


@_add("cobs_communities")
def _cobs(g, spark, d):
    return cover.relabel(detect.boundary_overlap(g, theta_sim=0.3))


@_add("builtin_rankings", f""", {_CLOSE}, b AS (SELECT node, sum(amount) AS b FROM flow WHERE hop > 0 GROUP BY 1),
 val AS (SELECT 'degree' AS method, node, round(degree / (n - 1), 12) AS x FROM deg, nn UNION ALL SELECT 'closeness', node, round(r / (n - 1) * r / st, 12) FROM deg JOIN close USING (node), nn
  UNION ALL SELECT 'betweenness', node, round(coalesce(b, 0) / ((n - 1) * (n - 2)), 12) FROM deg LEFT JOIN b USING (node), nn)
 SELECT method, row_number() OVER (PARTITION BY method ORDER BY x DESC, node)::INT AS rank, node FROM val""", _PATHS + _START + _flow("flow", "all_ends"))
def _builtin(g, spark, d):
    return rank.builtin_rankings(g)[0]


@_add(
    "community_rankings",
    _INDUCED + f""", agg AS (SELECT node, {', '.join(f'avg({c}) AS {c}' for c in _NAMES)} FROM vals GROUP BY 1),
 val AS ({' UNION ALL '.join(f"SELECT '{c}_alpha={ALPHA:g}' AS method, node, round(coalesce({c}, 0), 12) AS x FROM deg LEFT JOIN agg USING (node)" for c in _NAMES)})
 SELECT method, row_number() OVER (PARTITION BY method ORDER BY x DESC, node)::INT AS rank, node FROM val""",
    _PATHS + _START + _flow("flow", "all_ends") + _INDUCED_PATHS,
)
def _community_rankings(g, spark, d):
    return rank.community_rankings(g, bands(spark, d, g), (ALPHA,))


def _bits(part: str, whole: str = "u.degree") -> str:
    """Entropy of a share in billionths of a bit."""
    p = f"(({part}) / {whole})"
    return f"CASE WHEN {part} <= 0 OR {part} >= {whole} THEN 0 ELSE round((-{p} * log2({p}) - (1 - {p}) * log2(1 - {p})) * 1e9)::BIGINT END"


# Ego networks as communities: what a step of growth from them does.
_SURROUNDINGS = """, ego AS MATERIALIZED (SELECT node AS cid, node FROM deg UNION ALL SELECT node, nbr FROM adj), lnk AS MATERIALIZED (SELECT c.cid, a.nbr AS node, count(*) AS links FROM ego c JOIN adj a ON a.node = c.node GROUP BY 1, 2),
 near AS MATERIALIZED (SELECT l.cid, l.node, links, c.node IS NOT NULL AS inside FROM lnk l LEFT JOIN ego c ON c.cid = l.cid AND c.node = l.node), own AS (SELECT cid, count(*) AS size, sum(links)::BIGINT AS inner_ FROM near WHERE inside GROUP BY 1)"""


def ego_surroundings(g: Graph) -> DataFrame:
    members = g.nodes.select(F.col("node").alias("seed"), "node").unionByName(g.adj.select(F.col("node").alias("seed"), F.col("nbr").alias("node")))
    rows, own = growth.surroundings(g, members)
    return rows.join(own, "seed")


@_add("entropy_changes", f"""{_SURROUNDINGS}, was AS (SELECT r.cid, r.node, r.inside, a.nbr, coalesce(l.links, 0) AS k FROM near r JOIN adj a ON a.node = r.node LEFT JOIN lnk l ON l.cid = r.cid AND l.node = a.nbr)
 SELECT cid, w.node, inside, sum({_bits("(k + CASE WHEN inside THEN -1 ELSE 1 END)")} - {_bits("k")})::BIGINT AS change FROM was w JOIN deg u ON u.node = w.nbr GROUP BY 1, 2, 3""")
def _entropy_changes(g, spark, d):
    return growth.entropy_changes(g, ego_surroundings(g)).select(F.col("seed").alias("cid"), "node", "inside", "change")


@_add("density_steps", f"""{_SURROUNDINGS} SELECT cid, node FROM near JOIN own USING (cid) WHERE NOT inside AND (inner_ + 2 * links) / (size * (size + 1)) >= 0.2::DOUBLE AND links * (size - 1) >= 0.6::DOUBLE * inner_
 QUALIFY row_number() OVER (PARTITION BY cid ORDER BY links DESC, node) = 1""")
def _density_steps(g, spark, d):
    return growth.by_density(0.2, 0.6)(ego_surroundings(g)).select(F.col("seed").alias("cid"), "node")


@_add("interaction_steps", f"""{_SURROUNDINGS}, w AS (SELECT a.node, count(*) AS w FROM adj a JOIN adj b ON b.node = a.nbr JOIN adj c ON c.node = b.nbr AND c.nbr = a.node GROUP BY 1),
 able AS (SELECT cid, node, links, size FROM near JOIN own USING (cid) WHERE NOT inside AND links / size >= 0.2::DOUBLE), one AS (SELECT b.cid, b.node, a.nbr AS m FROM able b JOIN adj a ON a.node = b.node JOIN ego e ON e.cid = b.cid AND e.node = a.nbr),
 two AS (SELECT o.cid, o.node, a.nbr AS m FROM one o JOIN adj a ON a.node = o.m JOIN ego e ON e.cid = o.cid AND e.node = a.nbr), reach AS (SELECT cid, node, count(*) AS reached FROM (SELECT * FROM one UNION SELECT * FROM two) GROUP BY 1, 2)
 SELECT cid, node FROM able JOIN reach USING (cid, node) LEFT JOIN w USING (node) WHERE reached = size QUALIFY row_number() OVER (PARTITION BY cid ORDER BY links DESC, coalesce(w, 0) DESC, node) = 1""")
def _interaction_steps(g, spark, d):
    return growth.by_interaction(g, cut(detect.closeness_of_ends(g, False)), 0.2)(ego_surroundings(g)).select(F.col("seed").alias("cid"), "node")
