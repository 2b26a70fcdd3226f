"""Registered queries of the parsers and of the graph builder, on lines and records made of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.catalog import _QUERIES, _SQL, table
from weft.graph import Graph, shared_pairs
from weft.plans.lineage import cut
from weft.sources import ingest


def _add(name: str, sql: str | None = None):
    def put(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def _tabs(*columns) -> F.Column:
    return F.concat_ws("\t", *columns)


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("long").alias("p_size"))
    return table(spark, d, "lineitem").join(part, "l_partkey").select(F.nullif("l_suppkey", F.lit(7)).alias("src"), F.col("p_size").alias("dst"), F.nullif("l_discount", F.lit(0.0)).alias("weight"))


_DIRTY = "WITH x AS (SELECT nullif(l_suppkey, 7) AS src, p_size::BIGINT AS dst, nullif(l_discount, 0.0) AS weight FROM lineitem JOIN part ON p_partkey = l_partkey)"


@_add("canonical_dirty_edges", _DIRTY + " SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(weight) AS weight FROM x WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst AND weight IS NOT NULL GROUP BY 1, 2")
def _canonical(spark, d):
    return Graph.from_edges(_dirty(spark, d)).edges


@_add("canonical_unweighted_edges", _DIRTY + " SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst, 1.0::DOUBLE AS weight FROM x WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
def _unweighted(spark, d):
    return Graph.from_edges(_dirty(spark, d), weight=None).edges


@_add("identifier_lines", "WITH x AS (SELECT p_partkey, unnest([p_name, p_type, p_name || ' x;y']) AS identifier, unnest([0, 2, 3]) AS pos FROM part) SELECT p_partkey, min(pos)::INT AS pos, trim(identifier) AS identifier FROM x GROUP BY 1, 3")
def _lines(spark, d):
    text = F.concat(F.col("p_name"), F.lit("\r\n \r"), F.col("p_type"), F.lit("\n"), F.col("p_name"), F.lit(" x;y"))
    return ingest.split_identifiers(table(spark, d, "part").select("p_partkey", text.alias("text")), key="p_partkey", mode="lines").select("p_partkey", "pos", "identifier")


def _gene_lines(spark: SparkSession, d: str) -> DataFrame:
    tabbed = F.concat(F.lit(" "), _tabs("p_brand", F.concat(F.lit(" "), F.col("p_type")), F.lit(""), "p_name"))
    return table(spark, d, "part").select(F.when(F.col("p_size") <= 5, F.concat(F.lit(" # "), tabbed)).when(F.col("p_size") <= 25, tabbed).when(F.col("p_size") <= 30, F.col("p_brand")).otherwise(F.concat_ws("  ", "p_brand", "p_type")).alias("value"))


_GENES = r"""genes AS (SELECT DISTINCT p_brand AS hallmark, gene FROM (
  SELECT p_brand, unnest([upper(trim(p_type)), upper(trim(p_name))]) AS gene FROM part WHERE p_size > 5 AND p_size <= 25
  UNION ALL SELECT p_brand, unnest(string_split_regex(upper(trim(p_type)), '\s+')) FROM part WHERE p_size > 30) WHERE gene <> '')"""


@_add("gene_sets", f"WITH {_GENES} SELECT * FROM genes")
def _gene_sets(spark, d):
    return ingest.gene_sets(_gene_lines(spark, d))


@_add("gene_set_union", f"WITH {_GENES} SELECT gene, string_agg(hallmark, ';' ORDER BY hallmark) AS hallmarks FROM genes GROUP BY 1")
def _union(spark, d):
    return ingest.union_of_sets(ingest.gene_sets(_gene_lines(spark, d))).withColumn("hallmarks", F.concat_ws(";", "hallmarks"))


@_add("complex_catalogue", "SELECT 'C' || p_partkey AS complex_id, unnest(string_split(p_type || ' ' || p_brand, ' ')) AS member FROM part WHERE p_size > 10")
def _catalogue(spark, d):
    line = F.when(F.col("p_size") > 10, F.concat(F.lit("C"), F.col("p_partkey").cast("string"), F.lit(":  "), F.concat_ws(" ", "p_type", "p_brand"))).otherwise(F.col("p_type"))
    return ingest.catalogue(table(spark, d, "part").select(line.alias("value")))


@_add("network_lines", """SELECT 'N' || l_partkey AS src, 'M' || l_suppkey AS dst, CASE WHEN l_discount = 0 THEN NULL WHEN q > 1 THEN q / 1000 ELSE q END AS weight, 'p' || l_partkey AS src_id, 's' || l_suppkey AS dst_id
 FROM (SELECT *, (l_quantity::INT * 20 - 20)::DOUBLE AS q FROM lineitem) WHERE l_tax > 0""")
def _network(spark, d):
    named = lambda tag, c: F.concat(F.lit(tag), F.col(c).cast("string"))
    score = F.when(F.col("l_discount") == 0, "none").otherwise((F.col("l_quantity").cast("int") * 20 - 20).cast("string"))
    whole = _tabs(named("p", "l_partkey"), named("s", "l_suppkey"), named("N", "l_partkey"), named("M", "l_suppkey"), F.lit("9606"), score, F.lit("more"))
    return ingest.network_rows(table(spark, d, "lineitem").select(F.when(F.col("l_tax") > 0, whole).otherwise(_tabs(F.lit("p"), F.lit("s"))).alias("value")))


@_add("network_columns", "SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, CASE WHEN l_quantity > 1 THEN l_quantity / 1000 ELSE l_quantity END AS weight FROM lineitem")
def _named(spark, d):
    c = lambda tag, x: F.concat(F.lit(tag), F.col(x).cast("string"))
    return ingest.named_network(table(spark, d, "lineitem").select(c("p", "l_partkey").alias("stringId_A"), c("s", "l_suppkey").alias("stringId_B"), F.col("l_quantity").cast("string").alias("score")))


@_add("mapping_lines", """SELECT c_name AS "queryItem", '0' AS "queryIndex", 'id' || c_custkey AS "stringId", '9606' AS "ncbiTaxonId", 'Homo sapiens' AS "taxonName", c_mktsegment AS "preferredName", 'direct' AS mapping_source, 1 AS priority FROM customer WHERE c_acctbal > 0""")
def _mapping(spark, d):
    whole = _tabs("c_name", F.lit("0"), F.concat(F.lit("id"), F.col("c_custkey").cast("string")), F.lit("9606"), F.lit("Homo sapiens"), "c_mktsegment", F.lit("note"))
    return ingest.mapping_rows(table(spark, d, "customer").select(F.when(F.col("c_acctbal") > 0, whole).otherwise(F.col("c_name")).alias("value")))


def _unmapped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_name").alias("query"), F.when(F.col("c_acctbal") > 0, F.concat(F.lit("g"), F.floor(F.col("c_acctbal") / 100).cast("string"))).alias("gene"))


def _known(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("g"), F.floor(F.col("s_acctbal") / 100).cast("string")).alias("gene"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("stringId"))
    return rows.groupBy("gene").agg(F.min("stringId").alias("stringId"))


_MAPPED = """unm AS (SELECT c_name AS query, CASE WHEN c_acctbal > 0 THEN 'g' || floor(c_acctbal / 100)::BIGINT END AS gene FROM customer),
 known AS (SELECT 'g' || floor(s_acctbal / 100)::BIGINT AS gene, min('S' || s_suppkey) AS "stringId" FROM supplier WHERE s_acctbal > 0 GROUP BY 1),
 mapped AS (SELECT unm.gene, query, "stringId", CASE WHEN "stringId" IS NULL THEN 'unresolved' ELSE 'fallback' END AS mapping_source, CASE WHEN "stringId" IS NULL THEN 99 ELSE 2 END AS priority FROM unm LEFT JOIN known USING (gene) WHERE unm.gene IS NOT NULL)"""


@_add("map_by_gene", f"WITH {_MAPPED} SELECT * FROM mapped")
def _by_gene(spark, d):
    return ingest.map_by_gene(_unmapped(spark, d), _known(spark, d))


@_add("unresolved_identifiers", f'WITH {_MAPPED} SELECT c_name AS identifier FROM customer WHERE c_name NOT IN (SELECT query FROM mapped WHERE "stringId" IS NOT NULL)')
def _unresolved(spark, d):
    audit = ingest.map_by_gene(_unmapped(spark, d), _known(spark, d))
    return ingest.unresolved(table(spark, d, "customer").select(F.col("c_name").alias("identifier")), audit)


@_add("collapsed_mapping", f'WITH {_MAPPED} SELECT * FROM mapped WHERE "stringId" IS NOT NULL QUALIFY row_number() OVER (PARTITION BY "stringId" ORDER BY priority, query) = 1')
def _collapsed(spark, d):
    return ingest.collapse(ingest.map_by_gene(_unmapped(spark, d), _known(spark, d)))


@_add("accession_shapes", """WITH x AS (SELECT unnest(['P' || lpad((p_partkey % 100000)::VARCHAR, 5, '0'), ' q9y2' || chr((65 + p_size % 26)::INT) || '1 ', p_brand, 'A0A0' || chr((65 + p_size % 26)::INT) || 'BC12' || (p_size % 10), 'P12345-' || p_size, p_name]) AS text FROM part)
 SELECT text, regexp_full_match(upper(trim(text)), '[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2}|[A-Z0-9]{6,10}-[0-9]+') AS is_accession FROM x""")
def _accessions(spark, d):
    letter = F.chr(65 + F.col("p_size") % 26)
    made = (
        F.concat(F.lit("P"), F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0")), F.concat(F.lit(" q9y2"), letter, F.lit("1 ")), F.col("p_brand"),
        F.concat(F.lit("A0A0"), letter, F.lit("BC12"), (F.col("p_size") % 10).cast("string")), F.concat(F.lit("P12345-"), F.col("p_size").cast("string")), F.col("p_name"),
    )
    return table(spark, d, "part").select(F.explode(F.array(*made)).alias("text")).select("text", ingest.looks_like_accession(F.col("text")).alias("is_accession"))


@_add("search_records", "SELECT p_brand AS accession, arg_min(p_name, p_partkey) AS gene, arg_min(p_type, p_partkey) AS protein FROM part GROUP BY 1")
def _search(spark, d):
    nothing = F.lit(None).cast("string")
    item = lambda a, g, p: F.struct(a.alias("primaryAccession"), F.array(F.struct(F.struct(g.alias("value")).alias("geneName"))).alias("genes"), F.struct(F.struct(F.struct(p.alias("value")).alias("fullName")).alias("recommendedName")).alias("proteinDescription"))
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name", "p_type"))).alias("x"))
    records = F.concat(F.array(item(nothing, F.lit("none"), F.lit("none"))), F.transform("x", lambda x: item(F.col("p_brand"), x["p_name"], x["p_type"])))
    return ingest.search_results(rows.select(records.alias("results")))


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    term = F.format_string("%s (GO:%07d)", "p_type", "p_partkey")
    row = F.array(F.col("p_size").cast("string"), term, (F.col("p_retailprice") / 1e5).cast("string"), F.lit("1.5"), F.col("p_size").cast("string"), F.to_json(F.array("p_brand", "p_name")), (F.col("p_retailprice") / 4e4).cast("string"))
    short = F.array(F.lit("1"), F.lit("x"))
    return table(spark, d, "part").select(F.col("p_brand").alias("library"), F.to_json(F.array(row, short)).alias("rows"))


@_add("enrichment_table", """SELECT p_brand AS library, p_size AS rank, p_type || ' (GO:' || lpad(p_partkey::VARCHAR, 7, '0') || ')' AS term, p_retailprice / 1e5::DOUBLE AS p, 1.5::DOUBLE AS z, p_size::DOUBLE AS combined, p_brand || ';' || p_name AS genes, p_retailprice / 4e4::DOUBLE AS adj_p FROM part""")
def _enrichment(spark, d):
    return ingest.enrichment_rows(_enriched(spark, d))


@_add("top_enrichment_terms", """WITH x AS (SELECT p_brand AS library, p_type || ' (GO:' || lpad(p_partkey::VARCHAR, 7, '0') || ')' AS term, p_retailprice / 1e5::DOUBLE AS p, p_retailprice / 4e4::DOUBLE AS adj_p, p_brand || ';' || p_name AS genes FROM part)
 SELECT library, term, row_number() OVER (PARTITION BY library ORDER BY adj_p, p, term)::INT AS rank, 2 AS gene_count, genes FROM x WHERE adj_p <= 0.04 QUALIFY rank <= 10""")
def _top(spark, d):
    return ingest.top_terms(ingest.enrichment_rows(_enriched(spark, d)), ("library",), 0.04, 10).select("library", "term", "rank", "gene_count", "genes")


def _term_rows(spark: SparkSession, d: str) -> DataFrame:
    code = F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0")
    shapes = (
        (ingest.PATHWAYS, F.concat("p_type", F.lit(" Homo sapiens hsa"), code)), (ingest.PATHWAYS, F.concat(F.lit("MAP"), code, F.lit("  "), F.col("p_type"))), (ingest.PATHWAYS, F.concat("p_type", F.lit(" - KEGG:"), code)),
        (ingest.PATHWAYS, F.col("p_type")), ("GO Process", F.concat("p_type", F.lit(" (GO:"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"), F.lit(")"))), ("GO Process", F.concat(F.lit("hsa"), code)), ("GO Process", F.lit(None).cast("string")),
    )
    rows = F.array(*(F.struct(F.lit(name).alias("library"), t.alias("term")) for name, t in shapes))
    return table(spark, d, "part").select("p_partkey", F.posexplode(rows).alias("shape", "x")).select("p_partkey", "shape", "x.library", "x.term")


@_add("parsed_terms", """WITH x AS (SELECT p_partkey, p_type, lpad((p_partkey % 100000)::VARCHAR, 5, '0') AS code, lpad(p_partkey::VARCHAR, 7, '0') AS long, unnest(range(7))::INT AS shape FROM part),
 y AS (SELECT p_partkey, shape, CASE WHEN shape < 4 THEN 'KEGG Pathway' ELSE 'GO Process' END AS library,
  [p_type || ' Homo sapiens hsa' || code, 'MAP' || code || '  ' || p_type, p_type || ' - KEGG:' || code, p_type, p_type || ' (GO:' || long || ')', 'hsa' || code, NULL][shape + 1] AS term,
  ['hsa' || code, 'map' || code, 'hsa' || code, '', 'GO:' || long, '', ''][shape + 1] AS term_id, [p_type, p_type, p_type, p_type, p_type, 'hsa' || code, ''][shape + 1] AS term_name FROM x)
 SELECT *, CASE WHEN term_id = '' THEN '' WHEN shape < 4 THEN 'https://www.genome.jp/entry/pathway+' || term_id ELSE 'https://amigo.geneontology.org/amigo/term/' || term_id END AS url FROM y""")
def _terms(spark, d):
    return ingest.parse_terms(_term_rows(spark, d))


@_add("gene_lists", r"""WITH x AS (SELECT p_partkey, unnest(range(3))::INT AS shape, p_name, p_brand FROM part)
 SELECT p_partkey, shape, CASE shape WHEN 0 THEN p_name || '|' || p_brand ELSE p_brand || '|' || p_name END AS genes FROM x WHERE shape < 2
 UNION ALL SELECT p_partkey, 2, p_brand || '|x' FROM part""")
def _gene_lists(spark, d):
    shapes = F.array(F.concat_ws("; ", "p_name", "p_brand", "p_name", F.lit("")), F.concat_ws(",", "p_brand", "p_name"), F.concat_ws("\t", "p_brand", F.lit("x \n"), "p_brand"))
    rows = table(spark, d, "part").select("p_partkey", F.posexplode(shapes).alias("shape", "text"))
    return rows.select("p_partkey", "shape", F.array_join(ingest.gene_list(F.col("text")), "|").alias("genes"))


@_add("pathway_lookup", "WITH known AS (SELECT (CASE WHEN n_regionkey > 2 THEN 'hsa' ELSE 'map' END) || lpad(n_nationkey::VARCHAR, 5, '0') AS path_id, n_name AS name FROM nation UNION ALL SELECT 'map9' || n_nationkey, upper(n_name) FROM nation), terms AS (SELECT DISTINCT lower(n_name) AS term FROM nation UNION ALL SELECT r_name || ' none' FROM region) SELECT term, path_id FROM terms LEFT JOIN known ON term = lower(name) QUALIFY row_number() OVER (PARTITION BY term ORDER BY (CASE WHEN path_id LIKE 'hsa%' THEN 0 ELSE 1 END), path_id) = 1")
def _lookup(spark, d):
    n = table(spark, d, "nation")
    known = n.select(F.concat(F.when(F.col("n_regionkey") > 2, "hsa").otherwise("map"), F.lpad(F.col("n_nationkey").cast("string"), 5, "0")).alias("path_id"), F.col("n_name").alias("name"))
    known = known.unionByName(n.select(F.concat(F.lit("map9"), F.col("n_nationkey").cast("string")).alias("path_id"), F.upper("n_name").alias("name")))
    terms = n.select(F.lower("n_name").alias("term")).distinct().unionByName(table(spark, d, "region").select(F.concat("r_name", F.lit(" none")).alias("term")))
    return ingest.term_lookup(terms, known)


def _built(spark: SparkSession, d: str) -> Graph:
    s, sid = table(spark, d, "supplier"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    identifiers = s.where("s_acctbal > 0").select(F.col("s_name").alias("identifier"))
    mapping = s.select(F.col("s_name").alias("query"), sid.alias("stringId"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("preferredName"), F.lit("direct").alias("mapping_source"), F.lit(1).alias("priority"))
    pairs = cut(shared_pairs(table(spark, d, "lineitem"), "l_partkey", "l_suppkey"))  # each pair once and by number; the builder reads the network several times
    one, two = (F.concat(F.lit("S"), F.col(e).cast("string")) for e in ("src", "dst"))
    network = pairs.select(one.alias("src"), two.alias("dst"), "weight").unionByName(pairs.select(two.alias("src"), one.alias("dst"), "weight"))
    return ingest.build_graph(identifiers, mapping, network, partners=network, add_nodes=10, threshold=2.0)


_BUILT = """WITH ids AS (SELECT 'S' || s_suppkey AS sid, 'N' || s_nationkey AS name, s_name AS query FROM supplier WHERE s_acctbal > 0),
 served AS (SELECT DISTINCT l_partkey, 'S' || l_suppkey AS s FROM lineitem), net AS MATERIALIZED (SELECT a.s AS src, b.s AS dst, count(*)::DOUBLE AS weight FROM served a JOIN served b USING (l_partkey) WHERE a.s <> b.s GROUP BY 1, 2),
 lab AS (SELECT sid, CASE WHEN count(*) OVER (PARTITION BY name) = 1 THEN name ELSE name || '|' || sid END AS label, name, query, true AS is_input FROM ids),
 more AS (SELECT dst AS sid, max(weight) AS w FROM net WHERE src IN (SELECT sid FROM ids) AND dst NOT IN (SELECT sid FROM ids) GROUP BY 1 ORDER BY w DESC, sid LIMIT 10),
 every AS (SELECT * FROM lab UNION ALL SELECT sid, sid, NULL, NULL, false FROM more)"""


@_add("built_graph_edges", _BUILT + " SELECT least(a.label, b.label) AS src, greatest(a.label, b.label) AS dst, max(weight) AS weight FROM net JOIN every a ON a.sid = src JOIN every b ON b.sid = dst WHERE weight >= 2 GROUP BY 1, 2")
def _built_edges(spark, d):
    return _built(spark, d).edges


@_add("built_graph_nodes", _BUILT + """ SELECT label AS node, sid AS "stringId", name AS "preferredName", query, CASE WHEN is_input THEN 'direct' END AS mapping_source, is_input FROM every""")
def _built_nodes(spark, d):
    return _built(spark, d).nodes


@_add("run_states", "SELECT o_orderstatus AS status, count(*) AS runs FROM orders GROUP BY 1")
def _states(spark, d):
    from weft.plans.runner import status_counts

    return status_counts(table(spark, d, "orders").select(F.col("o_orderstatus").alias("status")))
