"""Readers and parsers of identifiers, networks, gene sets, mappings and enrichment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.graph import Graph, canonical_edges

#: The edges of the 34-node karate club graph, by their larger end, 0-based.
KARATE = {
    1: (0,), 2: (0, 1), 3: (0, 1, 2), 4: (0,), 5: (0,), 6: (0, 4, 5), 7: (0, 1, 2, 3), 8: (0, 2), 9: (2,), 10: (0, 4, 5), 11: (0,), 12: (0, 3), 13: (0, 1, 2, 3), 16: (5, 6), 17: (0, 1), 19: (0, 1), 21: (0, 1), 25: (23, 24),
    27: (2, 23, 24), 28: (2,), 29: (23, 26), 30: (1, 8), 31: (0, 24, 25, 28), 32: (2, 8, 14, 15, 18, 20, 22, 23, 29, 30, 31), 33: (8, 9, 13, 14, 15, 18, 19, 20, 22, 23, 26, 27, 28, 29, 30, 31, 32),
}


def default_graph(spark: SparkSession, name: str = "karate") -> Graph:
    if name != "karate":
        raise ValueError(f"no graph {name!r}")
    return Graph.from_edges(spark.createDataFrame([(a, b, 1.0) for b, ends in KARATE.items() for a in ends], "src long, dst long, weight double"))


def split_identifiers(texts: DataFrame, text: str = "text", key: str | None = None, mode: str = "list") -> DataFrame:
    """([key,] pos, identifier): first-seen distinct identifiers. mode list splits at commas, semicolons, tabs and lines,
    mode lines at lines only; blanks do not split."""
    raw = F.regexp_replace(F.col(text), "\r\n|\r", "\n")
    parts = F.split(F.regexp_replace(raw, "[;\t]", ","), "[,\n]") if mode == "list" else F.split(raw, "\n")
    keys = [key] if key else []
    rows = texts.select(*keys, F.posexplode(parts).alias("pos", "identifier")).withColumn("identifier", F.trim("identifier")).where("identifier <> ''")
    return rows.groupBy(*keys, "identifier").agg(F.min("pos").alias("pos")).select(*keys, "pos", "identifier")


def read_identifiers(spark: SparkSession, path: str, mode: str = "list") -> DataFrame:
    """(pos, identifier) of a text file; in mode lines an empty file raises."""
    out = split_identifiers(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"), mode=mode)
    if mode == "lines" and out.isEmpty():
        raise ValueError(f"no identifiers in {path}")
    return out


def read_edge_csv(spark: SparkSession, path: str) -> Graph:
    """source,target,score with a header."""
    return Graph.from_edges(spark.read.csv(path, header=True, schema="source string, target string, score double"), "source", "target", "score")


def normalise_score(c: Column) -> Column:
    """Scores above 1 are thousandths; text that is no number is null."""
    x = c.try_cast("double")
    return F.when(x > 1, x / 1000).otherwise(x)


def network_rows(lines: DataFrame, value: str = "value") -> DataFrame:
    """(src, dst, weight, src_id, dst_id) of positional lines of six tab-separated fields at least; others are skipped."""
    f = F.split(value, "\t")
    return lines.where(F.size(f) >= 6).select(f[2].alias("src"), f[3].alias("dst"), normalise_score(f[5]).alias("weight"), f[0].alias("src_id"), f[1].alias("dst_id"))


def named_network(rows: DataFrame) -> DataFrame:
    """(src, dst, weight) of a table with named columns: preferred names before ids; without a score every edge weighs 1."""
    for a, b in (("preferredName_A", "preferredName_B"), ("stringId_A", "stringId_B")):
        if a in rows.columns and b in rows.columns:
            w = normalise_score(F.col("score")) if "score" in rows.columns else F.lit(1.0)
            return rows.select(F.col(a).alias("src"), F.col(b).alias("dst"), w.alias("weight"))
    raise ValueError("no columns of edge ends")


def read_network_tsv(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(src, dst, weight) of a network table: positional, or by column name."""
    return named_network(spark.read.csv(path, sep="\t", header=True)) if header else network_rows(spark.read.text(path))


def mapping_rows(lines: DataFrame, value: str = "value") -> DataFrame:
    """Positional mapping rows of six tab-separated fields at least, with source direct and priority 1; others are skipped."""
    f = F.split(value, "\t")
    names = ("queryItem", "queryIndex", "stringId", "ncbiTaxonId", "taxonName", "preferredName")
    return lines.where(F.size(f) >= 6).select(*(f[i].alias(c) for i, c in enumerate(names)), F.lit("direct").alias("mapping_source"), F.lit(1).alias("priority"))


def read_mapping_tsv(spark: SparkSession, path: str) -> DataFrame:
    return mapping_rows(spark.read.text(path))


def catalogue(lines: DataFrame, value: str = "value") -> DataFrame:
    """(complex_id, member) of lines 'C1:  A B ...'."""
    f = F.split(value, ":", 2)
    return lines.where(F.size(f) == 2).select(F.trim(f[0]).alias("complex_id"), F.explode(F.split(F.trim(f[1]), " +")).alias("member")).where("member <> ''")


def gene_sets(lines: DataFrame, value: str = "value") -> DataFrame:
    """(hallmark, gene): a set per line, tab-separated or else by blanks; # comments and lines of one field are skipped; upper case."""
    tabs = F.split(F.trim(value), "\t")
    f = F.when(F.size(tabs) < 2, F.split(F.trim(value), r"\s+")).otherwise(tabs)
    rows = lines.where(~F.ltrim(value).startswith("#")).select(f.alias("f")).where(F.size("f") >= 2)
    rows = rows.select(F.trim(F.col("f")[0]).alias("hallmark"), F.explode(F.slice("f", F.lit(2), F.size("f"))).alias("gene"))
    return rows.select("hallmark", F.upper(F.trim("gene")).alias("gene")).where("gene <> ''").distinct()


def union_of_sets(sets: DataFrame) -> DataFrame:
    """(gene, hallmarks): every gene of any set once, with the sets that hold it, in order."""
    return sets.groupBy("gene").agg(F.sort_array(F.collect_set("hallmark")).alias("hallmarks"))


def search_results(docs: DataFrame, results: str = "results") -> DataFrame:
    """(accession, gene, protein): of nested protein search results the first per accession, by place in its document; null accessions are left out."""
    r = docs.select(F.posexplode(results).alias("pos", "r"))
    rows = r.select("pos", F.col("r.primaryAccession").alias("accession"), F.get(F.col("r.genes"), F.lit(0))["geneName"]["value"].alias("gene"), F.col("r.proteinDescription.recommendedName.fullName.value").alias("protein"))
    first = F.min(F.struct("pos", "gene", "protein")).alias("first")
    return rows.where("accession is not null").groupBy("accession").agg(first).select("accession", "first.gene", "first.protein")


#: The three shapes of protein accessions.
ACCESSIONS = r"^(?:[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2}|[A-Z0-9]{6,10}-\d+)$"


def looks_like_accession(c: Column) -> Column:
    return F.upper(F.trim(c)).rlike(ACCESSIONS)


def map_by_gene(unmapped: DataFrame, known: DataFrame) -> DataFrame:
    """unmapped(query, gene) left-joined to known(gene, stringId): source fallback with priority 2, or unresolved with 99."""
    rows = unmapped.where("gene is not null").join(known, "gene", "left")
    found = F.col("stringId").isNotNull()
    return rows.withColumns({"mapping_source": F.when(found, "fallback").otherwise("unresolved"), "priority": F.when(found, 2).otherwise(99)})


def mapping_audit(direct: DataFrame, fallback: DataFrame) -> DataFrame:
    """One row per query: the best of both by priority, name and id."""
    rows = direct.unionByName(fallback, allowMissingColumns=True)
    order = Window.partitionBy("query").orderBy("priority", F.col("preferredName").asc_nulls_last(), F.col("stringId").asc_nulls_last())
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def unresolved(identifiers: DataFrame, audit: DataFrame) -> DataFrame:
    return identifiers.join(audit.where("stringId is not null").select(F.col("query").alias("identifier")), "identifier", "left_anti")


def collapse(audit: DataFrame) -> DataFrame:
    """One row per stringId, the one of best priority."""
    order = Window.partitionBy("stringId").orderBy("priority", "query")
    return audit.where("stringId is not null").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def label_nodes(rows: DataFrame, name: str = "preferredName", key: str = "stringId") -> DataFrame:
    """Adds label: the name where it is unique, else name|key."""
    times = F.count(F.lit(1)).over(Window.partitionBy(name))
    return rows.withColumn("label", F.when(times == 1, F.col(name)).otherwise(F.concat_ws("|", name, key)))


def top_partners(edges: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """(node, score): the n nodes outside chosen(node) with the strongest edge into it."""
    ids = chosen.select("node").distinct()
    hit = edges.join(ids.select(F.col("node").alias("src"), F.lit(1).alias("a")), "src", "left").join(ids.select(F.col("node").alias("dst"), F.lit(1).alias("b")), "dst", "left")
    one = hit.where("(a is null) <> (b is null)").select(F.when(F.col("a").isNull(), F.col("src")).otherwise(F.col("dst")).alias("node"), "weight")
    return one.groupBy("node").agg(F.max("weight").alias("score")).orderBy(F.desc("score"), "node").limit(n)


def clean_edges(rows: DataFrame, ids: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Canonical edges whose ends both are in ids(node), mapped to labels(node, label)."""
    keep = ids.select("node").distinct()
    rows = rows.dropna(subset=["src", "dst", "weight"]).join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi")
    if labels is not None:
        one, two = (labels.select(F.col("node").alias(e), F.col("label").alias(f"{e}_label")) for e in ("src", "dst"))
        rows = rows.join(one, "src").join(two, "dst").select(F.col("src_label").alias("src"), F.col("dst_label").alias("dst"), "weight")
    return canonical_edges(rows)


def build_graph(identifiers: DataFrame, mapping: DataFrame, network: DataFrame, fallback: DataFrame | None = None, partners: DataFrame | None = None, add_nodes: int = 0, threshold: float = 0.0) -> Graph:
    """From identifiers to a labelled graph: mapping, audit, labels, partners, edges; isolated inputs stay nodes.

    identifiers(identifier), mapping(query, stringId, preferredName, mapping_source, priority) and the like for
    fallback; network and partners(src, dst, weight) by stringId. Where network is empty, partners are used.
    """
    audit = mapping_audit(mapping, fallback if fallback is not None else mapping.limit(0))
    nodes = label_nodes(collapse(audit.join(identifiers.select(F.col("identifier").alias("query")), "query", "left_semi")))
    nodes = nodes.withColumn("is_input", F.lit(True))
    if add_nodes and partners is not None:
        more = top_partners(partners, nodes.select(F.col("stringId").alias("node")), add_nodes)
        nodes = nodes.unionByName(more.select(F.col("node").alias("stringId"), F.col("node").alias("label"), F.lit(False).alias("is_input")), allowMissingColumns=True)
    rows = partners if network.isEmpty() and partners is not None else network
    labels = nodes.select(F.col("stringId").alias("node"), "label")
    edges = clean_edges(rows.where(F.col("weight") >= threshold), labels, labels)
    return Graph.from_edges(edges, nodes=nodes.select(F.col("label").alias("node"), "stringId", "preferredName", "query", "mapping_source", "is_input"))


def enrichment_rows(results: DataFrame, library: str = "library", rows: str = "rows") -> DataFrame:
    """(library, rank, term, p, z, combined, genes, adj_p) of positional JSON rows of seven fields at least."""
    r = results.select(library, F.explode(F.from_json(rows, "array<array<string>>")).alias("r")).where(F.size("r") >= 7)
    c = lambda i: F.col("r")[i]
    genes = F.array_join(F.from_json(c(5), "array<string>"), ";")
    return r.select(F.col(library).alias("library"), c(0).try_cast("int").alias("rank"), c(1).alias("term"), c(2).try_cast("double").alias("p"), c(3).try_cast("double").alias("z"), c(4).try_cast("double").alias("combined"), F.coalesce(genes, c(5)).alias("genes"), c(6).try_cast("double").alias("adj_p"))


#: The library whose terms are pathways, and where terms are described.
PATHWAYS = "KEGG Pathway"
PATHWAY_URL = "https://www.genome.jp/entry/pathway+"
TERM_URL = "https://amigo.geneontology.org/amigo/term/"


def parse_terms(rows: DataFrame, term: str = "term", library: str = "library") -> DataFrame:
    """Adds term_id, term_name and url, empty where there is none.

    Pathways are named by hsa or map and five digits, or by five digits alone,
    which are hsa's; their names lose the species. Other libraries have GO
    identifiers. What marks the identifier leaves the name.
    """
    t = F.trim(F.coalesce(F.col(term), F.lit("")))
    pathway = F.coalesce(F.col(library) == PATHWAYS, F.lit(False))
    first = lambda *patterns: F.coalesce(*(F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in patterns))
    marked = {"hsa": r"(?i)(hsa\d{5})", "map": r"(?i)(map\d{5})", "bare": r"(?i)(?:KEGG:)?(\d{5})"}
    hsa, mapped, bare, go = (first(p) for p in (*marked.values(), r"(GO:\d{7})"))
    ident = F.when(pathway, F.lower(F.coalesce(hsa, mapped, F.concat(F.lit("hsa"), bare)))).otherwise(go)
    left = F.when(hsa.isNotNull(), F.regexp_replace(t, marked["hsa"], "")).when(mapped.isNotNull(), F.regexp_replace(t, marked["map"], "")).otherwise(F.regexp_replace(t, marked["bare"], ""))
    left = F.regexp_replace(left, "[Hh]omo sapiens", "")
    name = F.when(pathway, left).otherwise(F.regexp_replace(t, r"\s*\(?GO:\d{7}\)?\s*", " "))
    name = F.trim(F.regexp_replace(F.btrim(F.trim(name), F.lit(" -()[]")), r"\s{2,}", " "))
    found = F.coalesce(ident, F.lit(""))
    out = rows.withColumns({"term_id": found, "term_name": F.when(found == "", t).otherwise(name)})
    url = F.when(F.col("term_id") == "", "").otherwise(F.concat(F.when(pathway, PATHWAY_URL).otherwise(TERM_URL), F.col("term_id")))
    return out.withColumn("url", url)


def gene_list(c: Column) -> Column:
    """Distinct genes in order: split at semicolons, else commas, else white space."""
    parts = F.when(c.contains(";"), F.split(c, ";")).when(c.contains(","), F.split(c, ",")).otherwise(F.split(c, r"\s+"))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""))


def top_terms(rows: DataFrame, keys: tuple[str, ...] = ("cid", "library"), most: float = 0.05, n: int = 10) -> DataFrame:
    """The n best significant terms per key by (adj_p, p), with gene_count and ;-joined genes."""
    order = Window.partitionBy(*keys).orderBy("adj_p", "p", "term")
    rows = rows.where(F.col("adj_p") <= most).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    genes = gene_list(F.col("genes"))
    return rows.withColumns({"gene_count": F.size(genes), "genes": F.array_join(genes, ";")})


def term_lookup(terms: DataFrame, known: DataFrame, prefix: str = "hsa") -> DataFrame:
    """terms(term) with the id of the pathway(path_id, name) of that name: of the prefix first, else the first."""
    rows = terms.join(known, F.lower("term") == F.lower("name"), "left")
    order = Window.partitionBy("term").orderBy((~F.col("path_id").startswith(prefix)).asc_nulls_last(), "path_id")
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("term", "path_id")
