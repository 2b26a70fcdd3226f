"""Covers: membership(cid, node) tables of overlapping communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.graph import Graph
from weft.operators.order import numbered


def sizes(membership: DataFrame) -> DataFrame:
    return membership.groupBy("cid").agg(F.countDistinct("node").alias("size"))


def drop_duplicates(membership: DataFrame) -> DataFrame:
    """Without communities of the same nodes as one of smaller cid. Groups are compared by two hashes and their size."""
    m = membership.select("cid", "node").distinct()
    total = lambda salt: F.sum(F.xxhash64(F.lit(salt), F.col("node")).cast("decimal(38,0)")).alias(f"h{salt}")
    same = m.groupBy("cid").agg(F.count(F.lit(1)).alias("size"), total(1), total(2)).groupBy("size", "h1", "h2").agg(F.min("cid").alias("cid"))
    return m.join(same.select("cid"), "cid", "left_semi")


def relabel(membership: DataFrame) -> DataFrame:
    """cid becomes 0, 1, ... by size from large to small, then by the smallest node."""
    per = membership.groupBy("cid").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least"))
    order = numbered(per, "rank", F.desc("size"), F.col("least"), F.col("cid"))
    return membership.join(order.select("cid", "rank"), "cid").select((F.col("rank") - 1).cast("int").alias("cid"), "node")


def postprocess(membership: DataFrame, min_size: int = 1) -> DataFrame:
    """The displayed cover: members and communities once, of min_size members at least, relabelled by size."""
    m = drop_duplicates(membership)
    return relabel(m.join(sizes(m).where(F.col("size") >= min_size).select("cid"), "cid", "left_semi"))


def page(membership: DataFrame, number: int, size: int = 25) -> DataFrame:
    """(community_id, size, nodes): the communities of one page, 1-based both, of a relabelled cover; a number beyond the last page is that page."""
    pages = (membership.agg(F.max("cid")).first()[0] or 0) // size + 1
    first = (min(max(1, number), pages) - 1) * size
    rows = membership.where((F.col("cid") >= first) & (F.col("cid") < first + size))
    return rows.groupBy((F.col("cid") + 1).alias("community_id")).agg(F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list("node")).alias("nodes"))


def uncovered(graph: Graph, membership: DataFrame) -> DataFrame:
    """(node) in no community; before any filter by size."""
    return graph.nodes.select("node").join(membership.select("node"), "node", "left_anti")


def counts(graph: Graph, membership: DataFrame) -> DataFrame:
    """(node, memberships) of all nodes."""
    per = membership.groupBy("node").agg(F.countDistinct("cid").alias("memberships"))
    return graph.nodes.select("node").join(per, "node", "left").select("node", F.coalesce("memberships", F.lit(0).cast("long")).alias("memberships"))


def membership_lists(membership: DataFrame) -> DataFrame:
    """(node, memberships, n_memberships): ids 1-based and in order, and their true number."""
    return membership.groupBy("node").agg(F.sort_array(F.collect_set(F.col("cid") + 1)).alias("memberships"), F.countDistinct("cid").alias("n_memberships"))


def count_histogram(graph: Graph, membership: DataFrame) -> DataFrame:
    return counts(graph, membership).groupBy("memberships").agg(F.count(F.lit(1)).alias("nodes"))


def primary(membership: DataFrame) -> DataFrame:
    """(node, cid): the largest community of each node, of equal ones the smallest cid."""
    sized = membership.select("cid", "node").distinct().join(sizes(membership), "cid")
    first = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("size"), "cid"))
    return sized.withColumn("_r", first).where("_r = 1").select("node", "cid")


def is_crisp(membership: DataFrame) -> bool:
    return membership.groupBy("node").agg(F.countDistinct("cid").alias("n")).where("n > 1").isEmpty()


def crisp_projection(graph: Graph, membership: DataFrame) -> DataFrame:
    """(node, cid string): the primary community, uncovered nodes as communities of their own."""
    own: Column = F.concat(F.lit("c"), F.col("cid").cast("string"))
    return primary(membership).select("node", own.alias("cid")).unionByName(uncovered(graph, membership).select("node", F.concat(F.lit("n"), F.col("node").cast("string")).alias("cid")))


def interaction(membership: DataFrame) -> DataFrame:
    """(cid1, cid2, shared): the community interaction graph."""
    from weft.operators.boundary import community_pairs

    return community_pairs(membership)


def contract(graph: Graph, part: DataFrame, double_cross: bool = False) -> DataFrame:
    """(c1, c2, weight), c1 <= c2: the meta-graph of a partition; inner weight as a loop, cross weight once or twice."""
    one, two = (part.select(F.col("node").alias(e), F.col("cid").alias(c)) for e, c in (("src", "a"), ("dst", "b")))
    rows = graph.edges.join(one, "src").join(two, "dst")
    times = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0 if double_cross else 1.0)
    return rows.groupBy(F.least("a", "b").alias("c1"), F.greatest("a", "b").alias("c2")).agg(F.sum(F.col("weight") * times).alias("weight"))
