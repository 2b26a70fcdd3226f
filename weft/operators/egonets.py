"""All ego networks of a graph in one plan: rows are keyed by (ego, node), and every round moves all of them at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.graph import Graph
from weft.operators.components import connected_components
from weft.operators.triangles import ego_edges
from weft.plans.lineage import cut


def both_ways(edges: DataFrame, scope: str) -> DataFrame:
    """(scope, node, nbr) in both directions of (scope, src, dst)."""
    there = edges.select(scope, F.col("src").alias("node"), F.col("dst").alias("nbr"))
    return there.unionByName(edges.select(scope, F.col("dst").alias("node"), F.col("src").alias("nbr")))


def label_round(near: DataFrame, labels: DataFrame, scope: str = "ego") -> DataFrame:
    """(scope, node, label) after one synchronous round: the most frequent label of a node and its neighbours, of equal ones the smallest.

    near has (scope, node, nbr), labels every node of every scope.
    """
    heard = near.join(labels.withColumnRenamed("node", "nbr"), [scope, "nbr"]).select(scope, "node", "label").unionByName(labels.select(scope, "node", "label"))
    votes = heard.groupBy(scope, "node", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy(scope, "node").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"))


def propagate(edges: DataFrame, rounds: int, scope: str = "ego") -> DataFrame:
    """(scope, node, label) after synchronous label propagation in every scope at once, from labels of their own.

    edges has (scope, src, dst). A scope in which no label changes is settled and
    takes no part in later rounds; after `rounds` rounds the labels stay as they are.
    """
    near = cut(both_ways(edges, scope))
    labels = cut(near.select(scope, "node").distinct().withColumn("label", F.col("node")))
    settled = None
    for _ in range(rounds):
        after = label_round(near, labels, scope).join(labels.withColumnRenamed("label", "old"), [scope, "node"])
        after = cut(after.withColumn("moved", F.col("label") != F.col("old")).drop("old"))
        open_ = after.where("moved").select(scope).distinct()
        done = after.join(open_, scope, "left_anti").select(scope, "node", "label")
        settled = done if settled is None else settled.unionByName(done)
        labels = cut(after.join(open_, scope, "left_semi").select(scope, "node", "label"))
        if labels.isEmpty():
            return settled
        near = near.join(open_, scope, "left_semi")
    return settled.unionByName(labels) if settled is not None else labels


def ego_communities(graph: Graph, groups: DataFrame, least: int) -> DataFrame:
    """(cid, node) of (ego, node, label): each label of each ego with the ego itself, from `least` members, equal ones once.

    Neighbours without an edge in the ego network are communities of two with the ego. cid is the struct (ego, label).
    """
    alone = graph.adj.select(F.col("node").alias("ego"), F.col("nbr").alias("node")).join(groups.select("ego", "node"), ["ego", "node"], "left_anti").withColumn("label", F.col("node"))
    rows = groups.select("ego", "node", "label").unionByName(alone.select("ego", "node", "label")) if least <= 2 else groups.select("ego", "node", "label")
    named = rows.select(F.struct("ego", "label").alias("cid"), "ego", "node")
    members = named.select("cid", "node").unionByName(named.select("cid", F.col("ego").alias("node")).distinct())
    big = members.groupBy("cid").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    from weft.operators.cover import drop_duplicates

    return drop_duplicates(members.join(big.select("cid"), "cid", "left_semi"))


def _indexed(members: DataFrame, prefix: Column) -> DataFrame:
    """(cid, node, size, first): first marks the `prefix` rarest members of each community."""
    often = members.groupBy("node").agg(F.count(F.lit(1)).alias("often"))
    size = members.groupBy("cid").agg(F.count(F.lit(1)).alias("size"))
    place = F.row_number().over(Window.partitionBy("cid").orderBy("often", "node"))
    return members.join(often, "node").join(size, "cid").withColumn("first", place <= prefix).select("cid", "node", "size", "first")


def _shared(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(c, d, shared) of candidate pairs, counted over all members of both."""
    one = members.select(F.col("cid").alias("c"), "node")
    return pairs.join(one, "c").join(members.select(F.col("cid").alias("d"), "node"), ["d", "node"]).groupBy("c", "d").agg(F.count(F.lit(1)).alias("shared"))


def contained(members: DataFrame, share: float) -> DataFrame:
    """(c, d, shared, size_c, size_d): communities c of which a larger one d holds `share` at least; of equal sizes the smaller cid is the larger.

    d must hold one of any members of c that are more than it may miss; the
    rarest of them are looked up in the index of members, so that hubs, which lie
    in most communities, pair none.
    """
    rows = cut(_indexed(members, F.floor(F.col("size") * (1 - share) + 1e-9) + 1))
    one, two = (rows.select(F.col("cid").alias(x), F.col("size").alias(f"size_{x}"), "node", "first") for x in ("c", "d"))
    larger = (F.col("size_d") > F.col("size_c")) | (F.col("size_d") == F.col("size_c")) & (F.col("d") < F.col("c"))
    pairs = one.where("first").drop("first").join(two.drop("first"), "node").where(larger).select("c", "d", "size_c", "size_d").distinct()
    return _shared(pairs.select("c", "d"), members).join(pairs, ["c", "d"]).where(F.col("shared") >= share * F.col("size_c") - 1e-9)


def alike(members: DataFrame, share: float, test: Column) -> DataFrame:
    """(c, d, shared, size_c, size_d), c < d, that pass a test of these columns which implies shared >= share * the larger size.

    Such a pair shares a member among the rarest of both.
    """
    rows = cut(_indexed(members, F.col("size") - F.ceil(F.col("size") * share - 1e-9) + 1).where("first"))
    one, two = (rows.select(F.col("cid").alias(x), F.col("size").alias(f"size_{x}"), "node") for x in ("c", "d"))
    pairs = one.join(two, "node").where((F.col("c") < F.col("d")) & (F.least("size_c", "size_d") >= share * F.greatest("size_c", "size_d") - 1e-9)).select("c", "d", "size_c", "size_d").distinct()
    return _shared(pairs.select("c", "d"), members).join(pairs, ["c", "d"]).where(test)


def merge_contained(members: DataFrame, share: float, by_overlap: bool = False) -> DataFrame:
    """(cid, node) in which no community holds `share` of a smaller one.

    In each round every community with hosts, larger ones that hold `share` of it,
    joins one of them: the largest, or by_overlap the one that shares most with it, of equal ones the first by
    (size, cid). All join at once, and chains end as one community.
    """
    members = cut(members.select("cid", "node").distinct())
    while True:
        order = [-F.col("shared")] if by_overlap else []
        hosts = contained(members, share).groupBy("c").agg(F.min_by("d", F.struct(*order, -F.col("size_d"), "d")).alias("d"))
        hosts = cut(hosts)
        if hosts.isEmpty():
            return members
        found = connected_components(hosts, "c", "d").select(F.col("node").alias("cid"), "component")
        members = cut(members.join(found, "cid", "left").select(F.coalesce("component", "cid").alias("cid"), "node").distinct())


def first_come(items: DataFrame, pairs: DataFrame, order: str) -> DataFrame:
    """(id) of the items that stay when they come in ascending order and each stays unless one alike has stayed before it.

    items has (id, order) with distinct orders, pairs (c, d) of items alike. An item is settled
    once all that are alike and come before it are; in a round all such items are settled at once.
    """
    rank = items.select("id", F.col(order).alias("at"))
    links = pairs.select("c", "d").unionByName(pairs.select(F.col("d").alias("c"), F.col("c").alias("d"))).where("c <> d").distinct()
    links = links.join(rank.select(F.col("id").alias("c"), F.col("at").alias("at_c")), "c").join(rank.select(F.col("id").alias("d"), F.col("at").alias("at_d")), "d")
    before = cut(links.where("at_d < at_c").select("c", "d"))  # d comes before c
    left, stay = cut(rank.select("id")), None
    while True:
        blocked = before.select(F.col("c").alias("id")).distinct()
        ready = cut(left.join(blocked, "id", "left_anti"))
        stay = ready if stay is None else stay.unionByName(ready)
        gone = before.join(ready.withColumnRenamed("id", "d"), "d", "left_semi").select(F.col("c").alias("id")).distinct()
        gone = cut(gone)
        left = cut(left.join(ready, "id", "left_anti").join(gone, "id", "left_anti"))
        if left.isEmpty():
            return stay
        before = cut(before.join(gone.withColumnRenamed("id", "c"), "c", "left_anti").join(gone.withColumnRenamed("id", "d"), "d", "left_anti").join(ready.withColumnRenamed("id", "d"), "d", "left_anti"))


def ego_components(graph: Graph) -> DataFrame:
    """(ego, node, label): components of every ego network without its centre, by their smallest node; of neighbours with an edge there."""
    pair = lambda e: F.struct("ego", F.col(e).alias("node")).alias(e)
    found = connected_components(ego_edges(graph).select(pair("src"), pair("dst")))
    return found.select(F.col("node.ego").alias("ego"), F.col("node.node").alias("node"), F.col("component.node").alias("label"))


def dense_cores(graph: Graph, least: float) -> DataFrame:
    """(cid, node, density): of each node's neighbourhood graph, itself included, the components of nodes of average degree or more, peeled to density `least`.

    Each round takes the nodes of smallest degree from every part that is too
    sparse, and its degrees from their neighbours'. Parts of two nodes or fewer
    go. cid is the struct (ego, label).
    """
    inner = cut(ego_edges(graph))
    spokes = graph.adj.select(F.col("node").alias("ego"), F.least("node", "nbr").alias("src"), F.greatest("node", "nbr").alias("dst"))
    near = cut(both_ways(inner.unionByName(spokes), "ego"))
    degree = near.groupBy("ego", "node").agg(F.count(F.lit(1)).alias("degree"))
    average = degree.groupBy("ego").agg(F.avg("degree").alias("average"))
    core = cut(degree.join(average, "ego").where("degree >= average").select("ego", "node"))
    near = near.join(core, ["ego", "node"], "left_semi").join(core.withColumnRenamed("node", "nbr"), ["ego", "nbr"], "left_semi").select("ego", "node", "nbr")
    pair = lambda e: F.struct("ego", F.col(e).alias("node")).alias(e)
    parts = connected_components(near.where("node < nbr").select(pair("node"), pair("nbr")), "node", "nbr")
    parts = cut(parts.select(F.col("node.ego").alias("ego"), F.col("node.node").alias("node"), F.struct(F.col("node.ego").alias("ego"), F.col("component.node").alias("label")).alias("cid")))
    near = cut(near.join(parts, ["ego", "node"]).select("cid", "node", "nbr"))  # a part holds all its neighbours in the core
    state = cut(near.groupBy("cid", "node").agg(F.count(F.lit(1)).alias("degree")))
    done = None
    while True:
        size, least_degree = F.count(F.lit(1)), F.min("degree")
        per = state.groupBy("cid").agg(size.alias("size"), least_degree.alias("least"), (F.sum("degree") / (F.count(F.lit(1)) * (F.count(F.lit(1)) - 1))).alias("density")).where("size > 2")
        judged = cut(state.join(per, "cid"))
        ready = judged.where(F.col("density") >= least).select("cid", "node", "density")
        done = ready if done is None else done.unionByName(ready)
        sparse = judged.where(F.col("density") < least)
        gone = cut(sparse.where("degree = least").select("cid", "node"))
        if gone.isEmpty():
            return done
        lost = near.join(gone.withColumnRenamed("node", "nbr"), ["cid", "nbr"]).groupBy("cid", "node").agg(F.count(F.lit(1)).alias("lost"))
        state = sparse.where("degree > least").select("cid", "node", "degree").join(lost, ["cid", "node"], "left")
        state = cut(state.select("cid", "node", (F.col("degree") - F.coalesce("lost", F.lit(0))).alias("degree")))
