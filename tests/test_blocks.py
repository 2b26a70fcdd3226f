"""Paths from blocks of sources against the relations with a row for each pair."""

import pytest
from pyspark.sql import functions as F

from tests.test_egonets import graph_of, random_graph
from weft.operators import blocks
from weft.operators.paths import dependencies, scoped, shortest_paths


@pytest.mark.parametrize("load", [False, True])
def test_more_sources_than_a_block_has(spark, load):
    adj = random_graph(8, 2 * blocks.WIDTH + 3, 3, 0.3, 0.03)
    adj[len(adj)] = set()  # alone
    g = graph_of(spark, adj)
    start = g.nodes.select(F.lit(0).alias("scope"), F.col("node").alias("source"))
    paths = shortest_paths(scoped(g), start)
    want = {r.node: r.x for r in dependencies(scoped(g), paths, load=load).groupBy("node").agg(F.sum("delta").alias("x")).collect()}
    got = {r.node: r.delta for r in blocks.flows(g.adj.select("node", "nbr"), g.nodes.select("node"), load).collect()}
    assert {v: x for v, x in got.items() if x} == pytest.approx({v: x for v, x in want.items() if x})
    if not load:
        sums = {r.node: (r.r, r.total) for r in blocks.distance_sums(g.adj.select("node", "nbr"), g.nodes.select("node")).collect()}
        pairs = paths.groupBy("node").agg(F.count(F.lit(1)).alias("r"), F.sum("d").alias("total"))
        assert sums == {r.node: (r.r, r.total) for r in pairs.collect()}
