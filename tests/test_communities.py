"""Communities found in one task and by parallel moves."""

import random

import pytest

from rajut.operators import graph

EDGE = "src_grade string, src string, tgt_grade string, tgt string, rel_type string, confidence double, rel_id long"


def planted(spark, groups=8, size=12, seed=1):
    rng = random.Random(seed)
    rows = []
    for a in range(groups * size):
        for b in range(a):
            if rng.random() < (0.5 if a // size == b // size else 0.01):
                rows.append(("g", f"n{a:03d}", "g", f"n{b:03d}", "X", 1.0, len(rows)))
    return spark.createDataFrame(rows, EDGE)


def quality(edges, found):
    return graph.undirected_modularity(edges, found).first()


@pytest.mark.parametrize("method", ["louvain", "greedy"])
def test_parallel_moves_reach_the_quality_of_one_task(spark, method):
    edges = planted(spark)
    alone = quality(edges, graph.communities(edges, method))
    contracted = graph.communities(edges, method, local_edges=60)
    both = quality(edges, contracted)
    assert alone["modularity"] > 0.6 and both["modularity"] > alone["modularity"] - 0.05
    assert {r["u"] for r in contracted.collect()} == {f"g\x1fn{i:03d}" for i in range(96)} or contracted.count() == 96
    assert contracted.where("community > u").count() == 0


def test_no_edges_give_no_communities(spark):
    assert graph.communities(spark.createDataFrame([], EDGE)).count() == 0
