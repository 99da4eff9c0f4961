import random

import pytest
from pyspark.sql import functions as F

from rajut.operators.orphans import FOREVER, contiguous_runs, integer_orphans, orphans

SPANS = "ns string, start long, end long"
REFS = "ref long, ns string, point long, start string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_runs_merge_touching_and_overlapping_spans(spark):
    spans = spark.createDataFrame([("a", 1, 3), ("a", 3, 5), ("a", 4, 9), ("a", 12, 13), ("a", 12, 13), ("b", 5, 5), (None, 1, 2), ("c", 2, None)], SPANS)
    assert rows(contiguous_runs(spans, bucket=4)) == [("a", 1, 9), ("a", 12, 13)]


def test_orphans_by_time(spark):
    spans = spark.createDataFrame([("a", 10, 20), ("a", 30, 40), ("b", -FOREVER, FOREVER), ("c", 5, 6)], SPANS)
    refs = spark.createDataFrame([(1, "a", 9, "x"), (2, "a", 10, "x"), (3, "a", 20, "x"), (4, "a", 39, "x"), (5, "b", 0, "x"), (6, "zz", 1, "x"), (7, None, 1, "x"), (8, "a", None, "x"), (9, "c", 6, None), (9, "c", 6, None)], REFS)
    got = orphans(refs, contiguous_runs(spans), block_rows=2)
    assert [r[0] for r in rows(got.select("ref"))] == [1, 3, 6, 9, 9]
    assert got.columns == ["ref", "ns", "point", "start"]


@pytest.mark.parametrize("seed", [1, 2])
def test_orphans_against_brute_force_with_a_hot_name(spark, seed):
    rng = random.Random(seed)
    name = lambda: "hot" if rng.random() < 0.4 else f"n{rng.randrange(20)}"
    spans = [(name(), s := rng.randrange(500), s + rng.randrange(1, 30)) for _ in range(150)]
    refs = [(i, name(), rng.randrange(600), "") for i in range(400)]
    want = sorted(i for i, n, p, _ in refs if not any(n == m and a <= p < b for m, a, b in spans))
    got = orphans(spark.createDataFrame(refs, REFS), contiguous_runs(spark.createDataFrame(spans, SPANS), bucket=50), block_rows=20)
    assert [r["ref"] for r in got.orderBy("ref").collect()] == want


def test_integer_keys_and_clashing_names(spark):
    parents = spark.createDataFrame([(i,) for i in [*range(1, 10), 12, (1 << 20), (1 << 20) + 1, -5]], "key long")
    kids = spark.createDataFrame([(k, "a") for k in (1, 9, 10, 12, 13, 1 << 20, (1 << 20) + 2, -5, -6)] + [(None, "b")], "point long, ns string")
    assert [r["point"] for r in integer_orphans(kids, "point", parents, "key").orderBy("point").collect()] == [-6, 10, 13, (1 << 20) + 2]


def test_empty_tables(spark):
    none = contiguous_runs(spark.createDataFrame([], SPANS))
    assert rows(none) == []
    refs = spark.createDataFrame([(1, "a", 1, "")], REFS)
    assert orphans(refs, none).count() == 1
    assert orphans(refs.where(F.lit(False)), none).count() == 0
