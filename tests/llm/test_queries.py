"""Registered training-data queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from rajut.llm import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = sorted(map(str, (tuple(r[c] for c in sorted(got.columns)) for r in got.collect())))
    if name in catalog.ORACLE:
        want = con.sql(catalog.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows == sorted(map(str, (tuple(x.item() if hasattr(x, "item") else x for x in r) for r in want[sorted(want.columns)].itertuples(index=False))))
