import importlib
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted("|".join("null" if pd.isna(x) else f"{x:.5f}" if isinstance(x, float) else str(x) for x in r) for r in frame.itertuples(index=False))


CORE = sorted(k for m in entry.MODULES for k in m.QUERIES)


@pytest.mark.parametrize("name", CORE)
def test_core_query_matches_its_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        want = con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_training_data_operators():
    root = os.path.dirname(importlib.import_module("rajut").__file__)
    for folder, _, names in os.walk(root):
        if os.path.relpath(folder, root).split(os.sep)[0] == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n)) as fh:
                    assert "rajut.llm" not in fh.read(), n
