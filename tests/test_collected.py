"""A23 with more items in a group than a part holds."""

from rajut.operators import aggregates
from rajut.plans import graphs


def test_collected_lists_every_item(spark):
    rows = [("X", f"t{i:03d}") for i in range(250)] * 2 + [(None, "a"), ("Y", "b")]
    parts = aggregates.collected(spark.createDataFrame(rows, "src_grade string, rel_type string"), ["src_grade"], "rel_type")
    x = {r["part"]: [i["rel_type"] for i in r["items"]] for r in parts.where("src_grade = 'X'").collect()}
    assert [len(x[k]) for k in (1, 2, 3)] == [100, 100, 50] and sum((x[k] for k in (1, 2, 3)), []) == [f"t{i:03d}" for i in range(250)]
    got = {r["src_grade"]: (r["n_items"], r["types"]) for r in graphs._types(parts).collect()}
    assert got == {"X": (250, ";".join(f"t{i:03d}" for i in range(250))), None: (1, "a"), "Y": (1, "b")}
