"""References to records that do not exist, are deleted, or arrive later.

Parent keys are points on an integer axis inside a namespace. Sorted keys are
compressed into contiguous *runs* ``[start, end)``; a reference is matched
as-of to the last run that starts at or before it and is an orphan when no
such run exists or when it lies at or beyond that run's end.

Two uses are the same computation:

* integer keys: the point is the key itself and each parent covers
  ``[key, key + 1)``, so ids 1..9 and 12 become the runs [1, 10) and [12, 13);
* existence in time: the namespace is the parent's name, the point is an
  instant in microseconds and each parent covers ``[created, deleted)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rajut.session import cut

FOREVER = (1 << 62)
#: Width of the buckets by which runs are merged first: a quarter of a year in
#: microseconds. A namespace's intervals are merged bucket by bucket before
#: what is left is merged over the whole namespace.
BUCKET = 90 * 86_400_000_000
#: References that one as-of task handles for one namespace.
BLOCK_ROWS = 200_000


def _merge(spans: DataFrame, by: list[str]) -> DataFrame:
    before = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    opened = spans.withColumn("_reach", F.max("end").over(before))
    opened = opened.withColumn("_new", (F.col("_reach").isNull() | (F.col("start") > F.col("_reach"))).cast("long"))
    numbered = opened.withColumn("_run", F.sum("_new").over(upto))
    return numbered.groupBy(*by, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def contiguous_runs(spans: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Compress spans (ns, start, end) into disjoint runs per namespace.

    Spans that touch or overlap become one run. Rows with a null in any column
    or with end <= start vanish; repeated rows count once. Equal spans are
    collapsed before the shuffle, and a namespace that holds a large share of
    the rows is first merged in buckets of its start, so no task sees all of it.
    """
    clean = spans.select("ns", "start", "end").where(F.col("ns").isNotNull() & (F.col("end") > F.col("start")))
    distinct = clean.groupBy("ns", "start").agg(F.max("end").alias("end"))
    part = _merge(distinct.withColumn("_b", F.floor(F.col("start") / F.lit(bucket))), ["ns", "_b"]).drop("_b")
    return _merge(part, ["ns"])


def orphans(refs: DataFrame, runs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The references that no run covers.

    ``refs`` has ns, point and any other columns; ``runs`` is what
    :func:`contiguous_runs` returns. References without ns or point are no
    references and are dropped. Repeated references stay repeated.

    References and runs are merged in the order of their points, and each reference
    takes the end of the last run that starts at or before it. A namespace of more
    than ``block_rows`` references is cut into blocks, each with a copy of its runs.
    ``refs`` is read twice: to count such namespaces, and to match.
    """
    others = [c for c in refs.columns if c not in ("ns", "point")]
    row = F.struct(*[F.col(f"`{c}`") for c in others], F.lit(True).alias("_given")).alias("_row")
    whole = [F.col(c) if c in ("ns", "point") else F.col(f"_row.`{c}`").alias(c) for c in refs.columns]
    valid = refs.where(F.col("ns").isNotNull() & F.col("point").isNotNull()).select("ns", F.col("point").cast("long").alias("point"), row)
    counted = valid.groupBy("ns").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows)
    hot = F.broadcast(cut(counted.select("ns", F.ceil(F.col("_n") / F.lit(block_rows)).cast("int").alias("_blocks"))))  # at most references / block_rows rows
    n_blocks = F.coalesce("_blocks", F.lit(1))
    own = F.when(n_blocks == 1, 0).otherwise(F.pmod(F.xxhash64("point", F.to_json("_row")), n_blocks.cast("long")).cast("int"))
    ref_rows = valid.join(hot, "ns", "left").select("ns", own.alias("_block"), "point", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_end"), "_row")
    no_row = F.lit(None).cast(ref_rows.schema["_row"].dataType).alias("_row")
    run_rows = runs.join(hot, "ns", "left").select("ns", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("_block"), F.col("start").alias("point"), F.lit(0).alias("_kind"), F.col("end").alias("_end"), no_row)
    asof = Window.partitionBy("ns", "_block").orderBy("point", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    last = ref_rows.unionByName(run_rows).withColumn("_last", F.last("_end", ignorenulls=True).over(asof))
    return last.where((F.col("_kind") == 1) & (F.col("_last").isNull() | (F.col("point") >= F.col("_last")))).select(*whole)


def integer_orphans(children: DataFrame, child_key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows of ``children`` whose integer key no row of ``parents`` has.

    Keys are blocked by their high bits (the namespace), so that a dense id
    space spreads over tasks; within a block contiguous ids become one run.
    Null keys are no references.
    """
    shift = 20
    spans = parents.select(F.shiftright(F.col(parent_key).cast("long"), shift).alias("ns"), F.col(parent_key).cast("long").alias("start"), (F.col(parent_key).cast("long") + 1).alias("end"))
    names = {c: f"c{i}" for i, c in enumerate(children.columns)}
    flat = children.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    key = F.col(names[child_key]).cast("long")
    refs = flat.withColumn("ns", F.shiftright(key, shift)).withColumn("point", key)
    found = orphans(refs, contiguous_runs(spans, bucket=1 << shift))
    return found.select(*[F.col(n).alias(c) for c, n in names.items()])
