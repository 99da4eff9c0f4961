"""Counts and distributions over graphs, surveys and ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rajut.functions.scalars import ratio


def count_where(df: DataFrame, by: list[str] = (), **tests: Column) -> DataFrame:
    """One conditional count per name in one pass."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.coalesce(t, F.lit(False)).cast("int")), F.lit(0)).alias(k) for k, t in tests.items()])


def embedding_coverage(nodes: DataFrame) -> DataFrame:
    """Nodes, nodes with a vector, different models."""
    return nodes.agg(F.count(F.lit(1)).alias("n_total"), F.count("embedding").alias("n_embedded"), F.countDistinct("embedding_model").alias("n_models"))


def children_per(parents: DataFrame, children: DataFrame, key: str, what: str) -> DataFrame:
    """A10: different children of every parent, 0 where there are none."""
    n = children.groupBy(key).agg(F.countDistinct(what).alias("n"))
    return parents.select(key).distinct().join(n, key, "left").fillna(0, ["n"])


def type_distribution(edges: DataFrame) -> DataFrame:
    """A11."""
    return edges.groupBy("rel_type", "graph_role").agg(F.count(F.lit(1)).alias("n"))


def confidence_by_type(edges: DataFrame) -> DataFrame:
    """N, mean, median, least and most confidence per type."""
    return edges.where(F.col("confidence").isNotNull()).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean"), F.median("confidence").alias("median"), F.min("confidence").alias("least"), F.max("confidence").alias("most"))


def direction_distribution(edges: DataFrame, rel_type: str) -> DataFrame:
    """Edges of one type by source and target grade, with their share."""
    by = edges.where(F.col("rel_type") == rel_type).groupBy("src_grade", "tgt_grade").agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row per pair of grades


def bridges(edges: DataFrame, least: int = 2, most: int = 10) -> DataFrame:
    """Concepts linked to at least ``least`` other grades in either direction, the ``most`` widest."""
    a = edges.select(F.col("src_grade").alias("grade"), F.col("src").alias("name"), F.col("tgt_grade").alias("other"))
    b = edges.select(F.col("tgt_grade").alias("grade"), F.col("tgt").alias("name"), F.col("src_grade").alias("other"))
    reach = a.unionByName(b).where(F.col("other") != F.col("grade")).groupBy("grade", "name").agg(F.countDistinct("other").alias("reach"))
    return reach.where(F.col("reach") >= least).orderBy(F.desc("reach"), "grade", "name").limit(most)


def touched(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Different concepts with an edge, and their share of all."""
    a = edges.select(F.col("src_grade").alias("grade"), F.col("src").alias("name")).unionByName(edges.select(F.col("tgt_grade").alias("grade"), F.col("tgt").alias("name"))).distinct()
    marked = nodes.select("grade", "name").join(a.withColumn("_t", F.lit(1)), ["grade", "name"], "left")
    return marked.agg(F.count("_t").alias("n_touched"), F.count(F.lit(1)).alias("n_nodes"), ratio(F.count("_t"), F.count(F.lit(1))).alias("share"))


def survey_rates(answers: DataFrame, by: list[str] = ()) -> DataFrame:
    """Shares of valid relation, right type and right direction; NA stays out of the direction's denominator.

    Columns: valid ('Ya'/'Tidak'), type_ok ('Benar'/'Salah'), direction ('Benar'/'Terbalik'/'NA').
    """
    has = lambda c, *vs: F.sum(F.col(c).isin(*vs).cast("int"))
    return answers.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        ratio(has("valid", "Ya"), has("valid", "Ya", "Tidak")).alias("validity"),
        ratio(has("type_ok", "Benar"), has("type_ok", "Benar", "Salah")).alias("type_rate"),
        ratio(has("direction", "Benar"), has("direction", "Benar", "Terbalik")).alias("direction_rate"),
    )


def shares(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts and shares of groups."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row per group of a small vocabulary


def confidence_band(c: Column | str) -> Column:
    """The band of a confidence."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x < 0.5, "<0.5").when(x < 0.7, "[0.5,0.7)").when(x < 0.85, "[0.7,0.85)").when(x < 1, "[0.85,1)").when(x == 1, "=1")


def sweep(ranked: DataFrame, configs: list[tuple[float, int]], pairs: bool = True) -> DataFrame:
    """Number of unordered pairs for each (threshold, k), in one pass over the ranked neighbours (q, id, sim, rank)."""
    tests = [((F.col("sim") >= t) & (F.col("rank") <= k)).cast("int") for t, k in configs]
    other = ranked.where(F.col("q") != F.col("id")).groupBy(F.least("q", "id").alias("a"), F.greatest("q", "id").alias("b")).agg(*[F.max(t).alias(f"t{i}") for i, t in enumerate(tests)])
    one = other.agg(*[F.coalesce(F.sum(f"t{i}"), F.lit(0)).alias(f"t{i}") for i in range(len(configs))])
    rows = ", ".join(f"cast({t} as double), {k}, t{i}" for i, (t, k) in enumerate(configs))
    return one.select(F.expr(f"stack({len(configs)}, {rows}) as (threshold, k, n_pairs)"))


def totals_by(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts per row with one column per stated value."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).fillna(0)


def collected(df: DataFrame, by: list[str], *fields: str, most: int = 100) -> DataFrame:
    """All different field combinations per group, sorted, and their number; in parts (from 1) of ``most`` items, a row each."""
    once = df.select(*by, *fields).distinct()
    w = Window.partitionBy(*by)
    numbered = once.withColumn("part", F.ceil(F.row_number().over(w.orderBy(*fields)) / most).cast("int")).withColumn("n_items", F.count(F.lit(1)).over(w))
    return numbered.groupBy(*by, "part").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("items"), F.max("n_items").alias("n_items"))
