"""Joins of graph rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rajut.functions.normalize import strip, triple_key


def comments_of(rows: DataFrame, comments: DataFrame, id_col: str = "triple_id") -> DataFrame:
    """The comment of each row by an id that may be written in several ways; comments: raw_id, comment."""
    keyed = comments.select(triple_key("raw_id").alias("_k"), strip("comment").alias("comment")).where(F.coalesce("comment", F.lit("")) != "")
    one = keyed.groupBy("_k").agg(F.min("comment").alias("comment"))
    return rows.withColumn("_k", triple_key(id_col)).join(one, "_k", "left").drop("_k")


def target_kind(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Whether an edge's target is a known Concept of its grade or only a ConceptTarget."""
    known = nodes.select(F.col("grade").alias("tgt_grade"), F.col("name").alias("tgt"), F.lit(True).alias("_known"))
    same = (F.col("src_grade") == F.col("tgt_grade")) & (F.col("src") == F.col("tgt"))
    marked = edges.where(~F.coalesce(same, F.lit(False))).join(known, ["tgt_grade", "tgt"], "left")
    return marked.withColumn("tgt_label", F.when(F.col("_known"), "Concept").otherwise("ConceptTarget")).drop("_known")


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends exist; the others vanish."""
    ends = nodes.select("grade", "name")
    a = ends.select(F.col("grade").alias("src_grade"), F.col("name").alias("src"))
    b = ends.select(F.col("grade").alias("tgt_grade"), F.col("name").alias("tgt"))
    return edges.join(a, ["src_grade", "src"], "left_semi").join(b, ["tgt_grade", "tgt"], "left_semi")


def cross_links(links: DataFrame, grades: DataFrame) -> DataFrame:
    """Links with a column ``why`` that says whether each is created or why it is skipped."""
    known = grades.select(F.col("grade").alias("tgt_grade")).distinct().withColumn("_known", F.lit(True))
    blank = (strip(F.coalesce("tgt", F.lit(""))) == "") | (strip(F.coalesce("tgt_grade", F.lit(""))) == "")
    marked = links.join(known, "tgt_grade", "left")
    why = F.when(blank, "incomplete").when(F.col("src_grade") == F.col("tgt_grade"), "same_grade").when(F.col("_known").isNull(), "unknown_grade").otherwise("created")
    return marked.withColumn("why", why).drop("_known")


def sharing(uses: DataFrame) -> DataFrame:
    """For every two concepts that use one variable a row, without building the pairs of a group.

    Pairs between neighbours in the order of names link a variable's concepts into
    one chain; with the group's size that holds the same connections. Columns:
    variable, a, b, n_users. uses: concept, variable.
    """
    from pyspark.sql import Window

    once = uses.where(F.col("variable").isNotNull() & F.col("concept").isNotNull()).select("variable", "concept").distinct()
    w = Window.partitionBy("variable").orderBy("concept")
    n = once.groupBy("variable").agg(F.count(F.lit(1)).alias("n_users"))
    chained = once.select("variable", F.lag("concept").over(w).alias("a"), F.col("concept").alias("b")).where(F.col("a").isNotNull())
    return chained.join(n, "variable")


def optional_children(parents: DataFrame, children: DataFrame, key: str, item: str) -> DataFrame:
    """Parents with the number and the least of their different children, null where there are none."""
    got = children.groupBy(key).agg(F.countDistinct(item).alias("n_items"), F.min(item).alias("first_item"))
    return parents.join(got, key, "left").fillna(0, ["n_items"])


def without_children(parents: DataFrame, children: DataFrame, keys: list[str]) -> DataFrame:
    """J19."""
    return parents.join(children.select(*keys), keys, "left_anti")
