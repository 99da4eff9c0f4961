"""Agreement and graded scores of raters, and consensus construction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rajut.functions import vocab
from rajut.functions.normalize import all_present, content_key, counted, rating_label, scored_label
from rajut.functions.scalars import ratio

KEYS = ["chapter", "subject", "relation", "target", "description"]


def align_raters(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """Full outer join of two raters (triple_id, rating); a missing side is 'unknown'."""
    a, b = r1.select("triple_id", F.col("rating").alias("a")), r2.select("triple_id", F.col("rating").alias("b"))
    return a.join(b, "triple_id", "full_outer").select("triple_id", rating_label("a").alias("r1_rating"), rating_label("b").alias("r2_rating"))


def common_ratings(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """Triples both raters gave a scored label."""
    a = r1.select("triple_id", scored_label("rating").alias("r1_rating")).where(F.col("r1_rating").isNotNull())
    b = r2.select("triple_id", scored_label("rating").alias("r2_rating")).where(F.col("r2_rating").isNotNull())
    return a.join(b, "triple_id")


def with_context(ratings: DataFrame, triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ratings with their triple's fields, ratings of unknown triples)."""
    known = triples.select("triple_id", *KEYS)
    return ratings.join(known, "triple_id"), ratings.join(known, "triple_id", "left_anti")


def split_agreed(aligned: DataFrame) -> DataFrame:
    """A1: the bucket of each aligned pair; unknown never agrees with unknown."""
    same = (F.col("r1_rating") == F.col("r2_rating")) & (F.col("r1_rating") != "unknown")
    return aligned.select(
        "*",
        F.when(same, "ratings_agreed").otherwise("ratings_disagreed_llm").alias("bucket"),
        F.when(same, F.col("r1_rating")).alias("final_consensus_label"),
        F.when(same, vocab.AGREED_RATINGS).alias("reasoning"),
        F.lit("system_generated").alias("source"),
    )


def missing_agreed(m1: DataFrame, m2: DataFrame) -> DataFrame:
    """Missing triples that both proposed."""
    a, b = (m.where(all_present("chapter", "subject", "relation", "target")).select(*KEYS).distinct() for m in (m1, m2))
    null_safe = [a[k].eqNullSafe(b[k]) for k in KEYS]
    return a.join(b, null_safe, "left_semi")


def missing_disagreed(m1: DataFrame, m2: DataFrame) -> DataFrame:
    """Missing triples that one of the two proposed, with the reviewer; repeated proposals stay."""
    out = None
    for own, other, who in ((m1, m2, "r1"), (m2, m1, "r2")):
        a = own.where(all_present("chapter", "subject", "relation", "target")).select(*KEYS)
        b = other.where(all_present("chapter", "subject", "relation", "target")).select(*KEYS).distinct()
        only = a.join(b, [a[k].eqNullSafe(b[k]) for k in KEYS], "left_anti").withColumn("reviewer", F.lit(who))
        out = only if out is None else out.unionByName(only)
    return out


def first_by_content(rows: DataFrame, order: list[Column], *cols: str) -> DataFrame:
    """Of the rows with one content key the first in ``order``."""
    keyed = rows.withColumn("_key", content_key(*cols))
    return keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).where(F.col("_n") == 1).drop("_n")


def apply_gold(relations: DataFrame, gold: DataFrame) -> DataFrame:
    """Relations with the label of the last gold row of their content; only the first relation of a content is updated.

    relations: ord, subject, relation, target. gold: ord, subject, relation, target, label.
    """
    first = first_by_content(relations, [F.col("ord")], "subject", "relation", "target").select("ord", "_key")
    last = gold.withColumn("_key", content_key("subject", "relation", "target")).groupBy("_key").agg(F.max_by("label", "ord").alias("gold_label"))
    return relations.join(first.join(last, "_key").select("ord", "gold_label"), "ord", "left")


def gwet(pairs: DataFrame, by: list[str] = (), labels: tuple[str, ...] = vocab.SCORED_LABELS) -> DataFrame:
    """A2: Gwet's AC1 of columns r1_rating and r2_rating with a fixed label set.

    n, pa, pe, ac1; all 0 without pairs; ac1 is 0 where pe is 1.
    """
    shares = [F.sum((F.col("r1_rating") == x).cast("int") + (F.col("r2_rating") == x).cast("int")).alias(f"c{i}") for i, x in enumerate(labels)]
    one = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("r1_rating") == F.col("r2_rating")).cast("int")), F.lit(0)).alias("same"), *shares)
    p = [ratio(F.coalesce(F.col(f"c{i}"), F.lit(0)), 2 * F.col("n")) for i in range(len(labels))]
    pe = sum((x * (1 - x) for x in p), F.lit(0.0)) / (len(labels) - 1)
    out = one.select(*by, "n", ratio("same", "n").alias("pa"), pe.alias("pe"))
    return out.withColumn("ac1", F.when((F.col("n") == 0) | (F.col("pe") == 1), 0.0).otherwise((F.col("pa") - F.col("pe")) / (1 - F.col("pe"))))


def with_overall(df: DataFrame, column: str) -> DataFrame:
    """Rows once more under 'Overall'."""
    return df.unionByName(df.withColumn(column, F.lit("Overall")))


def graded_scores(labels: DataFrame, by: list[str], extra: str = "n_missing") -> DataFrame:
    """A4, A5: precision, recall and F1 of labels with half credit for partial and a quarter for missing.

    ``labels``: the ``by`` columns, label, and weight; ``n_missing`` counts accepted
    missing triples per group (same on all rows of a group).
    """
    parts = [F.coalesce(F.sum(F.when(F.col("label") == x, F.col("weight")).otherwise(0)), F.lit(0)).alias(x) for x in ("correct", "partial", "wrong", "missing")]
    one = labels.groupBy(*by).agg(*parts, F.coalesce(F.sum(F.when(F.col("label") == "added", F.col("weight"))), F.lit(0)).alias(extra))
    score = F.col("correct") + 0.5 * F.col("partial") + 0.25 * F.col("missing")
    out = one.withColumn("precision", ratio(score, F.col("correct") + F.col("partial") + F.col("wrong") + F.col("missing"))).withColumn("recall", ratio(score, F.col("correct") + F.col("partial") + F.col("missing") + F.col(extra)))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def accepted_missing(gold: DataFrame) -> DataFrame:
    """Additions (no triple id) with a counted label."""
    return gold.where(F.col("triple_id").isNull() & counted("label")).agg(F.count(F.lit(1)).alias("n_accepted"))


def within_budget(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The running number of each row and whether it is within the budget.

    Numbers run over all rows in two levels, so no task sorts them all: ``order``
    must begin with a column that splits them (its value is the block).
    """
    block = order[0]
    blocks = rows.groupBy(block.alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    start = blocks.select("_b", (F.sum("_c").over(Window.orderBy("_b")) - F.col("_c")).alias("_s"))
    numbered = rows.withColumn("_b", block).withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(*order[1:])))
    out = numbered.join(start, "_b").withColumn("ordinal", F.col("_r") + F.col("_s") - 1)
    return out.withColumn("in_budget", F.col("ordinal") < most).drop("_b", "_r", "_s")


def added_by(*flags: tuple[str, Column]) -> Column:
    """Names of the reviewers whose flag holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in flags]))
