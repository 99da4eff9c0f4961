"""Idempotent upserts, constraints and maintenance of node, edge and cache tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rajut.functions.normalize import content_key, strip


def last_writer(rows: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """One row per key, the one written last."""
    ordinal = F.col(order) if isinstance(order, str) else order
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordinal).alias("_v"))
    return last.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])


def merge(old: DataFrame, new: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """M1: upsert. New rows replace old rows of their key, the last of several wins; applying it twice changes nothing."""
    latest = last_writer(new, keys, order)
    cols = latest.columns
    kept = old.join(latest.select(*keys), keys, "left_anti")
    return kept.select(*[F.col(c) if c in kept.columns else F.lit(None).alias(c) for c in cols]).unionByName(latest)


def skeleton(entries: DataFrame) -> DataFrame:
    """M2: distinct nodes of each level of (document, bab, sub_bab) with their parent; blank names make no node."""
    named = entries.select("document", strip("bab").alias("bab"), strip("sub_bab").alias("sub_bab"))
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    docs = named.where(has("document")).select(F.lit("Document").alias("label"), F.col("document").alias("name"), F.lit(None).cast("string").alias("parent"), "document")
    babs = named.where(has("document") & has("bab")).select(F.lit("Bab").alias("label"), F.col("bab").alias("name"), F.col("document").alias("parent"), "document")
    subs = named.where(has("document") & has("bab") & has("sub_bab")).select(F.lit("SubBab").alias("label"), F.col("sub_bab").alias("name"), F.col("bab").alias("parent"), "document")
    return docs.unionByName(babs).unionByName(subs).distinct()


def drop_grade(nodes: DataFrame, edges: DataFrame, grade: str) -> tuple[DataFrame, DataFrame]:
    """M5: nodes and edges without a grade and without the edges that would dangle."""
    keep = F.coalesce(F.col("grade") != grade, F.lit(True))
    ends = F.coalesce(F.col("src_grade") != grade, F.lit(True)) & F.coalesce(F.col("tgt_grade") != grade, F.lit(True))
    return nodes.where(keep), edges.where(ends)


def violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """M6: keys that more than one row has."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def unique_pairs(links: DataFrame, a: list[str], b: list[str], order: str) -> DataFrame:
    """M7: of the links between two unordered ends the first."""
    x, y = F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(a)]), F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(b)])
    keyed = links.withColumn("_p", F.least(x, y)).withColumn("_q", F.greatest(x, y))
    rest = F.struct(*links.columns)
    return keyed.groupBy("_p", "_q").agg(F.min_by(rest, order).alias("v")).select("v.*")


def review(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """M8: ratings overwrite, comments keep what is there, reviewers counted by their non-blank ratings.

    Both sides: key, ratings and comments as maps.
    """
    both = old.select(key, F.col("ratings").alias("r0"), F.col("comments").alias("c0")).join(new.select(key, F.col("ratings").alias("r1"), F.col("comments").alias("c1")), key, "left")
    none = F.create_map().cast("map<string,string>")
    over = F.map_zip_with(F.coalesce("r0", none), F.coalesce("r1", none), lambda k, a, b: F.coalesce(b, a))
    keep = F.map_zip_with(F.coalesce("c0", none), F.coalesce("c1", none), lambda k, a, b: F.coalesce(F.when(strip(a) != "", a), b, a))
    merged = both.select(key, over.alias("ratings"), keep.alias("comments"))
    return merged.withColumn("n_reviewers", F.size(F.filter(F.map_values("ratings"), lambda v: strip(F.coalesce(v, F.lit(""))) != "")))


def add_missing(chapters: DataFrame, relations: DataFrame, proposed: DataFrame) -> DataFrame:
    """M9: proposals whose chapter exists (ignoring case and spaces) and that no relation holds already.

    Their subtopic is 'Expert Proposed Triples' where the concept is new.
    chapters: chapter. relations and proposed: chapter, subject, relation, target, description.
    """
    known = chapters.select(content_key("chapter").alias("_c"), F.col("chapter").alias("in_chapter")).groupBy("_c").agg(F.min("in_chapter").alias("in_chapter"))
    there = relations.select(content_key("subject", "relation", "target", "description").alias("_k")).distinct()
    subjects = relations.select(content_key("subject").alias("_s")).distinct().withColumn("_old", F.lit(True))
    rows = proposed.withColumn("_c", content_key("chapter")).join(known, "_c").withColumn("_k", content_key("subject", "relation", "target", "description")).join(there, "_k", "left_anti")
    once = rows.groupBy("_k").agg(F.min_by(F.struct("in_chapter", "subject", "relation", "target", "description"), F.struct("in_chapter", "subject", "relation", "target")).alias("v")).select("v.*")
    placed = once.withColumn("_s", content_key("subject")).join(subjects, "_s", "left")
    return placed.select(F.col("in_chapter").alias("chapter"), F.when(F.col("_old").isNull(), "Expert Proposed Triples").alias("subtopic"), "subject", "relation", "target", "description")


def expired(cache: DataFrame, at: Column, days: int = 90) -> DataFrame:
    """Entries older than ``days`` at a moment."""
    return cache.where(F.col("created_at") < at - F.make_dt_interval(F.lit(days)))


def cache_stats(cache: DataFrame, by: str) -> DataFrame:
    """Entries, first and last creation per kind."""
    return cache.groupBy(by).agg(F.count(F.lit(1)).alias("n_entries"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
