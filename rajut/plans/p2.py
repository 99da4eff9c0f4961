"""Problem 2: references to records that do not exist at the time of the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rajut.functions.text import alike_key
from rajut.operators.orphans import FOREVER, contiguous_runs, orphans
from rajut.plans.data import table
from rajut.session import cut


def references(spark: SparkSession, d: str) -> DataFrame:
    """One row for each reference: ns (the target's letters and digits), point (microseconds)."""
    inner = (
        table(spark, d, "konsep")
        .select("konsep_id", "relations", "created_at")
        .dropDuplicates(["konsep_id"])
        .select("konsep_id", "created_at", F.posexplode("relations").alias("rel_pos", "rel"))
        .select(F.lit("konsep").alias("src_table"), F.col("konsep_id").alias("src_id"), "rel_pos", F.col("rel.target").alias("target"), "created_at")
    )
    flat = (
        table(spark, d, "relations")
        .select("rel_id", "target", "created_at")
        .dropDuplicates(["rel_id"])
        .select(F.lit("relations").alias("src_table"), F.col("rel_id").alias("src_id"), F.lit(0).alias("rel_pos"), "target", "created_at")
    )
    every = inner.unionByName(flat).withColumn("ns", alike_key("target")).withColumn("point", F.unix_micros("created_at"))
    return every.where(F.col("ns") != "").select("src_table", "src_id", "rel_pos", "ns", "point")


def parents(spark: SparkSession, d: str) -> DataFrame:
    """The spans of existence of every konsep name and glossary term."""
    konsep = table(spark, d, "konsep").where(F.col("name").isNotNull() & F.col("created_at").isNotNull())
    spans = konsep.select(alike_key("name").alias("ns"), F.unix_micros("created_at").alias("start"), F.coalesce(F.unix_micros("deleted_at"), F.lit(FOREVER)).alias("end"))
    terms = table(spark, d, "glosarium").select(alike_key("term").alias("ns"), F.lit(-FOREVER).alias("start"), F.lit(FOREVER).alias("end"))
    return spans.unionByName(terms).where(F.col("ns") != "")


def orphan_references(spark: SparkSession, d: str) -> DataFrame:
    return orphans(cut(references(spark, d)), contiguous_runs(parents(spark, d)))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(spark, d).select("src_table", "src_id", "rel_pos")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table and month of the reference."""
    month = F.date_format(F.timestamp_micros("point"), "yyyy-MM")
    return orphan_references(spark, d).groupBy("src_table", month.alias("month")).agg(F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("ns").alias("n_targets"))


def p2_integer_orphans(spark: SparkSession, d: str) -> DataFrame:
    """subkonsep rows whose konsep_id no konsep has: the operator on integer keys."""
    from rajut.operators.orphans import integer_orphans

    sub = table(spark, d, "subkonsep").select("sub_id", "konsep_id").dropDuplicates(["sub_id"])
    return integer_orphans(sub, "konsep_id", table(spark, d, "konsep").where(F.col("deleted_at").isNull()), "konsep_id")


_KEY = "lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
_ORPHANS = f"""
WITH refs AS (
  SELECT 'konsep' AS src_table, konsep_id AS src_id, CAST(i - 1 AS INTEGER) AS rel_pos, {_KEY.format("relations[i].target")} AS k, created_at AS t
  FROM (SELECT konsep_id, any_value(relations) AS relations, any_value(created_at) AS created_at FROM konsep GROUP BY konsep_id), range(1, 1000) r(i)
  WHERE i <= len(relations)
  UNION ALL
  SELECT 'relations', rel_id, 0, {_KEY.format("any_value(target)")}, any_value(created_at) FROM relations GROUP BY rel_id
), named AS (SELECT DISTINCT {_KEY.format("name")} AS k, created_at AS a, deleted_at AS b FROM konsep),
terms AS (SELECT DISTINCT {_KEY.format("term")} AS k FROM glosarium),
orphan AS (
  SELECT * FROM refs r WHERE k IS NOT NULL AND k <> ''
  AND NOT EXISTS (SELECT 1 FROM terms WHERE terms.k = r.k)
  AND NOT EXISTS (SELECT 1 FROM named n WHERE n.k = r.k AND n.a <= r.t AND (n.b IS NULL OR n.b > r.t))
)
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p2_integer_orphans": p2_integer_orphans}
ORACLE = {
    "p2_found": _ORPHANS + "SELECT src_table, src_id, rel_pos FROM orphan",
    "p2_report": _ORPHANS + "SELECT src_table, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n_orphans, count(DISTINCT k) AS n_targets FROM orphan GROUP BY ALL",
    "p2_integer_orphans": """SELECT DISTINCT sub_id, konsep_id FROM subkonsep s WHERE konsep_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM konsep k WHERE k.konsep_id = s.konsep_id AND k.deleted_at IS NULL)""",
}
