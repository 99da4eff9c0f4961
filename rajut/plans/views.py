"""The domain tables as a property graph: nodes and edges, in Spark and in SQL.

Concept nodes are live konsep of a book's grade, one per (grade, name); edges are
relations, one per relation_key and end points. Names are compared by their
letters and digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rajut.functions import normalize as n
from rajut.functions import vocab
from rajut.functions.text import alike_key
from rajut.plans.data import table


REL_COLUMNS = ("book_id", "src_grade", "src_name", "rel_type", "target", "tgt_grade", "relation_key", "description", "provenance", "graph_role", "consensus", "status", "n_reviewers", "confidence", "created_at", "ingested_at")


def relations(spark: SparkSession, d: str) -> DataFrame:
    """One row per rel_id. Rows delivered again may have '' where the other has null; a value wins over null."""
    return table(spark, d, "relations").groupBy("rel_id").agg(*[F.max(c).alias(c) for c in REL_COLUMNS])


#: The same in SQL.
SQL_RELATIONS = "(SELECT rel_id, " + ", ".join(f"max({c}) AS {c}" for c in REL_COLUMNS) + " FROM relations GROUP BY rel_id)"


def once(sql: str) -> str:
    """SQL in which each relation counts once."""
    return sql.replace("FROM relations", f"FROM {SQL_RELATIONS}")


def concept_nodes(spark: SparkSession, d: str) -> DataFrame:
    """grade, name, chapter, subtopic, description, label: the row with the largest konsep_id wins."""
    books = table(spark, d, "books").select("book_id", F.col("name").alias("grade"))
    live = table(spark, d, "konsep").where(F.col("deleted_at").isNull() & F.col("name").isNotNull())
    rows = live.join(F.broadcast(books), "book_id").select("grade", alike_key("name").alias("name"), F.struct("konsep_id", F.col("bab").alias("chapter"), F.col("sub_bab").alias("subtopic"), "description").alias("v"))
    last = rows.where(F.col("name") != "").groupBy("grade", "name").agg(F.max("v").alias("v"))
    return last.select("grade", "name", "v.chapter", "v.subtopic", "v.description", F.lit("Concept").alias("label"))


def concept_edges(spark: SparkSession, d: str) -> DataFrame:
    """src_grade, src, rel_type, tgt_grade, tgt and properties; a missing target grade is that of the source."""
    e = relations(spark, d).select(
        "rel_id",
        "src_grade",
        alike_key("src_name").alias("src"),
        n.relation_type("rel_type").alias("rel_type"),
        F.col("rel_type").alias("raw_type"),
        F.coalesce("tgt_grade", "src_grade").alias("tgt_grade"),
        alike_key("target").alias("tgt"),
        "graph_role",
        "consensus",
        "status",
        "confidence",
        "relation_key",
        "description",
    )
    return e.where(F.col("rel_type").isNotNull() & (F.col("src") != "") & (F.col("tgt") != ""))


def linked_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges both of whose ends are concept nodes."""
    ends = concept_nodes(spark, d).select("grade", "name")
    src, tgt = ends.select(F.col("grade").alias("src_grade"), F.col("name").alias("src")), ends.select(F.col("grade").alias("tgt_grade"), F.col("name").alias("tgt"))
    return concept_edges(spark, d).join(src, ["src_grade", "src"], "left_semi").join(tgt, ["tgt_grade", "tgt"], "left_semi")


def ordered(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[\\s\\p{{Z}}]+', ' ', 'g'), ' ')"


def sql_key(x: str) -> str:
    return f"lower(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"


def sql_list(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def sql_case(x: str, values: dict[str, str], other: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in values.items()) + f" ELSE {other} END"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


SQL_REL_TYPE = f"CASE WHEN upper({sql_strip('rel_type')}) IN ({sql_list(vocab.RELATION_TYPES)}) THEN upper({sql_strip('rel_type')}) ELSE " + sql_case(f"upper({sql_strip('rel_type')})", vocab.RELATION_SYNONYMS, "NULL") + " END"

GRAPH = f"""
WITH live AS (SELECT b.name AS grade, {sql_key("k.name")} AS name, k.konsep_id, k.bab AS chapter, k.sub_bab AS subtopic, k.description
  FROM konsep k JOIN books b ON k.book_id = b.book_id WHERE k.deleted_at IS NULL AND k.name IS NOT NULL),
nodes AS (SELECT grade, name, chapter, subtopic, description FROM (SELECT *, row_number() OVER (PARTITION BY grade, name ORDER BY konsep_id DESC) AS rn FROM live WHERE name <> '') WHERE rn = 1),
edges AS (SELECT * FROM (SELECT DISTINCT rel_id, src_grade, {sql_key("src_name")} AS src, {SQL_REL_TYPE} AS rel_type, rel_type AS raw_type, coalesce(tgt_grade, src_grade) AS tgt_grade, {sql_key("target")} AS tgt,
  graph_role, consensus, status, confidence, relation_key, description FROM relations) WHERE rel_type IS NOT NULL AND src <> '' AND tgt <> ''),
linked AS (SELECT e.* FROM edges e WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.grade = e.src_grade AND n.name = e.src) AND EXISTS (SELECT 1 FROM nodes n WHERE n.grade = e.tgt_grade AND n.name = e.tgt))
"""
