"""Sources and sinks of graph, review and survey files."""

from __future__ import annotations

import os
import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rajut.functions.normalize import bare_type, title_of

RATINGS = "ratings map<string,string>, comments map<string,string>, missingTriples array<struct<chapter:string,subject:string,relation:string,target:string,description:string>>, generalFeedback string, completedAt string, updatedAt string"
BOOK = (
    "grade string, chapters array<struct<chapter:string, chapter_summary:string, previous:string, next:string, subchapters:array<string>,"
    "subtopics:array<struct<name:string, concepts:array<struct<name:string, description:string, glossary_validated:boolean, materi_pokok_ref:string, provenance:string,"
    "relations:array<struct<type:string, target:string, target_concept:string, description:string, provenance:string>>>>>>,"
    "chapter_relations:array<struct<type:string,target_chapter:string,description:string>>>>"
)
ANSWERS = "answers map<string, struct<relationValid:string, relationTypeCorrect:string, directionCorrect:string, comment:string>>"
CHECKPOINT = "checkpoint_key string, checkpoint_name string, subject string, grade string, reasoning string, final_consensus_label string"


def read_document(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Whole-file JSON documents of a known schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_checkpoint(spark: SparkSession, path: str, resume: bool = True) -> DataFrame:
    """The last record of each key of JSON lines; blank and malformed lines are skipped.

    'Last' is by file name and place in the file. Empty when not resuming or when
    the path does not exist.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    if not resume or not exists:
        return spark.createDataFrame([], CHECKPOINT)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    rec = lines.select(F.from_json("value", CHECKPOINT).alias("r"), F.struct("file", "block", "line").alias("at")).where(F.col("r.checkpoint_key").isNotNull() & (F.col("r.checkpoint_key") != ""))
    return rec.groupBy(F.col("r.checkpoint_key").alias("k")).agg(F.max_by("r", "at").alias("r")).select("r.*")


def append_checkpoint(rows: DataFrame, path: str) -> None:
    """S3."""
    rows.write.mode("append").json(path)


def read_survey_edges(spark: SparkSession, path: str) -> DataFrame:
    """Quoted CSV with a header that may begin with a byte order mark."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def survey_answers(doc: DataFrame) -> DataFrame:
    """Survey documents as one row per edge."""
    return doc.select(F.explode("answers").alias("id", "a")).select("id", "a.*")


def put(spark: SparkSession, path: str, text: str, changed_ms: int | None = None) -> None:
    """One small text file, with a given time of change if wanted; parent folders are made."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()
    if changed_ms is not None:
        fs.setTimes(target, changed_ms, -1)


def listed(spark: SparkSession, *globs: str) -> DataFrame:
    """path, name and modificationTime of the files of some globs; their content is not read."""
    every = None
    for g in globs:
        one = spark.read.format("binaryFile").load(g).select("path", "modificationTime")
        every = one if every is None else every.unionByName(one)
    return every.withColumn("name", F.element_at(F.split("path", "/"), -1))


GOLD = "_gold_standard.json"


def discover_courses(files: DataFrame, experts: tuple[str, ...] = ("_expert_1.json", "_expert_2.json")) -> DataFrame:
    """Slug, subject of gold files without 'mock' or '(' in their name for which the files of all experts exist. files: name."""
    slug = lambda end: F.substring("name", F.lit(1), F.length("name") - len(end))
    gold = files.where(F.col("name").endswith(GOLD) & ~F.col("name").contains("mock") & ~F.col("name").contains("(")).select(slug(GOLD).alias("slug")).distinct()
    for e in experts:
        gold = gold.join(files.where(F.col("name").endswith(e)).select(slug(e).alias("slug")), "slug", "left_semi")
    return gold.select("slug", F.initcap(F.regexp_replace("slug", "[_-]", " ")).alias("subject"))


def latest_file(spark: SparkSession, *globs: str) -> DataFrame:
    """Path and time of the file changed last among some globs; of files changed at once the last path."""
    return listed(spark, *globs).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"), F.max("modificationTime").alias("changed_at"))


def read_graphs(spark: SparkSession, path: str | list[str], suffix: str = ".consensus.json") -> DataFrame:
    """Book graphs with their grade, which falls back to the file's name."""
    df = read_document(spark, path, BOOK).withColumn("_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return df.withColumn("grade", F.coalesce(F.nullif(F.trim("grade"), F.lit("")), title_of(F.regexp_replace("_file", suffix.replace(".", r"\.") + "$", "")))).drop("_file")


def nest_books(rows: DataFrame) -> DataFrame:
    """Flat relations (grade, chapter, subtopic, concept, type, target, description) as one document per grade.

    Levels are collected bottom-up and sorted; one book is one document, so books
    must fit in a task, as they must to be exported.
    """
    rel = rows.groupBy("grade", "chapter", "subtopic", "concept").agg(F.array_sort(F.collect_list(F.struct("type", "target", "description"))).alias("relations"))
    con = rel.groupBy("grade", "chapter", "subtopic").agg(F.array_sort(F.collect_list(F.struct(F.col("concept").alias("name"), "relations"))).alias("concepts"))
    sub = con.groupBy("grade", "chapter").agg(F.array_sort(F.collect_list(F.struct(F.col("subtopic").alias("name"), "concepts"))).alias("subtopics"))
    return sub.groupBy("grade").agg(F.array_sort(F.collect_list(F.struct("chapter", "subtopics"))).alias("chapters"))


def write_documents(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines; existing output is an error unless overwriting is asked for."""
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def export_path(folder: str, grade: str, at: datetime) -> str:
    """Where a book's graph made at a time is exported."""
    slug = re.sub(r"[^a-z0-9]+", "_", grade.lower()).strip("_")
    return f"{folder.rstrip('/')}/{slug}_{at:%Y%m%d_%H%M%S}.json"


def export_book(books: DataFrame, folder: str, grade: str, at: datetime) -> str:
    """The nested graph of one grade under its timestamped name, which must not exist yet; the path."""
    path = export_path(folder, grade, at)
    write_documents(books.where(F.col("grade") == grade), path)
    return path


def audit_dump(edges: DataFrame, path: str | None = None, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edge objects, type histogram by falling count) of classified edges; none and blank types are left out."""
    kept = edges.where(~F.coalesce("rel_type", F.lit("")).isin("", "none"))
    objects = kept.select("source", "target", F.to_json(F.struct("rel_type", bare_type("rel_type").alias("relation_type"), "source", "target", "confidence")).alias("edge"))
    histogram = kept.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n")).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("n"), "rel_type")))  # one row per type
    if path is not None:
        write_documents(objects, path, overwrite)
    return objects, histogram


def resolve(explicit: str | None, setting: str, spark: SparkSession, default: str | None = None) -> str | None:
    """A path by precedence: given > session setting > environment > default."""
    return explicit or spark.conf.get(setting, None) or os.environ.get(setting.upper().replace(".", "_")) or default
