"""Duplicates hidden by formatting: byte-identical collapse, then canonical collapse.

1. Byte-identical rows are collapsed with their counts, told by 128 bits of a hash of
   their bytes (two different texts among n rows meet with a chance of n^2 / 2^129).
   One text of each is kept, picked by partial aggregation before the shuffle, so a
   group of copies that holds a third of all rows costs one text per task; ids and
   hashes travel without the text.
2. Only the distinct survivors are canonicalised: letters and digits in order,
   lower-cased, field by field and list element by list element.
3. Survivors are grouped again on the full canonical text, the counts summed.

Defined results: a null text equals a blank one and a null list an empty one;
rows without an id are ignored; a row delivered again under the same id counts
once; an empty table gives empty results; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rajut.functions.text import alike_key
from rajut.operators.skew import lookup
from rajut.session import cut


def canonical(texts: list[Column], lists: list[Column]) -> Column:
    """The full canonical text of a record as one JSON array of arrays."""
    whole = [F.array(F.coalesce(alike_key(t), F.lit(""))) for t in texts]
    parts = [F.coalesce(F.transform(x, lambda e: F.coalesce(alike_key(e), F.lit(""))), F.array().cast("array<string>")) for x in lists]
    return F.to_json(F.array(*whole, *parts))


def _hashes(text: Column, name: str) -> list[Column]:
    return [F.xxhash64(text).alias(f"{name}1"), F.xxhash64(F.lit(1), text).alias(f"{name}2")]


def collapse(df: DataFrame, id_col: str, raw: list[str], texts: list[Column], lists: list[Column] = ()) -> tuple[DataFrame, DataFrame]:
    """Returns (groups, members).

    groups: keep_id, n_copies, canon - one row per different record.
    members: keep_id, copy_id - one row per copy other than the kept one.
    ``raw`` names the columns whose bytes make up a record; ``texts`` and
    ``lists`` are expressions over them.
    """
    given = df.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("_id"), *[F.col(f"`{c}`") for c in raw])
    whole = F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(raw)]))  # nulls are left out, so they differ from ''
    given = given.select("_id", *_hashes(whole, "h"), *[F.col(f"`{c}`") for c in raw])
    # a row delivered again has the same id and the same bytes
    ids = cut(given.select("_id", "h1", "h2").distinct())
    counted = ids.groupBy("h1", "h2").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    text = given.groupBy("h1", "h2").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in raw])).alias("_v")).select("h1", "h2", "_v.*")
    canon = text.select("h1", "h2", canonical(texts, list(lists)).alias("canon"))
    forms = cut(canon.join(counted, ["h1", "h2"]).select("h1", "h2", "_first", "_n", "canon", *_hashes(F.col("canon"), "c")))
    groups = forms.groupBy("canon").agg(F.min("_first").alias("keep_id"), F.sum("_n").alias("n_copies"), F.count(F.lit(1)).alias("_forms"), F.first("c1").alias("c1"), F.first("c2").alias("c2"))
    several = cut(groups.where(F.col("n_copies") > 1).select("c1", "c2", "keep_id", "_forms"))
    placed = cut(lookup(forms.select("h1", "h2", "_first", "_n", "c1", "c2"), several, ["c1", "c2"], "_forms").select("h1", "h2", "_first", "_n", "keep_id"))
    alone = placed.where(F.col("_n") == 1).select("keep_id", F.col("_first").alias("copy_id"))
    copies = lookup(ids, placed.where(F.col("_n") > 1).select("h1", "h2", "_n", "keep_id"), ["h1", "h2"], "_n").select("keep_id", F.col("_id").alias("copy_id"))
    members = alone.unionByName(copies).where(F.col("copy_id") != F.col("keep_id"))
    return groups.select("keep_id", "n_copies", "canon"), members


RECORD = "name string, description string, formula array<string>, variables array<string>, kondisi array<string>"


def collapse_records(df: DataFrame, id_col: str, record_col: str) -> tuple[DataFrame, DataFrame]:
    """As :func:`collapse` for records received as JSON text, in any field order and escaping.

    Text that is no JSON object has no fields; such records would all be alike,
    so each distinct unreadable text is a record of its own.
    """
    body = F.from_json(F.col(f"`{record_col}`"), RECORD, {"allowUnquotedControlChars": "true"})
    readable = body["name"].isNotNull() | body["description"].isNotNull() | body["formula"].isNotNull() | body["variables"].isNotNull() | body["kondisi"].isNotNull()
    spare = F.when(~F.coalesce(readable, F.lit(False)), F.col(f"`{record_col}`"))
    return collapse(df, id_col, [record_col], [body["name"], body["description"], spare], [body["formula"], body["variables"], body["kondisi"]])
