"""Mixing sources to target shares of the total size by systematic sampling.

Sizes are tokens of a public tokenizer. The mixture is as large as the targets
and repeat limits allow (``total = min(max_repeats * tokens / share)`` over the
sources) or of a given size, where a source that cannot reach its share is used
max_repeats times and the report shows what it falls short.

Each document of a source has the same expected number of copies. Within a
source documents are put in an order (size class, then hash), expected copies are
prefix-summed, one random offset is added, and a document is emitted once per
integer boundary it crosses. Ordering by size class makes the sample follow the
size distribution, so reached shares lie close to the targets. Prefix sums are
two-level: totals of blocks first, then within blocks, so a source that holds
most rows is spread over many tasks. Expected copies are integers in units of
1 / UNIT, so sums are exact and a document never exceeds max_repeats.

Defined results: a null text has 0 tokens; documents without id, and those whose
source has no weight or no positive share, are not drawn; an id given twice counts
once; a weight given twice for a source counts once (the smaller share); a source
without tokens is drawn 0 times; an empty table gives an empty sample and a report
of zeros.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rajut.session import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenisation pattern that belongs to that vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
UNIT = 1 << 20
#: Blocks of a size class of a source: at least so many, and as many as it takes for one to hold at most BLOCK_DOCS documents of the source.
BLOCKS, BLOCK_DOCS = 64, 1_000_000
MAX_SOURCES = 10_000


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as fh:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, fh) if a}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str, text: str, keep: dict[str, str], vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens and the columns of ``keep`` (new name -> column).

    The vocabulary file is read where the driver has it and sent to the workers by
    Spark; a driver without it leaves the path to the workers.
    """
    name = os.path.basename(vocabulary)
    sent = os.path.isfile(vocabulary)
    if sent:
        docs.sparkSession.sparkContext.addFile(vocabulary)
    picked = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").alias(n) for n, c in keep.items()])
    fields = ", ".join(["doc_id long", "n_tokens long", *(f"`{n}` {picked.schema[n].dataType.simpleString()}" for n in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(SparkFiles.get(name) if sent else vocabulary, pattern).encode_ordinary
        for batch in batches:
            sizes = pa.array([len(encode(t)) if t else 0 for t in batch["text"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], sizes, *[batch[n] for n in keep]], names=["doc_id", "n_tokens", *keep])

    return picked.where(F.col("doc_id").isNotNull()).mapInArrow(run, fields)


def sized(docs: DataFrame, doc_id: str, text: str, source: str, **tokenizer) -> DataFrame:
    """doc_id, source, n_tokens, materialised once in the shared folder."""
    return cut(token_counts(docs, doc_id, text, {"source": source}, **tokenizer).groupBy("doc_id").agg(F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens")))


def plan(sizes: DataFrame, weights: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per weighted source: source, target_share, max_repeats, tokens, n_docs, expected (in units of 1 / UNIT)."""
    w = weights.select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("long").alias("max_repeats"))
    w = w.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)).groupBy("source").agg(F.min("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    if w.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources have weights")
    have = sizes.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    both = w.join(have, "source", "left").fillna(0, ["tokens", "n_docs"])
    limit = F.col("max_repeats") * F.col("tokens") / F.col("target_share")
    if total_tokens is None:
        everything = Window.partitionBy()  # at most MAX_SOURCES rows
        size = F.min(F.when(F.col("tokens") > 0, limit)).over(everything)
    else:
        size = F.lit(float(total_tokens))
    rate = F.least(F.col("max_repeats").cast("double"), F.col("target_share") * size / F.nullif(F.col("tokens"), F.lit(0)))
    return both.withColumn("expected", F.coalesce(F.round(rate * UNIT).cast("long"), F.lit(0)))


def sample(sizes: DataFrame, planned: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, n_tokens, copies (at least 1) of the drawn documents."""
    order = F.xxhash64(F.lit(seed), "doc_id")
    rates = F.broadcast(planned.where(F.col("expected") > 0).select("source", "expected", F.greatest(F.lit(BLOCKS), F.ceil(F.col("n_docs") / BLOCK_DOCS)).alias("blocks")))  # at most MAX_SOURCES rows
    mine = sizes.join(rates, "source").select("source", "doc_id", "n_tokens", "expected", "blocks", F.floor(4 * F.log2(F.col("n_tokens") + 1.0)).cast("int").alias("cls"), order.alias("h"))
    mine = mine.withColumn("blk", F.pmod(F.shiftright(F.col("h"), 8), F.col("blocks")))
    totals = mine.groupBy("source", "cls", "blk").agg(F.sum("expected").alias("all"))
    before = Window.partitionBy("source").orderBy("cls", "blk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("source", "cls", "blk", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "cls", "blk").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = mine.withColumn("upto", F.sum("expected").over(within)).join(starts, ["source", "cls", "blk"])
    end = F.col("base") + F.col("upto") + F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(UNIT))
    whole = F.expr(f"_end div {UNIT} - (_end - expected) div {UNIT}")
    return placed.withColumn("_end", end).withColumn("copies", whole.cast("int")).where(F.col("copies") > 0).select("doc_id", "source", "n_tokens", "copies")


def shares(drawn: DataFrame, planned: DataFrame) -> DataFrame:
    """Report per weighted source: target and reached share, documents, copies, tokens, most repeats of one document."""
    got = drawn.groupBy("source").agg(F.count(F.lit(1)).alias("docs_used"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_drawn"), F.max("copies").alias("most_repeats"))
    full = planned.join(got, "source", "left").fillna(0, ["docs_used", "copies", "tokens_drawn", "most_repeats"])
    everything = Window.partitionBy()  # at most MAX_SOURCES rows
    reached = F.col("tokens_drawn") / F.nullif(F.sum("tokens_drawn").over(everything), F.lit(0))
    return full.select("source", "target_share", F.coalesce(reached, F.lit(0.0)).alias("actual_share"), "max_repeats", "most_repeats", "docs_used", "n_docs", "copies", "tokens_drawn", F.col("tokens").alias("tokens_available"))
