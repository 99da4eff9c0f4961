"""Model calls as injected clients: classification, judging and extraction with caches.

A client is any picklable callable on a list of inputs; tests use deterministic
ones. Calls run in Arrow batches on the executors, each different input once;
answers must be written before they are used twice, as a client may not repeat
itself.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rajut.functions import vocab
from rajut.functions.normalize import rating_label, strip
from rajut.functions.scalars import cache_key, context_terms, edges_text, fingerprint, pair_text, unfenced

#: Signs of errors that pass (fixed values).
TRANSIENT = ("429", "500", "502", "503", "504", "rate limit", "timeout", "timed out", "unavailable", "overloaded")


#: Rows and chunks of one book that one task compares.
RETRIEVAL_BLOCK = 2000


def with_retry(client: Callable, attempts: int = 5, least: float = 10.0, most: float = 120.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """The client with exponential waits after errors that pass; others, and the last, are raised."""

    def call(*args):
        for n in range(attempts):
            try:
                return client(*args)
            except Exception as e:
                if n + 1 == attempts or not any(t in str(e).lower() for t in TRANSIENT):
                    raise
                sleep(min(most, least * 2**n) * (0.5 + random.random() / 2))
        return None

    return call


def prompt_kind(types: Column) -> Column:
    """Which prompt a vocabulary, an array of types, asks for: its first type says so."""
    return F.when(F.get(types, F.lit(0)).startswith(vocab.CROSS_PREFIX + "_"), "cross_book").otherwise("concept")


def pair_prompt(a: str = "a", b: str = "b") -> Column:
    """The text that describes a pair of structs (name, grade, description, out_edges)."""
    side = lambda s, tag: F.concat(F.lit(f"Konsep {tag}: "), F.col(f"{s}.name"), F.lit(f"\nMata Pelajaran {tag}: "), F.coalesce(F.col(f"{s}.grade"), F.lit("(tidak diketahui)")), F.lit(f"\nDeskripsi {tag}: "), F.coalesce(F.nullif(strip(f"{s}.description"), F.lit("")), F.col(f"{s}.name")), F.lit("\n"), edges_text(f"{s}.out_edges"))
    return F.concat(side(a, "A"), F.lit("\n"), side(b, "B"))


def shared_targets(a: Column, b: Column) -> Column:
    """Targets both out-edge lists have, sorted."""
    names = lambda e: F.transform(e, lambda x: x["target"])
    return F.array_sort(F.array_intersect(names(a), names(b)))


def enrich(pairs: DataFrame, contexts: DataFrame) -> DataFrame:
    """Pairs (source, target) with the node data of both ends as structs a and b, their shared targets and the cache key."""
    side = lambda key, name: contexts.select(F.col("id").alias(key), F.struct("name", "grade", "description", "out_edges").alias(name))
    both = pairs.join(side("source", "a"), "source", "left").join(side("target", "b"), "target", "left")
    shared = both.withColumn("shared", shared_targets(F.col("a.out_edges"), F.col("b.out_edges")))
    ctx = fingerprint("a.out_edges", "b.out_edges", "shared")
    return shared.withColumn("context", ctx).withColumn("key", cache_key(pair_text("a.name", "b.name", F.concat(F.lit("ctx:"), ctx)), F.lit("model"), F.lit("v1"), sep="||"))


def valid_answer(answer: Column, types: tuple[str, ...]) -> Column:
    """Struct (rel_type, confidence, description) of an answer: type from the vocabulary else none, confidence in [0, 1] else 0.5."""
    parsed = F.from_json(unfenced(answer), "rel_type string, confidence double, description string")
    known = F.when(parsed["rel_type"].isin(*types), parsed["rel_type"]).otherwise(vocab.NO_TYPE)
    conf = F.when(parsed["confidence"].between(0, 1), parsed["confidence"]).otherwise(0.5)
    return F.struct(known.alias("rel_type"), F.when(known == vocab.NO_TYPE, 0.0).otherwise(conf).alias("confidence"), F.coalesce(parsed["description"], F.lit("")).alias("description"))


def aligned(got: list, n: int) -> list[str | None]:
    """L4: one answer per question, by index where the answers say it, else in order; None where there is none."""
    if got and all(isinstance(x, tuple) for x in got):
        by = dict(got)
        return [by.get(i) for i in range(n)]
    return (list(got) + [None] * n)[:n]


def classify(pairs: DataFrame, cache: DataFrame, client: Callable[[list[str]], list[str | None]], types: tuple[str, ...] = vocab.CROSS_TYPES, batch: int = 10) -> tuple[DataFrame, DataFrame]:
    """(classified pairs, new cache entries).

    pairs: source, target, key, prompt. cache: key, answer. The client gets up to
    ``batch`` prompts and returns their answers in order, or (index, answer) pairs in
    any order. What it leaves out or fails on becomes none with confidence 0 and is
    not cached.
    """
    hits = pairs.join(cache.select("key", "answer"), "key")
    misses = pairs.join(cache.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers: list[str | None] = []
            for i in range(0, len(b), batch):
                asked = list(b["prompt"].iloc[i : i + batch])
                try:
                    got = list(client(asked))
                except Exception:  # a failed batch is none, and stays out of the cache
                    got = []
                answers += aligned(got, len(asked))
            yield pd.DataFrame({"key": b["key"], "answer": pd.Series(answers, dtype=object)})

    fresh = misses.groupBy("key").agg(F.min("prompt").alias("prompt")).mapInPandas(run, "key string, answer string")
    every = hits.select("source", "target", "key", "answer").unionByName(misses.join(fresh, "key", "left").select("source", "target", "key", "answer"))
    out = every.select("source", "target", "key", valid_answer(F.coalesce("answer", F.lit("{}")), types).alias("v")).select("source", "target", "key", "v.*")
    return out, fresh.where(F.col("answer").isNotNull())


def judge(rows: DataFrame, done: DataFrame, client: Callable[[list[str]], list[str]], most: int | None = None) -> DataFrame:
    """Rows with reasoning and label; from the checkpoint where it has the key, else from the client within the budget.

    rows: key, ordinal, prompt. done: key, reasoning, final_consensus_label. Rows
    beyond the budget and blank answers are 'unknown'.
    """
    old = rows.join(done.select("key", "reasoning", F.col("final_consensus_label").alias("label")), "key")
    new = rows.join(done.select("key"), "key", "left_anti")
    asked = new if most is None else new.where(F.col("ordinal") < most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"key": b["key"], "answer": client(list(b["prompt"]))})

    parsed = F.from_json(unfenced(F.col("answer")), "reasoning string, final_consensus_label string")
    told = asked.select("key", "prompt").distinct().mapInPandas(run, "key string, answer string").select("key", parsed["reasoning"].alias("reasoning"), rating_label(parsed["final_consensus_label"]).alias("label"))
    fresh = new.join(told, "key", "left").withColumn("label", F.coalesce("label", F.lit("unknown")))
    return old.unionByName(fresh.select(*old.columns))


def extract(chapters: DataFrame, client: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """L1: grade, chapter, subject, relation, target, description from the client's JSON lists; failed chapters have no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for grade, chapter, answer in zip(b["grade"], b["chapter"], client(list(b["text"])) if len(b) else []):
                try:
                    found = json.loads(answer or "[]")
                except ValueError:
                    continue
                rows += [(grade, chapter, *(str(t.get(k) or "").strip() for k in ("subject", "relation", "target", "description"))) for t in found if isinstance(t, dict)]
            yield pd.DataFrame([r for r in rows if r[3] and r[4]], columns=["grade", "chapter", "subject", "relation", "target", "description"])

    return chapters.select("grade", "chapter", "text").mapInPandas(run, "grade string, chapter string, subject string, relation string, target string, description string")


def retrieve(rows: DataFrame, chunks: DataFrame, terms_from: list[str], least: int = 1, most: int = 3, budget: int = 6000) -> DataFrame:
    """Key and context - the best chunks of the row's own book within a budget of characters.

    rows: key, book, chapter and the fields of ``terms_from``. chunks: book, ord,
    chapter, page, text; ord is a number. The stated rows meet the chunks of their
    book in blocks of at most about RETRIEVAL_BLOCK on either side; each block keeps its best chunks of a
    row, the blocks' best are merged. The score counts terms that occur anywhere in
    the chunk; the first chunk that does not fit is cut if more than 200 characters
    are left, and ends the context.
    """
    blocks = lambda df, n: df.groupBy("book").agg(F.ceil(F.count(F.lit(1)) / F.lit(RETRIEVAL_BLOCK)).cast("int").alias(n))
    sizes = blocks(rows, "_nq").join(blocks(chunks, "_nc"), "book")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda c, n: F.pmod(F.xxhash64(c), F.col(n).cast("long")).cast("int")
    asked = rows.select("key", "book", "chapter", context_terms(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in terms_from])).alias("terms"))
    asked = asked.join(sizes, "book").select("book", mine("key", "_nq").alias("qb"), every("_nc").alias("cb"), "key", F.lower(F.trim(F.coalesce("chapter", F.lit("")))).alias("chapter"), "terms")
    held = chunks.join(sizes, "book").select("book", every("_nq").alias("qb"), mine("ord", "_nc").alias("cb"), "ord", F.lower(F.trim(F.coalesce("chapter", F.lit("")))).alias("chapter"), F.lower(F.concat_ws(" ", F.coalesce("chapter", F.lit("")), F.coalesce("text", F.lit("")))).alias("body"))

    def rank(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values("ord", kind="stable")
        bodies, chapters, ords = c["body"].to_numpy(), c["chapter"].to_numpy(), c["ord"].to_numpy()
        where: dict[str, np.ndarray] = {}
        keys, found, scores = [], [], []
        for key, chapter, terms in zip(q["key"], q["chapter"], q["terms"]):
            score = np.zeros(len(c), np.int64)
            for t in terms:
                if t not in where:
                    where[t] = np.fromiter((t in x for x in bodies), np.int64, len(bodies))
                score += where[t]
            if chapter:
                score += 3 * (chapters == chapter)
            top = np.argsort(-score, kind="stable")[:most]
            top = top[score[top] >= least]
            keys += [key] * len(top)
            found.append(ords[top])
            scores.append(score[top])
        return pd.DataFrame({"key": pd.Series(keys, dtype=q["key"].dtype), "ord": np.concatenate([*found, np.empty(0, np.int64)]), "score": np.concatenate([*scores, np.empty(0, np.int64)])})

    kinds = {c: df.schema[c].dataType.simpleString() for c, df in (("key", rows), ("ord", chunks))}
    by = ["book", "qb", "cb"]
    ranked = asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(rank, f"key {kinds['key']}, ord {kinds['ord']}, score int")
    of_book = rows.select("key", "book").join(ranked, "key")
    scored = of_book.join(chunks.select("book", "ord", F.col("chapter").alias("c_chapter"), "page", "text"), ["book", "ord"])
    best = Window.partitionBy("key").orderBy(F.desc("score"), "ord")
    top = scored.withColumn("n", F.row_number().over(best)).where(F.col("n") <= most)
    text = F.format_string("[%s, p.%s, score=%s] %s", F.coalesce("c_chapter", F.lit("")), F.coalesce("page", F.lit("?")), F.col("score").cast("string"), "text")
    run = Window.partitionBy("key").orderBy("n")
    sized = top.withColumn("snippet", text).withColumn("upto", F.sum(F.length("snippet")).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    sized = sized.withColumn("over", (F.col("upto") > budget).cast("int")).withColumn("n_over", F.sum("over").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.lit(budget) - (F.col("upto") - F.length("snippet"))
    cut = F.when(F.col("n_over") == 0, F.col("snippet")).when((F.col("n_over") == 1) & (F.col("over") == 1) & (left > 200), F.concat(F.rtrim(F.substring(F.col("snippet"), F.lit(1), left.cast("int"))), F.lit("...")))
    kept = sized.withColumn("cut", cut).where(F.col("cut").isNotNull())
    joined = kept.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "cut"))).alias("l"))  # at most ``most`` elements
    return rows.select("key").join(joined, "key", "left").select("key", F.coalesce(F.array_join(F.transform("l", lambda x: x["cut"]), "\n\n"), F.lit("")).alias("context"))
