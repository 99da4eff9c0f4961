"""Vector search with an index or exactly over a stated query set, and candidate pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rajut.functions import vocab
from rajut.session import cut

#: Vectors that one block of the searched side holds.
BLOCK = 4096
#: Vectors a cell of the index is meant to hold, most cells, and vectors per cell that the centres are fitted on.
CELL_ROWS, MOST_CELLS, PER_CELL = 1000, 4096, 40


def cosine(a: Column | str, b: Column | str) -> Column:
    """V1: cosine of two arrays in double precision, inside the JVM."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def normalized(cos: Column) -> Column:
    """The index score of a cosine: (1 + cos) / 2."""
    return (1 + cos) / 2


def block_knn(queries: DataFrame, rows: DataFrame, k: int, round_to: int = 6) -> DataFrame:
    """V2: q, id, sim, rank: the k rows nearest to each query, itself included; ties by id.

    Exact. ``rows`` are cut into blocks; each block meets the queries as they stream
    by, keeps k per query and block, and the blocks' winners are merged. Sides: id
    (long), vec (array). The number of blocks follows the number of rows; queries
    are replicated once per block, so a query set should be stated, not everything.
    """
    n_blocks = max(1, -(-rows.count() // BLOCK))
    a = _side(rows, 0, F.pmod(F.xxhash64("id"), F.lit(n_blocks).cast("long")))
    b = _side(queries, 1, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    return _ranked(a.unionByName(b), k, round_to)


def _side(df: DataFrame, kind: int, block: Column) -> DataFrame:
    return df.select(block.alias("block"), F.lit(kind).cast("byte").alias("kind"), F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _ranked(given: DataFrame, k: int, round_to: int) -> DataFrame:
    """q, id, sim, rank of blocks: vectors of kind 0 searched by those of kind 1."""
    blocks = given.repartition("block").sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, vecs, matrix = None, [], [], None
        for batch in batches:
            for key, part in batch.groupby("block", sort=True):
                if key != at:
                    at, ids, vecs, matrix = key, [], [], None
                own, asked = part[part["kind"] == 0], part[part["kind"] == 1]
                if len(own):
                    ids.append(own["id"].to_numpy())
                    vecs.append(_unit(np.stack(own["vec"].to_numpy())))
                if not len(asked) or not ids:
                    continue
                if matrix is None:
                    matrix, names = np.concatenate(vecs), np.concatenate(ids)
                for start in range(0, len(asked), 512):
                    q = asked.iloc[start : start + 512]
                    sims = np.round(_unit(np.stack(q["vec"].to_numpy())) @ matrix.T, round_to)
                    order = np.lexsort((np.broadcast_to(names, sims.shape), -sims), axis=1)[:, :k]
                    yield pd.DataFrame({"q": np.repeat(q["id"].to_numpy(), order.shape[1]), "id": names[order].ravel(), "sim": np.take_along_axis(sims, order, 1).ravel()})

    best = Window.partitionBy("q").orderBy(F.desc("sim"), "id")
    return blocks.mapInPandas(run, "q long, id long, sim double").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _centres(sample: np.ndarray, n: int, rounds: int = 10) -> np.ndarray:
    """n centres of unit vectors by k-means on the sphere; empty cells keep their centre."""
    centres = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        cell = np.concatenate([(sample[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, cell, sample)
        full = np.linalg.norm(total, axis=1) > 0
        centres[full] = _unit(total[full])
    return centres


def indexed_knn(queries: DataFrame, rows: DataFrame, k: int, search: int = 5_000, cell_rows: int = CELL_ROWS, round_to: int = 6) -> DataFrame:
    """Q, id, sim, rank: the k rows nearest to each query by an inverted-file index; the query itself included, ties by id.

    Centres are fitted on a sample of at most PER_CELL vectors for each of at most
    MOST_CELLS cells (a bound on what comes to the driver and is broadcast). Every row
    is in the cell of its nearest centre. A query opens cells, nearest centre first,
    until they hold ``search`` rows, and ranks those exactly; so a collection of up to
    ``search`` rows is searched whole, and the cost of a larger one is proportional to
    it. Cells of more than BLOCK rows are searched in blocks. Of rows with equal
    vectors only the k smallest ids can be among the k nearest of anybody, and only
    those are indexed.
    """
    v = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    if rows.count() <= search:
        return block_knn(queries, rows, k, round_to)
    same = Window.partitionBy("_h1", "_h2").orderBy("id")
    hashed = v(rows).withColumn("_h1", F.xxhash64("vec")).withColumn("_h2", F.xxhash64(F.lit(1), "vec"))
    kept = cut(hashed.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k).select("id", "vec"))
    total = kept.count()
    n_cells = max(1, min(MOST_CELLS, -(-total // cell_rows)))
    if total <= search or n_cells == 1:
        return block_knn(queries, kept, k, round_to)
    drawn = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, n_cells * PER_CELL / total))
    sample = kept.where(drawn).toPandas().sort_values("id")
    spark = rows.sparkSession
    centres = spark.sparkContext.broadcast(_centres(_unit(np.stack(sample["vec"].to_numpy())), n_cells))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "vec": b["vec"], "cell": (_unit(np.stack(b["vec"].to_numpy())) @ centres.value.T).argmax(1)})

    placed = cut(kept.mapInPandas(place, "id long, vec array<double>, cell long"))
    sizes = np.zeros(len(centres.value), np.int64)
    for r in placed.groupBy("cell").count().collect():  # at most MOST_CELLS rows
        sizes[r["cell"]] = r["count"]
    parts = np.maximum(1, -(-sizes // BLOCK))
    first = np.cumsum(parts) - parts
    known = spark.sparkContext.broadcast((sizes, parts, first))

    def open_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes, parts, first = known.value
        for b in batches:
            for i in range(0, len(b), 1024):
                some = b.iloc[i : i + 1024]
                order = np.argsort(-(_unit(np.stack(some["vec"].to_numpy())) @ centres.value.T), axis=1, kind="stable")
                held = sizes[order].cumsum(1)
                row, at = np.nonzero((held - sizes[order] < search) & (sizes[order] > 0))
                cell = order[row, at]
                times = parts[cell]
                block = np.repeat(first[cell], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                who = np.repeat(row, times)
                yield pd.DataFrame({"block": block, "id": some["id"].to_numpy()[who], "vec": some["vec"].to_numpy()[who]})

    base = F.get(F.lit(first.tolist()), F.col("cell").cast("int")) + F.pmod(F.xxhash64("id"), F.get(F.lit(parts.tolist()), F.col("cell").cast("int")))
    asked = v(queries).mapInPandas(open_cells, "block long, id long, vec array<double>")
    return _ranked(_side(placed, 0, base).unionByName(_side(asked, 1, F.col("block"))), k, round_to)


def candidate_pairs(ranked: DataFrame, groups: DataFrame, threshold: float, score_mode: str = "cosine", cross_group: bool = True, allowed: DataFrame | None = None) -> DataFrame:
    """V3: unordered pairs from ranked neighbours, in the order the rules apply.

    The threshold, then self, then the allow-list (targets only), then groups: all
    after the top k, so neighbours of the same group use up places. Of the two
    directions the one with the smaller query wins. groups: id, grp.
    """
    score = F.col("sim") if score_mode == "cosine" else normalized(F.col("sim"))
    kept = ranked.withColumn("score", score).where((F.col("score") >= threshold) & (F.col("q") != F.col("id")))
    if allowed is not None:
        kept = kept.join(allowed.select("id"), "id", "left_semi")
    a, b = groups.select(F.col("id").alias("q"), F.col("grp").alias("source_grade")), groups.select("id", F.col("grp").alias("target_grade"))
    known = kept.join(a, "q").join(b, "id")
    if cross_group:
        known = known.where(F.coalesce(F.col("source_grade").cast("string"), F.lit("")) != "").where(F.coalesce(F.col("target_grade").cast("string"), F.lit("")) != "").where(F.col("source_grade") != F.col("target_grade"))
    first = known.groupBy(F.least("q", "id").alias("_a"), F.greatest("q", "id").alias("_b")).agg(F.min_by(F.struct(F.col("q").alias("source"), F.col("id").alias("target"), F.col("score").alias("similarity"), "source_grade", "target_grade"), "q").alias("v"))
    return first.select("v.*")


def without_known(pairs: DataFrame, typed: DataFrame) -> DataFrame:
    """Pairs that no typed edge joins in either direction; SIMILAR_TO does not count. typed: source, target, rel_type."""
    done = typed.where(F.col("rel_type") != vocab.SIMILAR).select(F.least("source", "target").alias("_a"), F.greatest("source", "target").alias("_b")).distinct()
    return pairs.withColumn("_a", F.least("source", "target")).withColumn("_b", F.greatest("source", "target")).join(done, ["_a", "_b"], "left_anti").drop("_a", "_b")


def index_info(rows: DataFrame, wanted: int) -> DataFrame:
    """V4: dimension, model and size of an index, and whether it must be made anew for another dimension."""
    one = rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim"))
    return one.withColumn("stale", F.col("dim") != wanted)


def to_embed(nodes: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """V5: nodes without a vector of the current model."""
    return nodes.join(stored.where(F.col("model") == model).select("id"), "id", "left_anti")


def similar_edges(pairs: DataFrame) -> DataFrame:
    """V6: SIMILAR_TO edges with sorted ends."""
    return pairs.groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.max("similarity").alias("score")).withColumn("rel_type", F.lit(vocab.SIMILAR))


def validated(edges: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """V6: edges whose type is in the vocabulary; any other is an error when the row is read."""
    return edges.where(F.when(F.col("rel_type").isin(*types), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown relation type: "), F.coalesce("rel_type", F.lit("null"))))))


def embed(rows: DataFrame, cache: DataFrame, model: str, client) -> DataFrame:
    """V7: id, vec, hit - vectors from the cache (key, vec) or from ``client(list of texts) -> list of vectors``.

    The client sees each different missing text once, in Arrow batches.
    """
    keyed = rows.select("id", "text", F.sha2(F.concat(F.coalesce("text", F.lit("")), F.lit(model)), 256).alias("key"))
    hits = keyed.join(cache.select("key", "vec"), "key").select("id", "vec", F.lit(True).alias("hit"))
    misses = keyed.join(cache.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"key": b["key"], "vec": client(list(b["text"]))})

    fresh = misses.select("key", "text").distinct().mapInPandas(run, "key string, vec array<double>")
    return hits.unionByName(misses.join(fresh, "key").select("id", "vec", F.lit(False).alias("hit")))
