"""The k most similar vectors of every vector: a random-projection forest.

A forest of binary trees is fitted on a bounded sample. Each node splits by the
plane between two randomly chosen points of its sample, moved apart by two-means. Every vector is
put into one leaf of each tree. To search, all trees share one priority queue:
the node whose worst margin is best is opened next, whichever tree it is in,
until the opened leaves hold ``search_k`` vectors (by default 20 log2(n)^2 of n, at
least 5,000, as a fixed number finds less in larger collections). The candidates in the opened
leaves are then ranked by their exact cosine.

Only rows (leaf, vector) are shuffled. A leaf is processed as one block of
vectors against the queries that opened it; leaves of more than ``block`` vectors
(dense regions) are cut into blocks, each of which gets those queries, so no task
holds an unbounded leaf and no candidate is lost. Equal vectors are collapsed to
one representative before the search and expanded after it.

Bounds: the fit reads a sample that grows with the collection, so that leaves keep
their size, up to ``sample_bytes`` of vectors; the forest, which is broadcast, has at
most trees / MIN_LEAF_SAMPLE times that. Beyond the bound (256 MB are a million
vectors of 64 numbers, enough for 75 million) leaves grow instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rajut.operators.skew import lookup
from rajut.session import cut

MIN_LEAF_SAMPLE = 4
BATCH = 512


@dataclass
class Forest:
    """Complete description of all trees: node i splits by planes[i] . x + offset[i]; child < 0 is leaf ~child."""

    planes: np.ndarray  # [nodes, dim] float32
    offsets: np.ndarray  # [nodes] float32
    left: np.ndarray  # [nodes] int32
    right: np.ndarray  # [nodes] int32
    roots: np.ndarray  # [trees] int32, a node or ~leaf
    n_leaves: int


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow for very large or small values."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _split(rng: np.random.Generator, sample: np.ndarray, rows: np.ndarray, tries: int = 3, even: float = 0.1, rounds: int = 6, most: int = 256) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(sides, plane, offset) between two random points, drawn apart by a few rounds of two-means on the sphere.

    Such planes pass between groups of similar vectors rather than through them.
    None if all tries leave one side empty.
    """
    spare = None
    for _ in range(tries):
        x = sample[rng.choice(rows, min(most, len(rows)), replace=False)]
        a, b = x[0], x[1]
        for _ in range(rounds):
            side = x @ (a - b) > 0
            if side.all() or not side.any():
                break
            a, b = x[side].mean(0), x[~side].mean(0)
            a, b = a / max(np.linalg.norm(a), 1e-12), b / max(np.linalg.norm(b), 1e-12)
        norm = np.linalg.norm(a - b)
        if norm == 0:
            continue
        plane = (a - b) / norm
        sides = sample[rows] @ plane > 0
        share = min(sides.mean(), 1 - sides.mean())
        if share >= even:
            return sides, plane, 0.0
        if share > 0:
            spare = sides, plane, 0.0
    return spare


def fit_forest(sample: np.ndarray, total: int, trees: int, leaf_size: int, seed: int = 7) -> Forest:
    """Fit on unit vectors ``sample``; leaves are meant to hold about leaf_size of ``total`` vectors."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1] if sample.size else 1
    planes, offsets, left, right, roots = [], [], [], [], []
    leaves = 0
    stop = max(MIN_LEAF_SAMPLE, leaf_size * len(sample) / max(1, total))
    for _ in range(trees):
        roots.append(None)
        todo = [(np.arange(len(sample)), None, False)]
        while todo:
            rows, parent, is_right = todo.pop()
            sides = _split(rng, sample, rows) if len(rows) > stop else None
            if sides is None:
                me = ~leaves
                leaves += 1
            else:
                me = len(planes)
                sides, plane, offset = sides
                planes.append(plane)
                offsets.append(offset)
                left.append(0)
                right.append(0)
                todo.append((rows[~sides], me, False))
                todo.append((rows[sides], me, True))
            if parent is None:
                roots[-1] = me
            elif is_right:
                right[parent] = me
            else:
                left[parent] = me
    return Forest(np.array(planes, np.float32).reshape(-1, dim), np.array(offsets, np.float32), np.array(left, np.int32), np.array(right, np.int32), np.array(roots, np.int32), leaves)


def assign(f: Forest, x: np.ndarray) -> np.ndarray:
    """The leaf of each vector in each tree: int32 [n, trees]."""
    out = np.empty((len(x), len(f.roots)), np.int32)
    for t, root in enumerate(f.roots):
        at = np.full(len(x), root, np.int32)
        live = np.flatnonzero(at >= 0)
        while len(live):
            node = at[live]
            side = np.einsum("ij,ij->i", x[live], f.planes[node]) + f.offsets[node] > 0
            at[live] = np.where(side, f.right[node], f.left[node])
            live = live[at[live] >= 0]
        out[:, t] = ~at
    return out


def search_leaves(f: Forest, sizes: np.ndarray, x: np.ndarray, search_k: int) -> tuple[np.ndarray, np.ndarray]:
    """The leaves that each vector opens, best first through one queue: (row, leaf) pairs."""
    n, trees = len(x), len(f.roots)
    width = 64
    score = np.full((n, width), -np.inf, np.float32)
    node = np.zeros((n, width), np.int32)
    score[:, :trees] = np.inf
    node[:, :trees] = f.roots
    used = np.full(n, trees)
    got = np.zeros(n, np.int64)
    live = np.arange(n)
    rows, leaves = [], []
    while len(live):
        best = score[live].argmax(1)
        worth = score[live, best]
        live, best, worth = live[worth > -np.inf], best[worth > -np.inf], worth[worth > -np.inf]
        at = node[live, best]
        is_leaf = at < 0
        hit, leaf = live[is_leaf], ~at[is_leaf]
        rows.append(hit)
        leaves.append(leaf)
        got[hit] += sizes[leaf]
        score[hit, best[is_leaf]] = -np.inf
        go, where, split = live[~is_leaf], best[~is_leaf], at[~is_leaf]
        # only the planes of opened nodes are looked at
        m, d = np.einsum("ij,ij->i", x[go], f.planes[split]) + f.offsets[split], worth[~is_leaf]
        if len(go) and used[go].max() >= width:
            score = np.concatenate([score, np.full_like(score, -np.inf)], 1)
            node = np.concatenate([node, np.zeros_like(node)], 1)
            width *= 2
        score[go, where], node[go, where] = np.minimum(d, m), f.right[split]
        score[go, used[go]], node[go, used[go]] = np.minimum(d, -m), f.left[split]
        used[go] += 1
        live = live[got[live] < search_k]
    return np.concatenate(rows) if rows else np.empty(0, int), np.concatenate(leaves) if leaves else np.empty(0, int)


def _pack(x: np.ndarray) -> pa.Array:
    """Rows of numbers as a binary column, without a Python object a row."""
    x = np.ascontiguousarray(x, np.float32)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def _stack(column: pa.Array | pd.Series) -> np.ndarray:
    if isinstance(column, pd.Series):
        return np.frombuffer(b"".join(column), np.float32).reshape(len(column), -1)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.float32).reshape(len(column), -1)


def _nearest(q_ids: np.ndarray, q: np.ndarray, block_ids: np.ndarray, block: np.ndarray, k: int, least: float) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(q), BATCH):
        sim = q[a : a + BATCH] @ block.T
        sim[q_ids[a : a + BATCH, None] == block_ids[None, :]] = -2.0
        r, c = np.nonzero(sim >= least - 1e-5)
        if len(r) > 4 * k * len(sim):  # many are near enough: the best k of each row first
            take = min(k, sim.shape[1])
            top = np.argpartition(-sim, take - 1, axis=1)[:, :take]
            r, c = np.nonzero(np.take_along_axis(sim, top, 1) >= least - 1e-5)
            c = top[r, c]
        elif len(r):
            order = np.lexsort((-sim[r, c], r))
            r, c = r[order], c[order]
            first = np.searchsorted(r, r, "left")
            keep = np.arange(len(r)) - first < k
            r, c = r[keep], c[keep]
        exact = np.einsum("ij,ij->i", q[a : a + BATCH][r].astype(np.float64), block[c].astype(np.float64))
        keep = (exact >= least) & (q_ids[a : a + BATCH][r] != block_ids[c])
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[a : a + BATCH][r][keep]), pa.array(block_ids[c][keep]), pa.array(np.minimum(exact[keep], 1.0))], names=["id", "other", "sim"])


def _rank_blocks(batches: Iterator[pa.RecordBatch], k: int, least: float) -> Iterator[pa.RecordBatch]:
    """Sorted by (leaf, part, kind): first the vectors of a block (kind 0, or 1 if they ask it too), then queries from elsewhere (kind 2)."""
    key, held, block = None, [], None

    def complete() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, vecs, asks = (np.concatenate(x) for x in zip(*held))
        return ids, vecs, asks

    for batch in batches:
        if not batch.num_rows:
            continue
        leaf, part, kinds, ids = (batch[c].to_numpy(zero_copy_only=False) for c in ("leaf", "part", "kind", "id"))
        vecs = _stack(batch["vec"])
        where = leaf.astype(np.int64) * (1 << 24) + part
        for rows in np.split(np.arange(len(where)), np.flatnonzero(np.diff(where)) + 1):
            if where[rows[0]] != key:
                if held and block is None:
                    i, v, asks = complete()
                    yield from _nearest(i[asks], v[asks], i, v, k, least)
                key, held, block = where[rows[0]], [], None
            kind = kinds[rows]
            own, away = rows[kind < 2], rows[kind == 2]
            if len(own):
                held.append((ids[own], vecs[own], kinds[own] == 1))
            if not len(away) or not held:
                continue
            if block is None:
                block = complete()
                yield from _nearest(block[0][block[2]], block[1][block[2]], block[0], block[1], k, least)
            yield from _nearest(ids[away], vecs[away], block[0], block[1], k, least)
    if held and block is None:
        i, v, asks = complete()
        yield from _nearest(i[asks], v[asks], i, v, k, least)


def neighbours(vectors: DataFrame, k: int = 5, least: float = -1.0, trees: int = 10, leaf_size: int = 600, search_k: int | None = None, sample_rows: int = 40_000, sample_bytes: int = 1 << 28, block: int = 4096, seed: int = 7) -> DataFrame:
    """id, other, sim, rank: up to ``k`` most similar others of every id with cosine >= least.

    ``vectors`` has id (long) and vec (array<double> of one length, usable:
    finite and not all zero). An id given twice counts once, with one of its vectors
    if they differ. Vectors of equal
    direction are each other's nearest with similarity 1; ties rank by the smaller id. An empty
    table gives an empty result.
    """
    spark = vectors.sparkSession

    def packed(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "vec": [r.tobytes() for r in unit(np.stack(b["vec"].to_numpy())).astype(np.float32)]})

    # unit vectors in single precision; from here on equal vectors are those of equal direction, told by 128 bits
    hashes = [F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(seed), "vec").alias("h2")]
    base = cut(vectors.select(F.col("id").cast("long").alias("id"), "vec").mapInPandas(packed, "id long, vec binary").select("id", *hashes, "vec"))
    ids = base.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("id", "h.*")
    groups = cut(ids.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    # the vector of each representative: the only shuffle of all vectors before the search
    reps = cut(base.join(groups.select("h1", "h2", F.col("rep").alias("id")), ["id", "h1", "h2"]).groupBy("id").agg(F.first("vec").alias("vec")).select(F.col("id").alias("rep"), "vec"))
    total = reps.count()
    schema = "id long, other long, sim double, rank int"
    if total == 0:
        return spark.createDataFrame([], schema)
    search_k = search_k or max(5_000, int(20 * np.log2(total) ** 2))
    # a fixed number of rows, or enough for leaves of leaf_size; the same ones whatever the partitioning
    width = max(1, len(reps.first()["vec"]))
    wanted = min(max(sample_rows, 2 * MIN_LEAF_SAMPLE * total // leaf_size), max(sample_rows, sample_bytes // width))
    parts_of = 1 << 30
    drawn = F.pmod(F.xxhash64(F.lit(seed), "rep"), F.lit(parts_of)) < int(parts_of * min(1.0, wanted / total))
    rows = reps.where(drawn).select(F.col("rep").alias("id"), "vec").toPandas().sort_values("id")["vec"]
    forest = fit_forest(_stack(rows).astype(np.float64) if len(rows) else np.empty((0, 1)), total, trees, leaf_size, seed)
    shared = spark.sparkContext.broadcast(forest)

    def held(batches):
        for b in batches:
            if len(b):
                leaf, n = np.unique(assign(shared.value, _stack(b["vec"])), return_counts=True)
                yield pd.DataFrame({"leaf": leaf, "n": n.astype(np.int64)})

    counted = reps.select("vec").mapInPandas(held, "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toPandas()
    sizes = np.zeros(max(1, forest.n_leaves), np.int64)
    sizes[counted["leaf"]] = counted["n"]
    parts = np.maximum(1, -(-sizes // block))
    known = spark.sparkContext.broadcast((sizes, parts))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector once per tree in its own leaf (kind 0, or 1 if it also asks there), and as a query in the other leaves it opens (kind 2)."""
        sizes, parts = known.value
        for b in batches:
            if not b.num_rows:
                continue
            every, vecs = b["id"].to_numpy(zero_copy_only=False), _stack(b["vec"])
            for a in range(0, len(every), BATCH):
                ids, x = every[a : a + BATCH], vecs[a : a + BATCH]
                own = assign(shared.value, x)
                t = own.shape[1]
                own_row, own_leaf = np.repeat(np.arange(len(x)), t), own.ravel().astype(np.int64)
                own_part = (ids.astype(np.uint64)[own_row] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[own_leaf]
                row, leaf = search_leaves(shared.value, sizes, x, search_k)
                times = parts[leaf]
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, leaf = np.repeat(row, times), np.repeat(leaf, times).astype(np.int64)
                code = lambda r, f, p: (r * len(sizes) + f) * (parts.max() + 1) + p
                mine, asks = code(own_row, own_leaf, own_part), code(row, leaf, part)
                away = ~np.isin(asks, mine)
                rows = np.concatenate([own_row, row[away]])
                kind = np.concatenate([np.isin(mine, asks).astype(np.int8), np.full(away.sum(), 2, np.int8)])
                columns = [np.concatenate([own_leaf, leaf[away]]).astype(np.int32), np.concatenate([own_part, part[away]]).astype(np.int32), kind, ids[rows]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), _pack(x[rows])], names=["leaf", "part", "kind", "id", "vec"])

    rows_of = reps.select(F.col("rep").alias("id"), "vec").mapInArrow(spread, "leaf int, part int, kind byte, id long, vec binary")
    blocks = rows_of.repartition("leaf", "part").sortWithinPartitions("leaf", "part", "kind")
    found = blocks.mapInArrow(lambda it: _rank_blocks(it, k, least), "id long, other long, sim double")
    best = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    top = found.groupBy("id", "other").agg(F.max("sim").alias("sim")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    top = cut(top.select("id", "other", "sim", F.col("rank").cast("int").alias("rank")))
    several = groups.where(F.col("n") > 1)
    if several.isEmpty():
        return top
    members = cut(lookup(ids, several, ["h1", "h2"], "n").select("rep", "id", "n"))
    return _expand(members, top, k)


def _expand(members: DataFrame, top: DataFrame, k: int) -> DataFrame:
    """From representatives to all ids of equal vectors. members: rep, id, n of the groups of more than one.

    A neighbour that stands for a group brings the group's k + 1 smallest ids, which
    is all that can be among the k best of anybody.
    """
    first = cut(members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1).select(F.col("rep").alias("to"), F.col("id").alias("member")))
    many = first.select(F.col("to").alias("rep")).distinct()
    # rows whose two ends stand for themselves alone, of queries without such a neighbour, stay as they are
    touched = top.join(many.select(F.col("rep").alias("other")), "other", "left_semi").select("id").unionByName(many.select(F.col("rep").alias("id"))).distinct()
    plain = top.join(touched, "id", "left_anti")
    open_rows = top.join(touched, "id", "left_semi").select(F.col("id").alias("rep"), F.col("other").alias("to"), "sim")
    outer = open_rows.join(first, "to", "left").select("rep", F.coalesce("member", "to").alias("other"), "sim")
    inner = first.select(F.col("to").alias("rep"), F.col("member").alias("other"), F.lit(1.0).alias("sim"))
    best = Window.partitionBy("rep").orderBy(F.desc("sim"), "other")
    near = cut(outer.unionByName(inner).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r"))
    lists = near.groupBy("rep").agg(F.collect_list(F.struct("other", "sim")).alias("near"))  # at most k + 1 elements
    sized = lists.join(members.groupBy("rep").agg(F.max("n").alias("n")), "rep", "left")
    own = sized.where(F.col("n").isNull()).select(F.col("rep").alias("id"), "near")
    shared = lookup(members.select("rep", "id"), sized.where(F.col("n").isNotNull()), ["rep"], "n").select("id", "near")
    flat = own.unionByName(shared).select("id", F.explode("near").alias("e")).select("id", "e.other", "e.sim").where(F.col("other") != F.col("id"))
    ranked = flat.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "other")))
    return plain.unionByName(ranked.where(F.col("rank") <= k).select("id", "other", "sim", F.col("rank").cast("int").alias("rank")))


def usable(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """id and vec of the rows whose vector has ``dim`` finite elements that are not all zero."""
    v = F.col(f"`{vec_col}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0))
