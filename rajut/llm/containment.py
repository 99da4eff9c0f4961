"""Evaluation passages inside training documents: size-partitioned MinHash containment search.

Sets are of shingles of SHINGLE words (a repeated shingle is several elements). Items are short sets; they are cut to parts of
at most SIZES[-1] shingles, and parts are partitioned by size. A document is a far
larger set than an item, so it is searched piece by piece: a *stretch* is a run of
words that all occur in items, and stretches are cut to pieces of PIECE shingles.
Both kinds of cuts overlap by ``width`` - 1 words, so a run of ``width`` words lies
whole in a piece and whole in a part.

A case is an item of which a document holds ``width`` consecutive words, that is at
least ``width`` - SHINGLE + 1 shingles in common. In a partition of parts of at most u
shingles this containment means a Jaccard similarity of at least
common / (u + PIECE - common), and the partition has as many MinHash bands as it
takes to miss a pair of that similarity with a chance of at most MISS. Pairs that
agree in a band are candidates. Candidates are verified exactly: the common shingles
are counted, and pairs with enough of them are read for the run of ``width`` words.

What is broadcast is the items' index. Items come in blocks of ``item_block``, each
searched in its own pass over the documents, so a broadcast is of bounded size. Texts
of documents are never shuffled.

Defined results: null or blank texts and items of fewer than ``width`` words match
nothing; a document given twice counts once; equal texts under several ids all match;
no items or no documents give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rajut.llm.notebook import cells

WORD = re.compile(r"[^\W_]+")
SHINGLE = 5
#: Bounds of the size partitions of item parts and size of a document's pieces, in multiples of the shingles of a run.
SIZES, PIECE = (2, 4, 8), 3.5
MISS = 1e-6
#: Characters of documents and pieces of text that are handled at a time.
CHARS, PIECES = 1 << 20, 1024


def words(text: str) -> list[str]:
    """Runs of Unicode letters and digits, lower-cased."""
    return WORD.findall(text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive words."""
    base = _mix(ids.astype(np.uint64) + np.uint64(1))
    n = len(ids) - size + 1
    out = np.zeros(max(0, n), np.uint64)
    for j in range(size if n > 0 else 0):
        out = out * np.uint64(0x100000001B3) + base[j : j + n]
    return _mix(out)


def _numbered(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sets laid end to end, a shingle's second and later occurrences in one of them as elements of their own, and each one's set."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate([np.empty(0, np.uint64), *sets])
    order = np.lexsort((flat, owner))
    fresh = np.ones(len(flat), bool)
    fresh[1:] = (np.diff(flat[order]) != 0) | (np.diff(owner[order]) != 0)
    first = np.flatnonzero(fresh)
    again = np.arange(len(flat)) - np.repeat(first, np.diff([*first, len(flat)]))
    out = flat.copy()
    out[order] ^= np.where(again > 0, _mix(again.astype(np.uint64)), np.uint64(0))
    return out, owner


def cuts(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Starts and ends of pieces of at most ``size`` of n words, each sharing ``overlap`` words with the one before."""
    step = size - overlap
    return [(a, min(n, a + size)) for a in range(0, max(1, n - overlap), step)]


def signatures(shingles: np.ndarray, starts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """MinHashes [len(factors), pieces] of pieces laid end to end in ``shingles``."""
    return np.minimum.reduceat(_mix(shingles)[None, :] * factors[:, None] ^ (shingles >> np.uint64(32))[None, :], starts, axis=1)


class Index:
    """The items' parts: their shingles, and the keys of their bands by size partition."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        self.width, self.common = width, width - SHINGLE + 1
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        self.parts: list[tuple[int, int, np.ndarray]] = []  # item number, first word, word ids
        bounds = [self.common * x for x in SIZES]
        self.piece = int(self.common * PIECE)
        for item, text in items:
            found = words(text or "")
            if len(found) < width:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found])
            self.parts += [(len(self.items), a, ids[a:b]) for a, b in cuts(len(ids), bounds[-1] + SHINGLE - 1, width - 1)]
            self.items.append((item, _grams(ids, SHINGLE)))
        flat, holder = _numbered([_grams(ids, SHINGLE) for _, _, ids in self.parts])
        sizes = np.bincount(holder, minlength=len(self.parts))
        jaccard = [self.common / (u + self.piece - self.common) for u in bounds]
        self.bands = [int(np.ceil(np.log(MISS) / np.log1p(-j))) if j < 1 else 1 for j in jaccard]
        self.factors = _mix(np.arange(1, max(self.bands) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        self.tables = []
        for low, u, b in zip([0, *bounds], bounds, self.bands):
            mine = np.flatnonzero((sizes > low) & (sizes <= u))
            if len(mine):
                keys = self._keys(signatures(flat[np.isin(holder, mine)], np.cumsum(sizes[mine]) - sizes[mine], self.factors[:b]))
                part = np.broadcast_to(mine, keys.shape).ravel()
                order = np.argsort(keys, axis=None, kind="stable")
                self.tables.append((b, keys.ravel()[order], part[order]))
        order = np.argsort(flat, kind="stable")
        self.shingles, self.holders = flat[order], holder[order]

    @staticmethod
    def _keys(signature: np.ndarray) -> np.ndarray:
        """Band and MinHash as one number."""
        return _mix(signature + np.arange(len(signature), dtype=np.uint64)[:, None] * np.uint64(0xC2B2AE3D27D4EB4F))

    @staticmethod
    def _lookup(table: np.ndarray, values: np.ndarray, asked: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(wanted, asked) for every place of the sorted table that holds a value."""
        low = np.searchsorted(table, asked, "left")
        times = np.searchsorted(table, asked, "right") - low
        hit = np.flatnonzero(times)
        low, times = low[hit], times[hit]
        at = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
        return values[at], np.repeat(wanted[hit], times)

    def search(self, docs: list[list[str]]) -> list[dict[int, tuple[set[int], set[int]]]]:
        """For each document, given as its cells: item number -> (starts of its passages, positions of its shingles) found in one of the cells."""
        hits: list[dict[int, tuple[set[int], set[int]]]] = [{} for _ in docs]
        flat: list[str] = []
        ends = []
        for doc in docs:
            for cell in doc:
                flat += words(cell)
                flat.append("")
            ends.append(len(flat))
        if not self.items or not flat:
            return hits
        ids = np.fromiter(map(self.vocabulary.get, flat, repeat(0)), np.int64, len(flat))
        gaps = np.flatnonzero(ids == 0)
        starts = np.concatenate([[0], gaps + 1])
        lengths = np.concatenate([gaps, [len(ids)]]) - starts
        long = lengths >= self.width
        spans = [(s + a, s + b) for s, n in zip(starts[long].tolist(), lengths[long].tolist()) for a, b in cuts(n, self.piece + SHINGLE - 1, self.width - 1)]
        owner = np.searchsorted(ends, [a for a, _ in spans], "right")
        for low in range(0, len(spans), PIECES):
            some = spans[low : low + PIECES]
            sets = [_grams(ids[a:b], SHINGLE) for a, b in some]
            for piece, part in self._candidates(sets):
                self._verify(ids[slice(*some[piece])], sets[piece], part, hits[owner[low + piece]])
        return hits

    def _candidates(self, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """(piece, part) that agree in a band and have enough shingles in common."""
        flat, owner = _numbered(sets)
        sizes = np.bincount(owner)
        signature = signatures(flat, np.cumsum(sizes) - sizes, self.factors)
        n = len(self.parts)
        agreed = []
        for b, keys, part in self.tables:
            asked = self._keys(signature[:b])
            where = np.broadcast_to(np.arange(len(sets)), asked.shape)
            found, piece = self._lookup(keys, part, asked.ravel(), where.ravel())
            agreed.append(np.unique(piece * n + found))
        agreed = np.concatenate([np.empty(0, np.int64), *agreed])
        if not len(agreed):
            return []
        # shingles in common, counted for all candidates at once
        asked = np.isin(owner, agreed // n)
        found, piece = self._lookup(self.shingles, self.holders, flat[asked], owner[asked])
        pair, count = np.unique(piece * n + found, return_counts=True)
        good = np.intersect1d(agreed, pair[count >= self.common], assume_unique=True)
        return [(int(x) // n, int(x) % n) for x in good]

    def _verify(self, ids: np.ndarray, shingles: np.ndarray, part: int, hits: dict[int, tuple[set[int], set[int]]]) -> None:
        item, first, mine = self.parts[part]
        windows, here = _grams(mine, self.width), _grams(ids, self.width)
        starts = [int(a) for a in np.flatnonzero(np.isin(windows, here)) if any(np.array_equal(mine[a : a + self.width], ids[b : b + self.width]) for b in np.flatnonzero(here == windows[a]))]
        if starts:
            passages, held = hits.setdefault(item, (set(), set()))
            passages.update(first + a for a in starts)
            held.update((first + np.flatnonzero(np.isin(_grams(mine, SHINGLE), shingles))).tolist())


SCHEMA = "item_id long, doc_id long, n_windows int, containment double"


def leaked(docs: DataFrame, doc_id: str, text: str, layout: str | None, items: DataFrame, item_id: str, item_text: str, width: int = 12, item_block: int = 20_000) -> DataFrame:
    """item_id, doc_id, n_windows (runs of ``width`` item words found), containment (share of the item's shingles in the pieces that hold them)."""
    if width < SHINGLE:
        raise ValueError(f"width must be at least {SHINGLE}")
    spark = docs.sparkSession
    asked = items.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).where(F.col("i").isNotNull() & F.col("t").isNotNull()).dropDuplicates(["i"])
    n_blocks = max(1, -(-asked.count() // item_block))
    given = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), (F.col(f"`{layout}`") if layout else F.lit(None).cast("string")).alias("layout")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    out = None
    for b in range(n_blocks):
        part = asked.where(F.pmod(F.xxhash64("i"), F.lit(n_blocks)) == b).orderBy("i").collect()
        index = spark.sparkContext.broadcast(Index([(r["i"], r["t"]) for r in part], width))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            known = index.value
            for batch in batches:
                rows = []
                names, held, size = [], [], 0
                for i in range(batch.num_rows + 1):
                    if names and (i == batch.num_rows or size > CHARS):
                        for doc, hits in zip(names, known.search(held)):
                            for item, (starts, at) in hits.items():
                                name, shingles = known.items[item]
                                rows.append((name, doc, len(starts), len(at) / len(shingles)))
                        names, held, size = [], [], 0
                    if i < batch.num_rows:
                        body = batch["text"][i].as_py()
                        names.append(batch["doc_id"][i].as_py())
                        held.append(cells(body, batch["layout"][i].as_py()))
                        size += len(body)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.float64()))], names=["item_id", "doc_id", "n_windows", "containment"])

        found = given.mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("item_id", "doc_id").agg(F.max("n_windows").alias("n_windows"), F.max("containment").alias("containment"))
