"""Splitting oversized texts at natural boundaries by dynamic programming.

A text of more than ``limit`` words becomes ordered pieces of at most ``limit``
words. A piece may end after a paragraph (cost 0), a line, a sentence, or, where
nothing better is in reach, any word; the cheaper the boundary the better. The
next piece starts up to ``overlap`` words before that end, at the best natural
boundary inside the overlap. Over all end positions the program minimises

    sum of (cost of the cut + BALANCE * ((size - even size) / even size) ** 2)

where the even size is that of equally long pieces. Every word is in a piece.

Defined results: null and blank texts give no piece; a text within the limit is
one piece (decided in the JVM, it never reaches Python); a text delivered again
under its id counts once; a text without any boundary is cut between words; a
single "word" is never cut, however long. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rajut.functions.text import n_words

SPACES, CLOSING = [ord(c) for c in " \t\r\n"], [ord(c) for c in "?!….\"')]”»’"]
PARAGRAPH, LINE, SENTENCE, WORD_END = 0, 1, 2, 3
KINDS = ("paragraph", "line", "sentence", "word")
COST = np.array([0.0, 0.15, 0.3, 4.0])
BALANCE = 1.0
#: Words that end with a dot without ending a sentence (fixed values).
ABBREVIATIONS = frozenset("dr. prof. mis. hlm. no. s.d. dll. dsb. dkk. yth. tn. ny. ir. gbr. tab. vol. ed. cf. e.g. i.e. fig. vs. mr. mrs. etc.".split())

PIECES = "text_id long, piece_no int, start_word int, end_word int, n_words int, overlap int, cut string, piece string"


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each word the kind of boundary after it."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.diff(np.concatenate([[True], np.isin(code, SPACES), [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    kind = np.full(len(starts), WORD_END, np.int8)
    if not len(starts):
        return starts, ends, kind
    lf, cr = (np.concatenate([[0], np.cumsum(code == c)]) for c in (10, 13))
    lines = lf[starts[1:]] - lf[ends[:-1]]
    lines = np.where(lines > 0, lines, cr[starts[1:]] - cr[ends[:-1]])
    kind[:-1][lines == 1] = LINE
    kind[:-1][lines >= 2] = PARAGRAPH
    # only words that end with a stop or what closes after it are looked at one by one
    for i in np.flatnonzero(np.isin(code[ends[:-1] - 1], CLOSING) & (kind[:-1] == WORD_END)):
        last = text[starts[i] : ends[i]].rstrip("\"')]”»’")
        if last.endswith(("?", "!", "…")) or (last.endswith(".") and last.lower() not in ABBREVIATIONS and not re.fullmatch(r"[(]?(\d+|\w)\.", last) and not text[starts[i + 1]].islower()):
            kind[i] = SENTENCE
    kind[-1] = PARAGRAPH
    return starts, ends, kind


def split_positions(kind: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """The pieces as (first word, end word exclusive) for the boundary kinds after each word."""
    n = len(kind)
    if n == 0:
        return []
    if n <= limit:
        return [(0, n)]
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and under the limit")
    natural = np.flatnonzero(kind < WORD_END) + 1
    # words may end a piece only where natural ends are too far apart to keep pieces within reach; there a hundredth of the limit apart
    reach = max(1, (limit - overlap) // 2)
    marks = np.concatenate([[0], natural, [n]])
    wide = np.flatnonzero(np.diff(marks) > reach)
    extra = [np.arange(marks[i] + 1, marks[i + 1], max(1, min(limit // 100, (limit - overlap) // 4))) for i in wide]
    ends = np.unique(np.concatenate([natural, [n], *extra])).astype(np.int64)
    ends = ends[ends > 0]
    cost_at = COST[kind[ends - 1]]
    cost_at[-1] = 0.0

    # where the piece after an end starts: the earliest best boundary inside the overlap
    after = np.concatenate([[0], np.zeros(len(ends), np.int64)])
    kinds_before = np.concatenate([[PARAGRAPH], kind])  # kind of the boundary before word i
    for j, e in enumerate(ends):
        if overlap == 0 or e == n:
            after[j + 1] = e
            continue
        window = kinds_before[max(0, e - overlap) : e]
        near = window[: max(1, len(window) * 3 // 4)]  # keep at least a quarter of the overlap asked for
        best = int(near.argmin())
        after[j + 1] = max(0, e - overlap) + (best if near[best] < WORD_END else 0)
    count = int(np.ceil((n - overlap) / (limit - overlap)))
    even = (n + (count - 1) * overlap) / count

    total = np.full(len(ends) + 1, np.inf)
    total[0] = 0.0
    back = np.full(len(ends) + 1, -1, np.int64)
    stop = np.concatenate([[0], ends])
    low = 0
    for j in range(1, len(ends) + 1):
        e = stop[j]
        while after[low] < e - limit:
            low += 1
        first = low
        size = e - after[first:j]
        fresh = stop[first:j] < e
        trial = total[first:j] + BALANCE * ((size - even) / even) ** 2
        trial[(size > limit) | (size <= 0) | ~fresh] = np.inf
        best = int(trial.argmin())
        total[j] = trial[best] + cost_at[j - 1]
        back[j] = first + best
    out = []
    j = len(ends)
    while j > 0:
        i = int(back[j])
        out.append((int(after[i]), int(stop[j])))
        j = i
    return out[::-1]


def pieces_of(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int, str, str]]:
    """(first word, end word, words, overlap with the piece before, kind of cut, text) of each piece."""
    starts, ends, kind = boundaries(text)
    out, before = [], None
    for a, b in split_positions(kind, limit, overlap):
        out.append((a, b, b - a, 0 if before is None else before - a, "end" if b == len(kind) else KINDS[kind[b - 1]], text[starts[a] : ends[b - 1]]))
        before = b
    return out


def split_texts(df: DataFrame, id_col: str, text_col: str, limit: int = 800, overlap: int = 200) -> DataFrame:
    """One row per piece: text_id, piece_no (from 0), start_word, end_word (exclusive), n_words, overlap, cut, piece."""
    base = df.select(F.col(f"`{id_col}`").cast("long").alias("text_id"), F.col(f"`{text_col}`").alias("body")).where(F.col("text_id").isNotNull())
    # one pass over the texts: those that fit are not looked at word by word
    sized = base.dropDuplicates(["text_id"]).withColumn("n_words", n_words("body").cast("int")).where(F.col("n_words") > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, body, n in zip(batch["text_id"], batch["body"], batch["n_words"]):
                found = [(0, n, n, 0, "end", body.strip(" \t\r\n"))] if n <= limit else pieces_of(body, limit, overlap)
                rows += [(i, no, *p) for no, p in enumerate(found)]
            yield pd.DataFrame(rows, columns=["text_id", "piece_no", "start_word", "end_word", "n_words", "overlap", "cut", "piece"])

    return sized.select("text_id", "body", "n_words").mapInPandas(run, PIECES)
