"""Abusive, hateful or sexual passages: multiple-instance learning from document labels.

A document is a bag of passages (sentences, lines, comment blocks). A passage
has features of its words; its score is a logistic function of their weights; the
document's score is the noisy-or of its passages, so one offending passage is
enough. Weights are trained from document labels alone, and the trained passage
scores then locate what is offending.

Words are read through common disguises: look-alike digits and signs, stretched
letters, zero-width characters, spelled-out words (``s-h-u-t``, ``m u l u t``),
identifiers and masked letters. Features are single words and sequences of two and
three words; sequences use consonant skeletons, which masked vowels do not change.

Fitting reads the labels of at most ``max_labelled`` documents, a bounded,
documented sample drawn by hash: each class may use half of the bound and what the
other class leaves of its half, so no class crowds out the other. Candidate features
are counted over all passages of those documents on the executors, and what comes
to the driver is at most MAX_FEATURES features and, once a document, the different
sets of them that its passages have. Scoring covers every
passage of every document, in one pass without a shuffle; of long runs without
white space only base64 and hexadecimal codes are not read.

Defined results: null or blank texts score 0; a document given twice counts once;
a document labelled several times counts as positive if any label says so; labels
of unknown documents are ignored; where one of the two classes has no labelled
document there is nothing to fit: the seed words alone decide, a warning is given
and the column ``fitted`` of every score says false; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
import warnings
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rajut.llm.notebook import cells
from rajut.session import cut

MAX_LABELLED, MAX_FEATURES = 20_000, 30_000
THRESHOLD = 0.35
#: Words that are abusive or explicit in ordinary use; where labels are few, the
#: weights are drawn towards them (Indonesian, English, Spanish).
SEEDS = """goblok tolol bangsat bajingan brengsek keparat kontol memek ngentot bego kampret bokep mesum lonte pelacur
idiot moron bastard asshole bitch scumbag imbecile dumbass retard whore slut loser fuck shit cunt vermin subhuman porn horny nudes threesome
idiota puta mierda cabron gilipollas imbecil pendejo escoria alimana zorra""".split()

_ZERO = re.compile("[​-‏⁠﻿­]")
_LOOKS = str.maketrans("@$!013457€", "asioieaste")
_LETTER = re.compile(r"[^\W\d_]")
_RUN = re.compile(r"(.)\1+")
_PARTS = re.compile(r"[^\w@$!*À-ɏ]+|_+")
_EDGE = "!?.,;:\"'`()[]{}<>=|#%&~^/\\+-–—…“”‘’«»¡¿"
_SPELLED = re.compile(r"(?:[^\W_][-._*]){2,}[^\W_][-._]?")
_BREAK = re.compile(r"(?<=[.?!])\s+|\n")
_COMMENT = re.compile(r"\n[ \t]*#[ \t]*(?=\S)")
LONG_TOKEN = 400
#: Only in runs of over LONG_TOKEN of these characters can a code be that is not read.
_CODE = re.compile(rf"[a-z0-9+/=]{{{LONG_TOKEN + 1},}}")
_VOWELS = re.compile(r"[aeiouáéíóúü*]")


def word(raw: str) -> str:
    """One word without disguise: look-alikes and accents replaced, repeated letters once; '' for numbers and what is then over 40 letters."""
    if not _LETTER.search(raw):
        return ""
    raw = raw.rstrip("!")
    if not raw.isascii():
        raw = "".join(c for c in unicodedata.normalize("NFKD", raw) if not unicodedata.combining(c)).lower()
    plain = _RUN.sub(r"\1", raw.translate(_LOOKS))
    return plain if len(plain) <= 40 else ""


def _not_code(run: re.Match) -> str:
    """Nothing for base64 and hexadecimal codes, which have many digits and long parts; else the run."""
    text = run[0]
    return " " if sum(map(text.count, "0123456789")) * 16 >= len(text) >= (text.count("+") + text.count("/")) * 16 else text


def token_words(token: str) -> tuple[str, ...]:
    """The words in a run of characters between white space."""
    if len(token) > LONG_TOKEN:
        token = _CODE.sub(_not_code, token)
    if token.isalpha() and token.isascii():
        plain = _RUN.sub(r"\1", token)
        return (plain,) if len(plain) <= 40 else ()
    token = token.strip(_EDGE)
    if not _LETTER.search(token):
        return ()
    if _SPELLED.fullmatch(token):
        w = word(re.sub(r"[-._]", "", token))
        return (w,) if w else ()
    out = []
    for part in _PARTS.split(token):
        if part:
            w = word(part)
            if w:
                out.append(w)
    return tuple(out)


@lru_cache(maxsize=200_000)
def skeleton(w: str) -> str:
    """Consonants only; a word of vowels stays one letter."""
    return _RUN.sub(r"\1", _VOWELS.sub("", w)) or w[:1]


def passages(text: str | None, layout: str | None) -> list[str]:
    """Sentences and lines of all cells; lines of one comment block are one passage."""
    out = []
    for cell in cells(text, layout):
        if _ZERO.search(cell):
            cell = _ZERO.sub("", cell)
        for p in _BREAK.split(_COMMENT.sub(" ", "\n" + cell)):
            if p and not p.isspace():
                out.append(p)
    return out


def words_of(passage: str) -> list[str]:
    flat: list[str] = []
    if _ZERO.search(passage):
        passage = _ZERO.sub("", passage)
    for token in passage.lower().split():
        flat += token_words(token)
    return flat if sum(len(w) == 1 for w in flat) < 3 else _joined(flat)


def _joined(flat: list[str]) -> list[str]:
    """Three or more single letters in a row are one word."""
    out: list[str] = []
    run: list[str] = []
    for w in [*flat, ""]:
        if len(w) == 1:
            run.append(w)
            continue
        out += ["".join(run)] if len(run) >= 3 else run
        run = []
        if w:
            out.append(w)
    return out


def features(ws: list[str]) -> set[str]:
    sk = [skeleton(w) for w in ws]
    found = {w for w in ws if len(w) > 1}
    found.update(f"{a} {b}" for a, b in zip(sk, sk[1:]))
    found.update(f"{a} {b} {c}" for a, b, c in zip(sk, sk[1:], sk[2:]))
    return found


SEED_FEATURES = frozenset(word(w) for w in SEEDS)


def fit(bags: list[list[list[int]]], labels: np.ndarray, n_features: int, prior: np.ndarray, rounds: int = 300, rate: float = 0.3, ridge: float = 2e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient ascent on the noisy-or likelihood of the bags (documents).

    Weights are drawn towards ``prior``; positives and negatives weigh by the
    square root of their imbalance.
    """
    lengths = np.array([len(b) for b in bags])
    sizes = np.array([len(p) for b in bags for p in b])
    flat = np.fromiter((f for b in bags for p in b for f in p), np.int64, int(sizes.sum()))
    row = np.repeat(np.arange(len(sizes)), sizes)
    bag = np.repeat(np.arange(len(bags)), lengths)
    scale = 1 / np.sqrt(np.maximum(1, sizes))[row]
    pos = max(1, int(labels.sum()))
    gain = np.where(labels == 1, np.sqrt(max(1, len(labels) - pos) / pos), 1.0)
    w, bias = prior.copy(), -4.0
    g2, b2 = np.full(n_features, 1e-3), 1e-3
    for _ in range(rounds):
        z = bias + np.bincount(row, w[flat] * scale, len(sizes))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_none = np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-9)), len(bags))
        none = np.exp(log_none)
        # d log-likelihood / dz of a passage: p * none / (1 - none) in positive bags, -p in negative ones
        dz = np.where(labels[bag] == 1, p * (none / np.maximum(1e-9, 1 - none))[bag], -p) * gain[bag]
        grad = np.bincount(flat, dz[row] * scale, n_features) - ridge * len(bags) * 0.05 * (w - prior)
        g2 += grad**2
        w += rate * grad / np.sqrt(g2)
        gb = dz.sum()
        b2 += gb**2
        bias = min(-2.0, bias + rate * gb / np.sqrt(b2))
    return w, float(bias)


def located(bags: list[list[list[int]]], labels: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    """For each feature the share of the positive bags with it in which a passage with it is the highest or scores at least half."""
    inside, blamed = np.zeros(len(w)), np.zeros(len(w))
    for bag, y in zip(bags, labels):
        if y != 1:
            continue
        z = np.array([bias + w[list(p)].sum() / len(p) ** 0.5 for p in bag])
        guilty = (z >= 0) | (z == z.max())
        inside[list({f for p in bag for f in p})] += 1
        blamed[list({f for p, g in zip(bag, guilty) if g for f in p})] += 1
    return blamed / np.maximum(1, inside)


_NUMBERS = "0123456789" + _EDGE
_NO_WORDS: tuple[tuple[str, ...], bool, int] = ((), False, 0)


class Scorer:
    """Scores passages; most have no word that any feature needs and are passed over quickly."""

    MOST_TOKENS = 150_000

    def __init__(self, weights: dict[str, float], bias: float, fitted: bool = True):
        self.weights, self.bias, self.fitted = weights, bias, fitted
        self.single = frozenset(f for f in weights if " " not in f)
        # a sequence needs all its words, so its longest one stands for it
        self.needed = frozenset(max(f.split(" "), key=len) for f in weights if " " in f)
        self.tokens: dict[str, tuple[tuple[str, ...], bool, int]] = {}

    def _learn(self, token: str) -> tuple[tuple[str, ...], bool, int]:
        """Words of a token, whether a feature may need one, how many are single letters."""
        if not token.strip(_NUMBERS):
            return _NO_WORDS
        ws = token_words(token)
        if len(self.tokens) > self.MOST_TOKENS:
            self.tokens.clear()
        entry = ws, any(w in self.single or skeleton(w) in self.needed for w in ws), sum(len(w) == 1 for w in ws)
        if len(token) <= LONG_TOKEN:
            self.tokens[token] = entry
        return entry

    def passage(self, text: str) -> float:
        known, learn = self.tokens.get, self._learn
        entries = [known(t) or learn(t) for t in text.lower().split()]
        ones = sum([e[2] for e in entries])
        if ones < 3 and not any([e[1] for e in entries]):
            return 0.0
        ws = [w for e in entries for w in e[0]]
        if ones >= 3:
            ws = _joined(ws)
        sk = [skeleton(w) for w in ws]
        get = self.weights.get
        hits = [x for x in map(get, {w for w in ws if len(w) > 1}) if x is not None]
        if not self.needed.isdisjoint(sk):
            grams = {f"{a} {b}" for a, b in zip(sk, sk[1:])}
            grams.update([f"{a} {b} {c}" for a, b, c in zip(sk, sk[1:], sk[2:])])
            hits += [x for x in map(get, grams) if x is not None]
        if not hits:
            return 0.0
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + sum(hits) / len(hits) ** 0.5))))

    def document(self, text: str | None, layout: str | None) -> tuple[float, float, str | None]:
        """(noisy-or score, highest passage score, that passage)."""
        none, top, where = 1.0, 0.0, None
        for p in passages(text, layout):
            s = self.passage(p)
            if s:
                none *= 1 - s
                if s > top:
                    top, where = s, p
        return 1 - none, top, where


def _unfitted(why: str) -> Scorer:
    warnings.warn(f"abuse scorer not fitted: {why}; only the seed words count", stacklevel=3)
    return Scorer({w: 6.0 for w in SEED_FEATURES}, -4.0, fitted=False)


def _drawn(labels: DataFrame, doc_id: str, label: str, bound: int) -> DataFrame:
    """doc and y (0 or 1) of at most ``bound`` labelled documents, by hash: half of it for each class and what the other leaves."""
    ys = labels.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), (F.col(f"`{label}`").cast("int") > 0).cast("int").alias("y")).where(F.col("doc").isNotNull() & F.col("y").isNotNull()).groupBy("doc").agg(F.max("y").alias("y"))
    n = {r["y"]: r["count"] for r in ys.groupBy("y").count().collect()}
    if n.get(0, 0) + n.get(1, 0) <= bound:
        return ys
    pos = min(n.get(1, 0), max(bound // 2, bound - n.get(0, 0)))
    part = lambda y, size: ys.where(F.col("y") == y).orderBy(F.xxhash64("doc"), "doc").limit(size)
    return part(1, pos).unionByName(part(0, bound - pos))


def train(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, layout: str, label_id: str, label: str, max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES) -> Scorer:
    """Fit the scorer on at most ``max_labelled`` labelled documents."""
    spark = docs.sparkSession
    ys = _drawn(labels, label_id, label, max_labelled)
    asked = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"), F.col(f"`{layout}`").alias("layout"))
    both = asked.join(F.broadcast(ys), "doc")  # at most max_labelled rows of two numbers

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, body, kind, y in zip(b["doc"], b["text"], b["layout"], b["y"]):
                for p in passages(body, kind):
                    f = features(words_of(p))
                    if f:
                        rows.append((doc, y, sorted(f)))
            if rows:
                yield pd.DataFrame(rows, columns=["doc", "y", "f"])

    bagged = cut(both.mapInPandas(bags, "doc long, y int, f array<string>"))
    totals = {r["y"]: r["n"] for r in bagged.groupBy("y").agg(F.countDistinct("doc").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return _unfitted("no labelled document of class " + ("1" if not pos else "0") + " has words")
    seen = bagged.select("doc", "y", F.explode("f").alias("f")).distinct().groupBy("f").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    least = 1 if pos < 30 else 2
    lift = (F.col("p") / F.lit(float(pos))) / ((F.col("n") + 0.5) / F.lit(float(neg)))
    wanted = seen.where((F.col("p") >= least) & (lift > 2)).withColumn("s", F.col("p") * F.log(lift)).orderBy(F.desc("s"), "f").limit(max_features)
    found = wanted.select("f", "p", "n").collect()
    names = [r["f"] for r in found]
    # what many positive and hardly any negative documents hold is no chance find
    sure = {r["f"] for r in found if r["p"] >= 6 and r["n"] * 10 <= r["p"]}
    index = {f: i for i, f in enumerate(sorted({*names, *SEED_FEATURES}))}
    known = spark.sparkContext.broadcast(index)

    def compact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = known.value.get
        for b in batches:
            hits = [sorted(i for i in map(get, f) if i is not None) for f in b["f"]]
            keep = [bool(h) for h in hits]
            if any(keep):
                yield pd.DataFrame({"doc": b["doc"][keep], "y": b["y"][keep], "f": [h for h in hits if h]})

    # equal passages of one document count once
    small = bagged.select("doc", "y", "f").mapInPandas(compact, "doc long, y int, f array<int>").distinct().toPandas()
    if not len(small):
        return _unfitted("no feature tells the classes apart")
    small["f"] = [tuple(f) for f in small["f"]]
    small = small.sort_values(["doc", "f"], kind="stable")
    grouped = small.groupby("doc", sort=True)
    lists = [list(g) for _, g in grouped["f"]]
    y = grouped["y"].first().to_numpy()
    prior = np.zeros(len(index))
    for f in SEED_FEATURES:
        prior[index[f]] = 3.0
    w, bias = fit(lists, y, len(index), prior)
    # words that positive documents hold outside their offending passages are no evidence: drop them and fit again
    strong = np.array([f in sure for f in sorted(index)]) | (prior > 0)
    for _ in range(2):
        kept = (located(lists, y, w, bias) >= 0.6) | strong
        bags_left = [[q for q in ([f for f in p if kept[f]] for p in bag) if q] for bag in lists]
        left = [i for i, bag in enumerate(bags_left) if bag]
        w, bias = fit([bags_left[i] for i in left], y[left], len(index), prior)
        lists, y = [bags_left[i] for i in left], y[left]
        w[~kept] = 0.0
    # documents without any candidate feature cannot change the weights
    return Scorer({f: float(w[i]) for f, i in index.items() if w[i] != 0}, bias)


SCHEMA = "doc_id long, source string, score double, top_score double, passage string, fitted boolean"


def score(docs: DataFrame, scorer: Scorer, doc_id: str, text: str, layout: str, source: str) -> DataFrame:
    """doc_id, source, score (noisy-or), top_score, passage (the highest passage) and fitted (false: seed words only)."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    picked = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"), F.col(f"`{layout}`").alias("layout")).where(F.col("doc_id").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            rows = [s.document(t, k) for t, k in zip(b["text"].to_pylist(), b["layout"].to_pylist())]
            cols = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["source"], pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.string()), pa.array([s.fitted] * b.num_rows, pa.bool_())], names=["doc_id", "source", "score", "top_score", "passage", "fitted"])

    return picked.mapInArrow(run, SCHEMA)
