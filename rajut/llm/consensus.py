"""Consensus from several annotators' labels: a community confusion model.

Annotators belong to types (communities) that share a confusion matrix. Each
annotator's own matrix has a Dirichlet prior centred on the matrices of the types
it seems to belong to, so one with few labels is read as its type is and one with
many as itself. Item labels, type memberships and matrices are inferred by
variational updates; known labels are held fixed. Each item group (here: the
source of a triple) has its own label shares.

Each round is one pass over the items: the matrices are broadcast (annotators x
labels^2 numbers, used only up to MAX_ANNOTATORS) and what returns is summed per
annotator and label on the executors. Beyond that bound, with more than
MAX_GROUPS groups or where an item has more than MAX_VOTES votes, the same rounds
with the same formulas and the same stop are done with joins; the results are equal.
Annotators or items with a large share of the votes are joined by broadcast there.

Defined results: labels outside the label set and votes for unknown items are
ignored; of several votes of one annotator for an item the latest counts; an item
without votes gets the likeliest label of its group, agreement null; a known label
is kept; annotators without a vote for an item are left out; ties go to the earlier label of the set; without any item the result is
empty; a proposal without any content is no vote. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rajut.session import cut

LABELS = ("correct", "partial", "wrong", "missing", "abaikan")
#: Spellings of the label for "to be ignored" (fixed values).
IGNORE = ("ignore", "ignored", "skip", "skipped")
MAX_ANNOTATORS, MAX_VOTES = 50_000, 10_000
#: Groups whose label shares come to the driver; those of more groups stay a table.
MAX_GROUPS = 1000
TYPES, STRENGTH, ROUNDS = 5, 20.0, 25
#: Rounds end when no expected probability of an annotator's matrix moves by this much.
STOP = 1e-4
K = len(LABELS)


def label_of(c: Column) -> Column:
    """One of LABELS or null: trimmed, lower case, spellings of abaikan unified."""
    t = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    t = F.when(t.isin(*IGNORE), "abaikan").otherwise(t)
    return F.when(c.isin(*LABELS), c).otherwise(F.when(t.isin(*LABELS), t))  # most are plain


def id_of(c: Column) -> Column:
    """An item id from text: white space, leading zeros and a final .0 dropped; null unless it is a number."""
    t = F.regexp_replace(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), r"\.0$", "")
    plain = (F.length(c) <= 18) & (c != "") & (F.translate(c, "0123456789", "") == "")
    return F.when(plain, c.try_cast("long")).otherwise(F.when(t.rlike(r"^[0-9]{1,40}$"), F.regexp_replace(t, r"^0+(?=[0-9])", "").try_cast("long")))


def content(*cols: str) -> Column:
    """Fields in lower case without extra spaces, as one key; null or blank fields count as ''."""
    return F.to_json(F.array(*[F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\s\p{Z}]+", " "), r"^ | $", "")) for c in cols]))


NO_CONTENT = '["","","",""]'


def votes(validations: DataFrame, triples: DataFrame) -> DataFrame:
    """triple_id, reviewer, label: ratings of each reviewer's latest submission per batch, and proposals as votes for missing."""
    once = validations.select("validation_id", "reviewer", "batch_id", "ratings", "missing_triples", "updated_at").where(F.col("reviewer").isNotNull()).dropDuplicates(["validation_id"])
    newest = Window.partitionBy("reviewer", "batch_id").orderBy(F.desc_nulls_last("updated_at"), F.desc("validation_id"))
    latest = once.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") == 1)
    rated = latest.select("reviewer", F.col("updated_at").alias("at"), F.explode("ratings").alias("k", "v")).select(id_of(F.col("k")).alias("triple_id"), "reviewer", label_of(F.col("v")).alias("label"), "at")
    proposed = latest.select("reviewer", F.col("updated_at").alias("at"), F.explode("missing_triples").alias("m")).select("reviewer", "at", "m.*")
    keyed = triples.select("triple_id", content("chapter", "subject", "relation", "target").alias("key"))
    found = proposed.select("reviewer", "at", content("chapter", "subject", "relation", "target").alias("key")).where(F.col("key") != NO_CONTENT).join(keyed, "key").select("triple_id", "reviewer", F.lit("missing").alias("label"), "at")
    every = rated.unionByName(found).where(F.col("triple_id").isNotNull() & F.col("label").isNotNull())
    # time and label in one number, which an aggregation by hash can hold
    code = F.coalesce(F.unix_micros("at"), F.lit(-(1 << 59))) * 8 + _index("label")
    last = every.groupBy("triple_id", "reviewer").agg(F.max(code).alias("c"))
    return last.select("triple_id", "reviewer", F.get(F.array(*[F.lit(x) for x in LABELS]), F.pmod("c", F.lit(8)).cast("int")).alias("label"))


class Model:
    """Sufficient statistics on the driver: annotators x K x K counts, TYPES matrices, label shares of the groups."""

    def __init__(self, groups: list[str]):
        self.groups = groups
        good = np.full((K, K), 0.08 / (K - 1)) + np.eye(K) * (0.92 - 0.08 / (K - 1))
        fair = np.full((K, K), 0.35 / (K - 1)) + np.eye(K) * (0.65 - 0.35 / (K - 1))
        mild = fair * 0.6 + 0.4 * np.eye(K)[0]
        even = np.full((K, K), 1 / K)
        lazy = np.full((K, K), 0.1 / (K - 1)) + np.eye(K)[0] * (0.9 - 0.1 / (K - 1))
        self.types = np.stack([good, fair, mild, even, lazy])[:TYPES]
        self.weights = np.full(len(self.types), 1 / len(self.types))
        self.shares = np.full((len(groups), K), 1 / K)

    def annotators(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected log matrices [R, K, K], memberships [R, TYPES]) from counts [R, K, K]."""
        log_member = np.log(self.weights)[None, :].repeat(len(counts), 0)
        for m, t in enumerate(self.types):
            prior = STRENGTH * t
            log_member[:, m] += (_lgamma(prior.sum(1)) - _lgamma(prior.sum(1) + counts.sum(2))).sum(1) + (_lgamma(prior + counts) - _lgamma(prior)).sum((1, 2))
        member = np.exp(log_member - log_member.max(1, keepdims=True))
        member /= member.sum(1, keepdims=True)
        alpha = STRENGTH * np.einsum("rm,mkl->rkl", member, self.types) + counts
        return _digamma(alpha) - _digamma(alpha.sum(2, keepdims=True)), member

    def update(self, counts: np.ndarray, member: np.ndarray, shares: np.ndarray) -> None:
        pooled = np.einsum("rm,rkl->mkl", member, counts) + 2.0 * self.types
        self.types = pooled / pooled.sum(2, keepdims=True)
        self.weights = (member.sum(0) + 1) / (member.sum() + len(self.weights))
        self.shares = (shares + 0.2) / (shares + 0.2).sum(1, keepdims=True)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument above 7."""
    x = np.asarray(x, float).copy()
    shift = np.zeros_like(x)
    for _ in range(7):
        low = x < 7
        shift -= np.where(low, np.log(x), 0)
        x = np.where(low, x + 1, x)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def _digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float).copy()
    shift = np.zeros_like(x)
    for _ in range(7):
        low = x < 7
        shift -= np.where(low, 1 / x, 0)
        x = np.where(low, x + 1, x)
    return shift + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def _posterior(logs: np.ndarray, known: np.ndarray) -> np.ndarray:
    q = np.exp(logs - logs.max(1, keepdims=True))
    q /= q.sum(1, keepdims=True)
    fixed = known >= 0
    q[fixed] = 0.0
    q[fixed, known[fixed]] = 1.0
    return q


def _index(c: Column | str) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col(c) if isinstance(c, str) else c), F.lit(0)).cast("int") - 1


def infer(items: DataFrame, cast: DataFrame, rounds: int = ROUNDS, max_annotators: int = MAX_ANNOTATORS, people: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(consensus, annotators).

    ``items``: item, grp, known (label or null). ``cast``: item, who, label.
    ``people``: who, all that may occur in ``cast``, where that is cheaper to list.
    consensus: item, label, confidence, n_votes, agreement (share of agreeing
    pairs of votes). annotators: who, n_votes, reliability (expected share of
    right labels), kind (likeliest type).
    """
    spark = items.sparkSession
    its = items.select("item", F.coalesce("grp", F.lit("")).alias("grp"), _index(F.coalesce("known", F.lit(""))).alias("known")).where(F.col("item").isNotNull()).dropDuplicates(["item"])
    valid = cast.select("item", "who", _index("label").alias("lab")).where((F.col("lab") >= 0) & F.col("who").isNotNull()).dropDuplicates(["item", "who"])
    names = cut((valid if people is None else people).select("who").where(F.col("who").isNotNull()).distinct())
    groups = [r["grp"] for r in its.groupBy("grp").count().orderBy(F.desc("count"), "grp").limit(MAX_GROUPS + 1).collect()]
    many = len(groups) > MAX_GROUPS
    model = Model(groups or [""])
    n_who = names.count()
    # an item has one vote of an annotator at most, so few annotators bound its votes
    most = valid.groupBy("item").count().agg(F.max("count")).first()[0] or 0 if MAX_VOTES < n_who <= max_annotators else 0
    if many or n_who > max_annotators or most > MAX_VOTES:
        return _infer_joined(its, valid, names, model, rounds, many)

    who = {r["who"]: i for i, r in enumerate(names.orderBy("who").collect())}
    table = spark.createDataFrame(list(who.items()) or [("", -1)], "who string, w int")
    packed = valid.join(F.broadcast(table), "who").groupBy("item").agg(F.collect_list(F.col("w") * F.lit(K) + F.col("lab")).alias("cast"))
    grp = spark.createDataFrame(list(zip(model.groups, range(len(model.groups)))), "grp string, g int")  # at most MAX_GROUPS rows
    data = cut(its.join(F.broadcast(grp), "grp").join(packed, "item", "left").select("item", "g", "known", F.coalesce("cast", F.array().cast("array<int>")).alias("cast")))
    n_groups = len(model.groups)

    def posteriors(b: pa.RecordBatch, logs: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(posteriors, votes, the row of each vote, the group of each row) of a batch."""
        held = b["cast"]
        flat = held.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(held)), held.value_lengths().to_numpy(zero_copy_only=False))
        of = b["g"].to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.log(shares)[of]
        for k in range(K):
            total[:, k] += np.bincount(row, logs[flat // K, k, flat % K], len(held))
        return _posterior(total, b["known"].to_numpy(zero_copy_only=False)), flat, row, of

    counts = np.zeros((max(1, n_who), K, K))
    logs, member = model.annotators(counts)
    for _ in range(rounds):
        state = spark.sparkContext.broadcast((logs, model.shares))

        def add(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            logs, shares = state.value
            votes_by, items_by = np.zeros((len(logs) * K, K)), np.zeros((n_groups, K))
            for b in batches:
                if b.num_rows:
                    q, flat, row, of = posteriors(b, logs, shares)
                    for k in range(K):
                        votes_by[:, k] += np.bincount(flat, q[row, k], len(votes_by))
                        items_by[:, k] += np.bincount(of, q[:, k], n_groups)
            used = np.flatnonzero(votes_by.any(1))
            keys = np.concatenate([used, -1 - np.arange(n_groups)])
            yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(np.concatenate([votes_by[used, j], items_by[:, j]])) for j in range(K)]], names=["k", *[f"q{j}" for j in range(K)]])

        sums = data.mapInArrow(add, "k long, " + ", ".join(f"q{j} double" for j in range(K))).groupBy("k").agg(*[F.sum(f"q{j}").alias(f"q{j}") for j in range(K)]).toPandas()
        k, q = sums["k"].to_numpy(), sums[[f"q{j}" for j in range(K)]].to_numpy()
        counts = np.zeros((max(1, n_who), K, K))
        at = k >= 0
        counts[k[at] // K, :, k[at] % K] = q[at]
        shares = np.zeros_like(model.shares)
        shares[-1 - k[~at]] = q[~at]
        model.update(counts, member, shares)
        before = logs
        logs, member = model.annotators(counts)
        if np.abs(np.exp(logs) - np.exp(before)).max() < STOP:
            break
    final = spark.sparkContext.broadcast((logs, model.shares))

    def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, shares = final.value
        for b in batches:
            if b.num_rows:
                q, flat, row, _ = posteriors(b, logs, shares)
                seen = np.bincount(row * K + flat % K, minlength=len(q) * K).reshape(-1, K).astype(float)
                n = seen.sum(1)
                pairs = (seen * (seen - 1)).sum(1) / np.maximum(1, n * (n - 1))
                yield pa.RecordBatch.from_arrays([b["item"], pa.array(np.array(LABELS)[q.argmax(1)].tolist()), pa.array(q.max(1)), pa.array(n.astype(np.int32)), pa.array(pairs, mask=n < 2)], names=["item", "label", "confidence", "n_votes", "agreement"])

    out = data.mapInArrow(say, f"item {items.schema['item'].dataType.simpleString()}, label string, confidence double, n_votes int, agreement double")
    overall = counts.sum((0, 2)) / max(1e-9, counts.sum())
    matrix = np.exp(logs)
    matrix /= matrix.sum(2, keepdims=True)
    right = np.einsum("k,rkk->r", overall, matrix)
    found = [(w, int(counts[i].sum().round()), float(right[i]), int(member[i].argmax())) for w, i in who.items()]
    return out, spark.createDataFrame([f for f in found if f[1]], "who string, n_votes int, reliability double, kind int")


HOT_VOTES = 100_000


def _hot(cast: DataFrame, key: str) -> DataFrame | None:
    """The keys with over a thousandth of the votes and over HOT_VOTES of them, at most a thousand; None without any."""
    n = cast.count()
    hot = cast.groupBy(key).count().where(F.col("count") > max(HOT_VOTES, n // 1000)).select(key, F.lit(True).alias(f"hot_{key}"))
    return None if n <= HOT_VOTES or hot.isEmpty() else cut(hot)


def _with(cast: DataFrame, right: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """``cast`` joined to one row a key; the rows of hot keys stay where they are."""
    if hot is None:
        return cast.join(right, key)
    few = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))  # at most a thousand rows
    return cast.where(F.col(f"hot_{key}")).join(few, key).unionByName(cast.where(~F.col(f"hot_{key}")).join(right, key))


def _infer_joined(its: DataFrame, valid: DataFrame, names: DataFrame, model: Model, rounds: int, many: bool) -> tuple[DataFrame, DataFrame]:
    """The same rounds with joins, for any number of annotators, of groups (``many``: not to be broadcast) and of votes for an item."""
    spark = its.sparkSession
    cells = [f"c{k}_{lab}" for k in range(K) for lab in range(K)]
    qs = [f"q{k}" for k in range(K)]
    types = range(len(model.types))
    data, cast = cut(its), cut(valid)
    hot = {key: _hot(cast, key) for key in ("who", "item")}
    for key, keys in hot.items():
        if keys is not None:
            cast = cast.join(F.broadcast(keys), key, "left").withColumn(f"hot_{key}", F.coalesce(f"hot_{key}", F.lit(False)))
    cast = cut(cast)
    logs_schema = "who string, " + ", ".join(f"l{c} double" for c in cells) + ", " + ", ".join(f"m{m} double" for m in types) + ", " + ", ".join(f"{c} double" for c in cells)

    def annotators(people: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast((model.types, model.weights))

        def each(batches, shared=shared):
            local = Model([""])
            local.types, local.weights = shared.value
            for b in batches:
                if len(b):
                    counts = b[cells].to_numpy().reshape(-1, K, K)
                    logs, member = local.annotators(counts)
                    yield pd.DataFrame({"who": b["who"], **{f"l{c}": logs.reshape(len(b), -1)[:, i] for i, c in enumerate(cells)}, **{f"m{m}": member[:, m] for m in range(member.shape[1])}, **{c: b[c] for c in cells}})

        return cut(people.mapInPandas(each, logs_schema))

    def posteriors(known: DataFrame, share: DataFrame) -> DataFrame:
        logw = [F.when(F.col("lab") == 0, F.col(f"lc{k}_0")) for k in range(K)]
        for lab in range(1, K):
            logw = [w.when(F.col("lab") == lab, F.col(f"lc{k}_{lab}")) for k, w in enumerate(logw)]
        summed = _with(cast, known.select("who", *[f"l{c}" for c in cells]), "who", hot["who"]).groupBy("item").agg(*[F.sum(w).alias(f"s{k}") for k, w in enumerate(logw)])
        full = data.join(share if many else F.broadcast(share), "grp", "left").join(summed, "item", "left").fillna(0.0)
        logits = [F.col(f"p{k}") + F.col(f"s{k}") for k in range(K)]
        top = F.greatest(*logits)
        raw = [F.exp(x - top) for x in logits]
        total = sum(raw[1:], raw[0])
        return cut(full.select("item", "grp", *[F.when(F.col("known") >= 0, (F.col("known") == k).cast("double")).otherwise(raw[k] / total).alias(q) for k, q in enumerate(qs)]))

    share = cut(data.select("grp").distinct().select("grp", *[F.lit(float(np.log(1 / K))).alias(f"p{k}") for k in range(K)]))
    known = annotators(names.select("who", *[F.lit(0.0).alias(c) for c in cells]))
    for _ in range(rounds):
        post = posteriors(known, share)
        by = _with(cast, post.drop("grp"), "item", hot["item"]).groupBy("who").agg(*[F.sum(F.when(F.col("lab") == lab, F.col(f"q{k}")).otherwise(0.0)).alias(f"c{k}_{lab}") for k in range(K) for lab in range(K)])
        people = cut(names.select("who").join(by, "who", "left").fillna(0.0))
        pooled = known.select(*[f"m{m}" for m in types], "who").join(people, "who")
        sums = pooled.agg(*[F.sum(F.col(f"m{m}") * F.col(c)).alias(f"t{m}{c}") for m in types for c in cells], *[F.sum(f"m{m}").alias(f"m{m}") for m in types]).first()
        held = post.groupBy("grp").agg(*[F.sum(q).alias(q) for q in qs])
        share = cut(held.select("grp", *[F.log((F.col(q) + 0.2) / (sum((F.col(x) for x in qs), F.lit(0.0)) + 0.2 * K)).alias(f"p{k}") for k, q in enumerate(qs)]))
        typed = np.array([[sums[f"t{i}{c}"] or 0.0 for c in cells] for i in types]).reshape(-1, K, K) + 2.0 * model.types
        model.types = typed / typed.sum(2, keepdims=True)
        size = np.array([sums[f"m{i}"] or 0.0 for i in types])
        model.weights = (size + 1) / (size.sum() + len(size))
        before, known = known, annotators(people)
        moved = F.greatest(*[F.abs(F.exp(F.col(f"l{c}")) - F.col(f"b{c}")) for c in cells])
        if (known.join(before.select("who", *[F.exp(f"l{c}").alias(f"b{c}") for c in cells]), "who").agg(F.max(moved)).first()[0] or 0.0) < STOP:
            break
    post = posteriors(known, share)
    seen = cast.groupBy("item").agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col("lab") == lab).cast("long")).alias(f"n{lab}") for lab in range(K)])
    pairs = sum((F.col(f"n{lab}") * (F.col(f"n{lab}") - 1) for lab in range(K)), F.lit(0))
    best = F.greatest(*qs)
    label = F.coalesce(*[F.when(F.col(q) == best, lab) for q, lab in zip(qs, LABELS)])
    out = post.join(seen, "item", "left").select("item", label.alias("label"), best.alias("confidence"), F.coalesce("n", F.lit(0)).cast("int").alias("n_votes"), F.when(F.col("n") > 1, pairs / (F.col("n") * (F.col("n") - 1))).alias("agreement"))
    # each label's share among the votes, as in the other form
    totals = known.agg(*[F.sum(F.col(f"c{k}_{lab}")).alias(f"c{k}_{lab}") for k in range(K) for lab in range(K)]).first()
    overall = np.array([sum(totals[f"c{k}_{lab}"] or 0.0 for lab in range(K)) for k in range(K)])
    overall /= max(1e-9, overall.sum())
    right = sum((F.lit(float(overall[k])) * F.exp(F.col(f"lc{k}_{k}")) / sum((F.exp(F.col(f"lc{k}_{x}")) for x in range(K)), F.lit(0.0)) for k in range(K)), F.lit(0.0))
    top = F.greatest(*[f"m{i}" for i in types])
    kind = F.coalesce(*[F.when(F.col(f"m{i}") == top, F.lit(i)) for i in types])
    n_votes = F.round(sum((F.col(c) for c in cells), F.lit(0.0))).cast("int")
    return out, known.select("who", n_votes.alias("n_votes"), right.alias("reliability"), kind.alias("kind")).where(F.col("n_votes") > 0)
