"""Matching entities across two sources without a common key: probabilistic record linkage.

1. Features. Tokens are runs of letters and digits. What is common (in more than
   a share of one side's records) and what is rare is counted over all records.
   A title's rare tokens are its core; the common ones say which kind it is.
2. Multi-pass blocking. Records of one side with equal features are one class.
   Candidates share (a) a core token, or core tokens within one deletion of each
   other on both sides (any single typing error), (b) for titles without a core, all
   title tokens, (c) two rare description tokens. Which tokens are near each other is
   found on the distinct tokens, so a pair of records meets once a token. Each right
   record meets the left classes of a key (of (c): of one of the two tokens) where
   these are at most FEW. Beyond that a
   key is *crowded* and is made specific. Two crowded keys that a record has, at
   least one of them of (c), are a key of their own, again for at most FEW. And under
   a crowded key of (a) or (b), or of two, each right record meets one
   representative of each *kind* of left record - equal title words and level - with
   the number it stands for. All that only such a representative says of several
   records is that they are equally likely, so none of them can reach a confidence
   of 0.5; a kind of one record is an ordinary candidate. Work is a few rows for each
   right record and key, whatever the size of the key, and the rule is the same at
   every size. What it can miss is a pair under crowded keys that is set apart from
   others of its kind by common description words alone.
3. Comparison. Five attributes, each with levels of agreement (see LEVELS).
4. Expectation-maximisation of the match share and of each level's probability
   among matches and non-matches, over the counts of level patterns (a table of
   at most a few thousand rows, whatever the input).
5. Confidence. A record of the right side describes at most one of the left, so
   its candidates share one unit of probability with "none":
   odds / (1 + sum of odds). A class of several left records counts that often.

Defined results: null and blank attributes are "missing" and say nothing; a row
delivered again under its id counts once; records without id are ignored; empty
tables give no pairs; left records with equal features are indistinguishable and
get no pair, right ones all get theirs; very long descriptions take part with all
their tokens. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rajut.operators.skew import lookup
from rajut.session import cut

FEW, PART = 20, 100_000
COMMON_TITLE, COMMON_TEXT, DECORATION = 0.002, 0.01, 0.01
CLASSES = {"x": 10, "xi": 11, "xii": 12, "10": 10, "11": 11, "12": 12}
#: Words of a level that name neither subject nor class (fixed values).
LEVEL_WORDS = ("kelas", "fase", "e", "f", "x", "xi", "xii")
#: Attributes and their levels of agreement.
LEVELS = {
    "core": ("equal", "one typing error", "different"),
    "kind": ("equal", "reworded", "left has more", "right has more", "conflict"),
    "facts": ("missing", "none", "some", "all"),
    "words": ("missing", "few", "most", "all"),
    "level": ("missing", "same", "same subject", "same class", "different"),
}


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _frequent(df: DataFrame, n: int) -> tuple[dict[str, int], set[str]]:
    """(counts of title tokens of more than a share COMMON_TITLE of n rows, description tokens of more than COMMON_TEXT).

    At most the mean number of tokens of a row / share of them.
    """
    each = lambda c, title: df.select(F.lit(title).alias("title"), F.explode(F.array_distinct(c)).alias("t"))
    counts = each("title", True).unionByName(each("body", False)).groupBy("title", "t").count()
    least = F.when(F.col("title"), max(2, int(n * COMMON_TITLE))).otherwise(max(3, int(n * COMMON_TEXT)))
    found = counts.where(F.col("count") > least).collect()
    return {r["t"]: r["count"] for r in found if r["title"]}, {r["t"] for r in found if not r["title"]}


def _among(c: Column | str, known: list[str]) -> Column:
    return F.array_intersect(c, F.array(*[F.lit(x) for x in known]).cast("array<string>"))


def _without(c: Column | str, known: list[str]) -> Column:
    return F.array_except(c, F.array(*[F.lit(x) for x in known]).cast("array<string>"))


def _side(df: DataFrame, id_col: str, title: str, text: str, level: str) -> DataFrame:
    picked = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), *[F.col(f"`{c}`").cast("string").alias(n) for c, n in ((title, "title"), (text, "body"), (level, "grade"))])
    once = picked.where(F.col("id").isNotNull()).dropDuplicates(["id"])
    split_level = F.regexp_replace(F.lower(F.coalesce("grade", F.lit(""))), r"(\p{L})(?=\p{N})", "$1 ")
    named = once.select("id", F.array_distinct(tokens(F.col("title"))).alias("title"), F.array_distinct(tokens(F.col("body"))).alias("body"), tokens(split_level).alias("grade"))
    classes = F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])
    subject = F.get(F.filter("grade", lambda t: ~t.isin(*LEVEL_WORDS) & t.rlike(r"^\p{L}")), F.lit(0))
    klass = F.get(F.filter(F.transform("grade", lambda t: F.try_element_at(classes, t)), lambda x: x.isNotNull()), F.lit(0))
    return named.select("id", "title", F.array_except("body", "title").alias("body"), F.substring(subject, 1, 3).alias("subject"), klass.alias("klass"))


def _near(left: DataFrame, right: DataFrame) -> DataFrame:
    """tl, tr: different core tokens of the two sides that share (the hash of) a one-deletion variant; found on the distinct tokens."""
    deleted = F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.concat(F.substring("t", F.lit(1), i - 1), F.substring("t", i + 1, F.length("t"))))
    variants = lambda s, n: s.select(F.explode("core").alias("t")).distinct().where(F.length("t").between(5, 64)).select(F.col("t").alias(n), F.explode(F.array_distinct(F.transform(F.concat(F.array("t"), deleted), lambda x: F.xxhash64(x)))).alias("v"))
    return variants(left, "tl").join(variants(right, "tr"), "v").where(F.col("tl") != F.col("tr")).select("tl", "tr").distinct()


def _keyed(side: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """id, key, fact: the blocking keys of each record (``fact``: of a description token); with ``near`` also those of the other side's near tokens."""
    titles = side.select("id", F.explode("core").alias("t"))
    if near is not None:
        titles = titles.unionByName(titles.join(near, F.col("t") == F.col("tr")).select("id", F.col("tl").alias("t"))).distinct()
    core = titles.select("id", F.xxhash64(F.lit("t"), "t").alias("key"), F.lit(False).alias("fact"))
    bare = side.where((F.size("core") == 0) & (F.size("kind") > 0)).select("id", F.xxhash64(F.lit("k"), F.array_sort("kind")).alias("key"), F.lit(False).alias("fact"))
    facts = side.select("id", F.explode("facts").alias("f")).select("id", F.xxhash64(F.lit("d"), "f").alias("key"), F.lit(True).alias("fact"))
    return core.unionByName(bare).unionByName(facts)


def _meet(left: DataFrame, right: DataFrame, heavy: bool, *extra: str) -> DataFrame:
    """Pairs l, r (and ``extra`` of the left rows) of equal key, where each key has few left rows.

    Where keys are ``heavy``, with more than PART right rows (their number is nb),
    these are cut to parts, each with its own copy of the left rows, so a key with a
    third of all rows is spread over tasks.
    """
    parts = F.ceil(F.col("nb") / PART)
    on = ["key", "part"] if heavy else ["key"]
    a = left.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))) if heavy else left
    b = right.withColumn("part", F.pmod(F.xxhash64("id"), parts)) if heavy else right
    return a.select(*on, F.col("id").alias("l"), *extra).join(b.select(*on, F.col("id").alias("r")), on).select("l", "r", *extra)


def _round(ka: DataFrame, kb: DataFrame, kind: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs l, r, times of the keys of one level, the crowded keys' rows on the left, on the right)."""
    na, nb = (k.groupBy("key").agg(F.count(F.lit(1)).alias(n)) for k, n in ((ka, "na"), (kb, "nb")))
    met = cut(na.join(nb, "key"))  # keys of one side only are gone from here on
    size = met.agg(F.coalesce(F.max("nb"), F.lit(0)).alias("widest"), F.coalesce(F.sum("na"), F.lit(0)).alias("a"), F.coalesce(F.sum("nb"), F.lit(0)).alias("b")).first()
    heavy = size["widest"] > PART
    la, lb = cut(lookup(ka, met, ["key"], "na", total=size["a"])), cut(lookup(kb, met, ["key"], "nb", total=size["b"]))
    hot_a, hot_b = la.where(F.col("na") > FEW), lb.where(F.col("na") > FEW)
    few = _meet(la.where(F.col("na") <= FEW), lb.where(F.col("na") <= FEW), heavy).withColumn("times", F.lit(1).cast("long"))
    kinds = hot_a.where(~F.col("fact")).join(kind, "id").groupBy("key", "kind").agg(F.min("id").alias("id"), F.sum("m").alias("times"), F.first("nb").alias("nb"))
    return few.unionByName(_meet(kinds, hot_b.where(~F.col("fact")), heavy, "times")), hot_a, hot_b


def _twos(hot: DataFrame) -> DataFrame:
    """id, key, fact: keys of two crowded keys of a record, at least one of them of a description token."""
    held = hot.groupBy("id").agg(F.collect_list(F.when(F.col("fact"), F.col("key"))).alias("fs"), F.collect_list(F.when(~F.col("fact"), F.col("key"))).alias("ts"))
    one = held.select("id", "fs", "ts", F.explode("fs").alias("f"))
    others = F.concat(F.filter("fs", lambda g: g > F.col("f")), F.col("ts"))
    return one.select("id", F.explode(F.transform(others, lambda g: F.xxhash64("f", g))).alias("key"), F.lit(False).alias("fact"))


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """l, r, times: pairs of ids that share a blocking key, each once; ``times`` > 1 stands for that many left records that only look alike."""
    alike = F.xxhash64(F.to_json(F.struct(F.array_sort("kind").alias("kind"), "subject", "klass", (F.size("facts") == 0).alias("silent"))))
    kind = left.select("id", F.col("n").alias("m") if "n" in left.columns else F.lit(1).cast("long").alias("m"), alike.alias("kind"))
    first, hot_a, hot_b = _round(_keyed(left), _keyed(right, cut(_near(left, right))), kind)
    second, _, _ = _round(_twos(hot_a), _twos(hot_b), kind)
    # a record met in person no longer hides among its kind
    return first.unionByName(second).groupBy("l", "r").agg(F.min("times").alias("times"))


def _compare() -> list[Column]:
    lc, rc = F.col("l.core"), F.col("r.core")
    near = F.exists(lc, lambda x: F.exists(rc, lambda y: (F.length(x) >= 5) & (F.abs(F.length(x) - F.length(y)) <= 1) & (F.levenshtein(x, y, 2) >= 0)))
    bare = (F.size(lc) == 0) & (F.size(rc) == 0) & (F.array_sort("l.kind") == F.array_sort("r.kind"))
    core = F.when(F.arrays_overlap(lc, rc) | bare, 0).when(near, 1).otherwise(2)
    l_more, r_more = F.size(F.array_except("l.kind", "r.kind")), F.size(F.array_except("r.kind", "l.kind"))
    spare = F.size(F.array_except("r.unknown", F.transform(lc, lambda t: F.hash(t)))) - F.when(core == 1, 1).otherwise(0)
    kind = F.when((l_more == 0) & (r_more == 0), 0).when((r_more == 0) & (l_more <= spare), 1).when(r_more == 0, 2).when(l_more == 0, 3).otherwise(4)
    shared, asked = F.size(F.array_intersect("l.facts", "r.facts")), F.size("r.facts")
    silent = (F.size("l.facts") + F.size("l.words") == 0) | (F.size("r.facts") + F.size("r.words") == 0)
    facts = F.when(silent | (asked == 0), 0).when(shared == 0, 1).when(shared < asked, 2).otherwise(3)
    w, wn = F.size(F.array_intersect("l.words", "r.words")), F.size("r.words")
    words = F.when(silent | (wn == 0), 0).when(w * 3 < wn * 2, 1).when(w < wn, 2).otherwise(3)
    s, c = F.col("l.subject") == F.col("r.subject"), F.col("l.klass") == F.col("r.klass")
    level = F.when(s.isNull() | c.isNull(), 0).when(s & c, 1).when(s, 2).when(c, 3).otherwise(4)
    return [core.alias("core"), kind.alias("kind"), facts.alias("facts"), words.alias("words"), level.alias("level"), shared.alias("shared")]


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, prior: float = 1.0) -> np.ndarray:
    """Posterior of being a match for each pattern of levels, by expectation-maximisation.

    Attributes are taken as independent given match or non-match. It starts from
    the patterns in which what is known agrees.
    """
    sizes = [len(v) for v in LEVELS.values()]
    core, kind, facts, _, level = patterns.T
    sure = ((facts == 3) & (core < 2)) | ((facts == 0) & (core == 0) & (kind < 2) & (level < 2))
    post = np.where(sure, 0.9, 0.05)
    for _ in range(rounds):
        m, u = counts * post, counts * (1 - post)
        share = (m.sum() + prior) / (counts.sum() + 2 * prior)
        odds = np.full(len(counts), np.log(share / (1 - share)))
        for j, size in enumerate(sizes):
            pm = np.bincount(patterns[:, j], m, size) + prior
            pu = np.bincount(patterns[:, j], u, size) + prior
            odds += np.log(pm / pm.sum())[patterns[:, j]] - np.log(pu / pu.sum())[patterns[:, j]]
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post


def link(left: DataFrame, right: DataFrame, left_cols: tuple[str, str, str, str], right_cols: tuple[str, str, str, str], least: float = 0.5) -> DataFrame:
    """left_id, right_id, confidence and the level of each attribute, for confidence >= least.

    ``*_cols``: id, title, description, level.
    """
    spark = left.sparkSession
    schema = "left_id long, right_id long, confidence double, core int, kind int, facts int, words int, level int"
    a, b = cut(_side(left, *left_cols)), cut(_side(right, *right_cols))
    n_a, n_b = a.count(), b.count()
    if not n_a or not n_b:
        return spark.createDataFrame([], schema)
    (title_a, text_a), (title_b, text_b) = _frequent(a, n_a), _frequent(b, n_b)
    noise = [t for t, n in title_b.items() if n > max(2, int(n_b * DECORATION))]
    text_any, text_both = sorted(text_a | text_b), sorted(text_a & text_b)

    def features(s: DataFrame) -> DataFrame:
        core = _without("title", sorted({*title_a, *title_b}))
        unknown = _without("title", sorted({*title_a, *noise}))
        return s.select("id", core.alias("core"), _among("title", sorted(title_a)).alias("kind"), unknown.alias("unknown"), _without("body", text_any).alias("facts"), _among("body", text_both).alias("words"), "subject", "klass")

    fa, fb = features(a), features(b)
    la, lb = cut(_classes(fa)), cut(_classes(fb))
    pairs = candidates(la, lb)
    best = decide(compare(pairs, la, lb), least)
    if best is None:
        return spark.createDataFrame([], schema)
    # every right record of a class gets the class's pair
    lone = best.where(F.col("n_right") == 1).drop("n_right")
    members = lookup(fb.select(*_hash(), F.col("id").alias("other")), lb.where(F.col("n") > 1).select("h1", "h2", F.col("id").alias("right_id"), "n"), ["h1", "h2"], "n").select("right_id", "other")
    several = best.where(F.col("n_right") > 1).drop("n_right").join(members, "right_id").drop("right_id").withColumnRenamed("other", "right_id")
    return lone.unionByName(several).select("left_id", "right_id", "confidence", *LEVELS)


def _hash() -> list[Column]:
    """A record's features as 128 bits."""
    whole = F.to_json(F.struct(*[F.array_sort(c).alias(c) for c in ("core", "kind", "unknown", "facts", "words")], "subject", "klass"))
    return [F.xxhash64(whole).alias("h1"), F.xxhash64(F.lit(1), whole).alias("h2")]


def _classes(side: DataFrame) -> DataFrame:
    """One row, the smallest id, for all records of one side with equal features, and their number n; all tokens but the core's as hashes."""
    codes = lambda c: F.transform(c, lambda t: F.hash(t)).alias(c)
    coded = F.struct("id", "core", codes("kind"), codes("unknown"), F.transform("facts", lambda t: F.xxhash64(t)).alias("facts"), codes("words"), "subject", "klass")
    return side.groupBy(*_hash()).agg(F.min_by(coded, "id").alias("v"), F.count(F.lit(1)).alias("n")).select("v.*", "n", "h1", "h2")


def compare(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The levels of agreement of the pairs l, r, times that share a title key or two rare description tokens."""
    read = ["core", "kind", "facts", "words", "subject", "klass", "n"]
    joined = pairs.join(left.select(F.col("id").alias("l"), F.struct(*read).alias("lf")), "l").join(right.select(F.col("id").alias("r"), F.struct(*read, "unknown").alias("rf")), "r")
    return cut(joined.select(F.col("l").alias("left_id"), F.col("r").alias("right_id"), F.greatest("times", "lf.n").alias("times"), F.col("rf.n").alias("n_right"), F.col("lf").alias("l"), F.col("rf").alias("r")).select("left_id", "right_id", "times", "n_right", *_compare()).where((F.col("core") < 2) | (F.col("shared") > 1)).drop("shared"))


def decide(compared: DataFrame, least: float) -> DataFrame | None:
    """The best left record of each right one with its confidence, where that is at least ``least``."""
    spark, names = compared.sparkSession, list(LEVELS)
    table = compared.groupBy(*names).agg(F.sum(F.col("times") * F.col("n_right")).alias("count")).orderBy(*names).collect()
    if not table:
        return None
    patterns, counts = np.array([[r[c] for c in names] for r in table]), np.array([r["count"] for r in table], float)
    post = estimate(patterns, counts)
    scored = spark.createDataFrame([(*map(int, p), float(x / max(1e-12, 1 - x))) for p, x in zip(patterns, post)], ", ".join(f"{c} int" for c in names) + ", odds double")
    withal = compared.join(F.broadcast(scored), names)  # one row per pattern: at most the product of the levels
    mine = Window.partitionBy("right_id")
    ranked = withal.withColumn("confidence", F.col("odds") / (1 + F.sum(F.col("odds") * F.col("times")).over(mine))).withColumn("_n", F.row_number().over(mine.orderBy(F.desc("odds"), "left_id")))
    return ranked.where((F.col("_n") == 1) & (F.col("times") == 1) & (F.col("confidence") >= least)).select("left_id", "right_id", "n_right", "confidence", *names)
