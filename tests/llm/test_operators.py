"""The training-data operators against brute force and on edge cases."""

import base64
import itertools
import json
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rajut.llm import abuse, chunking, consensus, containment, format_duplicates, linkage, mixing, notebook, vector_forest


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


# 1: neighbours ----------------------------------------------------------------


def brute(vecs, k, least):
    ids = sorted(vecs)
    u = {i: np.array(vecs[i]) / np.linalg.norm(vecs[i]) for i in ids}
    out = {}
    for i in ids:
        sims = sorted(((-float(u[i] @ u[j]), j) for j in ids if j != i))
        out[i] = [j for s, j in sims if -s >= least][:k]
    return out


def cloud(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 12), dim))
    return {i: (centres[i % len(centres)] + 0.35 * rng.normal(size=dim)).tolist() for i in range(n)}


def test_neighbours_recall_and_parts(spark):
    vecs = cloud(900, 16, 3)
    df = spark.createDataFrame(list(vecs.items()), "id long, vec array<double>")
    want = brute(vecs, 5, 0.6)
    for kw in ({}, {"leaf_size": 40, "search_k": 250, "block": 25, "sample_rows": 400}):
        got = {}
        for r in vector_forest.neighbours(df, 5, 0.6, **kw).collect():
            got.setdefault(r["id"], set()).add(r["other"])
        hit = sum(len(got.get(i, set()) & set(w)) for i, w in want.items())
        assert hit / sum(map(len, want.values())) >= (0.9 if kw else 1.0)


def test_equal_vectors_and_repeated_rows(spark):
    rows = [(i, [1.0, 2.0]) for i in range(9)] + [(20, [2.0, 1.0]), (20, [2.0, 1.0]), (21, [-1.0, -2.0])]
    got = vector_forest.neighbours(spark.createDataFrame(rows, "id long, vec array<double>"), k=3, least=0.5)
    by = {}
    for r in got.orderBy("id", "rank").collect():
        by.setdefault(r["id"], []).append((r["other"], round(r["sim"], 3)))
    assert by[0] == [(1, 1.0), (2, 1.0), (3, 1.0)] and by[8] == [(0, 1.0), (1, 1.0), (2, 1.0)]
    assert by[20] == [(0, 0.8), (1, 0.8), (2, 0.8)] and 21 not in by


def test_usable_vectors(spark):
    bad = [(1, None), (2, [1.0]), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1e300, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 0.1) for i, v in bad], "key long, e array<double>, id string, vec double")
    assert [r["id"] for r in vector_forest.usable(df, "key", "e", 2).collect()] == [7]
    assert vector_forest.neighbours(vector_forest.usable(df.where("key < 3"), "key", "e", 2)).count() == 0


# 3: format duplicates ---------------------------------------------------------


def test_records_in_any_format(spark):
    base = {"name": "Gaya Berat", "description": "A, b.", "formula": ["F = m × g"], "variables": [], "kondisi": ["x"]}
    forms = [json.dumps(base), json.dumps(dict(reversed(base.items())), indent=1), json.dumps(base | {"name": "  gaya BERAT!"}), json.dumps(base | {"description": "café"}), json.dumps(base | {"description": "café"}, ensure_ascii=False).upper().replace("NAME", "name").replace("DESCRIPTION", "description").replace("FORMULA", "formula").replace("VARIABLES", "variables").replace("KONDISI", "kondisi"), json.dumps(base | {"formula": ["F = m", "× g"]}), "no json", "no json ", None, ""]
    rows = [(10 + i, f, 1) for i, f in enumerate(forms)] + [(10, forms[0], 1), (5, forms[0], 2), (None, forms[0], 3)]
    df = spark.createDataFrame(rows, "sub long, record string, keep_id int")
    groups, members = format_duplicates.collapse_records(df, "sub", "record")
    assert tuples(members) == [(5, 10), (5, 11), (5, 12), (13, 14), (16, 17), (18, 19)] or tuples(members) == [(5, 10), (5, 11), (5, 12), (13, 14), (18, 19)]
    assert {r["keep_id"]: r["n_copies"] for r in groups.collect()}[5] == 4


@pytest.mark.parametrize("seed", [1, 2])
def test_copies_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        name = "hot" if rng.random() < 0.35 else f"n{rng.randrange(40)}"
        name = "".join(rng.choice((c.upper(), c, c + " ", c + "-")) for c in name)
        rows.append((i, name, rng.choice((None, "", "d1", "D 1", "d2"))))
    key = lambda s: "".join(c for c in (s or "").lower() if c.isalnum())
    least = {}
    for i, a, b in rows:
        least.setdefault((key(a), key(b)), i)
    want = sorted((least[key(a), key(b)], i) for i, a, b in rows if least[key(a), key(b)] != i)
    df = spark.createDataFrame(rows, "id long, name string, canon string")
    groups, members = format_duplicates.collapse(df, "id", ["name", "canon"], [F.col("name"), F.col("canon")])
    assert tuples(members) == want
    assert groups.count() == len(least) and groups.agg(F.sum("n_copies")).first()[0] == 300


def test_no_records(spark):
    df = spark.createDataFrame([], "id long, name string")
    groups, members = format_duplicates.collapse(df, "id", ["name"], [F.col("name")])
    assert groups.count() == 0 and members.count() == 0


# 4: chunking ------------------------------------------------------------------


def check_pieces(text, limit, overlap):
    n = len(re.findall(r"[^ \t\r\n]+", text))
    got = chunking.pieces_of(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == n
    for a, b, size, _, _, piece in got:
        assert size == b - a <= limit and size == len(re.findall(r"[^ \t\r\n]+", piece))
    for (_, b0, *_), (a1, b1, _, lap, *_) in itertools.pairwise(got):
        assert 0 <= b0 - a1 == lap <= overlap and b1 > b0
    return got


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["kata", "akhir.", "Dr.", "tanya?", "1.", "\n", "\n\n", "x" * 50]), min_size=1, max_size=200), st.integers(5, 40), st.integers(0, 4))
def test_pieces_cover_the_text(words, limit, overlap):
    text = " ".join(words)
    if text.strip():
        check_pieces(text, limit, overlap)


def test_least_cost_against_all_cuttings():
    rng = random.Random(5)
    for _ in range(30):
        kind = np.array([rng.choice((0, 1, 2)) for _ in range(14)], np.int8)
        kind[-1] = 0
        limit, n = 6, 14
        count = math.ceil(n / limit)
        even = n / count

        def cost(cuts):
            ends = [*cuts, n]
            starts = [0, *cuts]
            if any(b - a > limit for a, b in zip(starts, ends)):
                return math.inf
            return sum(chunking.BALANCE * ((b - a - even) / even) ** 2 for a, b in zip(starts, ends)) + sum(chunking.COST[kind[c - 1]] for c in cuts)

        best = min(cost(c) for r in range(n) for c in itertools.combinations(range(1, n), r))
        got = chunking.split_positions(kind, limit, 0)
        assert math.isclose(cost([b for _, b in got[:-1]]), best)


def test_pieces_end_at_natural_boundaries():
    text = "\n\n".join(" ".join(f"kata{i}" for i in range(90)) + "." for _ in range(30))
    assert {p[4] for p in check_pieces(text, 800, 200)} == {"paragraph", "end"}
    assert {p[4] for p in check_pieces("kata " * 2500, 800, 200)} == {"word", "end"}


def test_split_texts_edge_cases(spark):
    rows = [(1, None, 0), (2, " \n", 0), (3, "dua kata", 0), (3, "dua kata", 0), (4, "kata. " * 30000, 0), (5, "x" * 100000, 0), (None, "a", 0), (6, "a b c", 0)]
    got = chunking.split_texts(spark.createDataFrame(rows, "id long, t string, piece int"), "id", "t")
    by = {r["text_id"]: r for r in got.groupBy("text_id").agg(F.count(F.lit(1)).alias("n"), F.max("n_words").alias("m"), F.max("end_word").alias("e")).collect()}
    assert set(by) == {3, 4, 5, 6} and by[3]["n"] == 1 and by[4]["e"] == 30000 and by[4]["m"] <= 800 and by[6]["e"] == 2
    assert chunking.split_texts(spark.createDataFrame([], "id long, t string"), "id", "t").count() == 0


# 5: linkage -------------------------------------------------------------------


def test_linkage_finds_reworded_records(spark):
    rng = random.Random(4)
    syll = [a + b for a in "bcdfgjklmnprst" for b in ("a", "i", "u", "e", "o")]
    name = lambda: "".join(rng.choice(syll) for _ in range(4))
    kinds, quals, grades = ["Gaya", "Medan", "Energi", "Sel"], ["jenuh", "aktif", "pasif"], ["Fisika Kelas X", "Kimia Kelas XI", "Biologi Kelas XII"]
    left, right, truth = [], [], set()
    for i in range(240):
        core, kind, q, grade, w1, w2, n1 = name(), rng.choice(kinds), rng.choice(quals), rng.choice(grades), name(), name(), rng.randrange(1000)
        left.append((i, f"{kind} {core} {q}", f"{kind} {core} {q} menghasilkan {w1} setelah {n1} volt serta memerlukan {w2} sebagai pemicu.", grade))
        if i % 3 == 0:
            typo = core[:3] + core[4:]
            title = rng.choice((f"{core} {q}, {kind}".upper(), f"{kind} {typo} {q}", f"{kind} {core} {q} (pengantar)"))
            level = rng.choice((None, grade, grade.split()[0][:3].upper() + "-" + {"X": "10", "XI": "11", "XII": "12"}[grade.split()[-1]]))
            right.append((1000 + i, title, f"sesudah {n1} volt terbentuk {w1}; dipicu oleh {w2}.", level))
            truth.add((i, 1000 + i))
        elif i % 3 == 1:  # the same title in another grade with other facts is another concept
            right.append((1000 + i, f"{kind} {core} {q}", f"sesudah {rng.randrange(1000)} volt terbentuk {name()}; dipicu oleh {name()}.", rng.choice([g for g in grades if g != grade])))
    cols = "id long, title string, body string, grade string"
    out = linkage.link(spark.createDataFrame(left + left[:5], cols), spark.createDataFrame(right, cols), ("id", "title", "body", "grade"), ("id", "title", "body", "grade"))
    got = {(r["left_id"], r["right_id"]) for r in out.collect()}
    assert len(got & truth) / len(truth) > 0.95 and len(got & truth) / len(got) > 0.95
    assert out.where((F.col("confidence") < 0.5) | (F.col("confidence") > 1)).count() == 0


def test_linkage_edge_cases(spark):
    cols = "id long, title string, body string, grade string"
    some = spark.createDataFrame([(1, None, None, None), (2, "", " ", ""), (3, "Gaya " + "x" * 5000, "kata " * 3000, "X"), (None, "a", "b", "c")], cols)
    names = ("id", "title", "body", "grade")
    assert linkage.link(some, spark.createDataFrame([], cols), names, names).count() == 0
    linkage.link(some, some, names, names).collect()


SIDE = "id long, core array<string>, kind array<string>, facts array<string>, subject string, klass int"


def test_crowded_keys_stay_linear_and_keep_the_pairs_that_can_be_told_apart(spark):
    n = 2000  # one core token in all records of both sides; each record shares a description token with its like
    left = [(i, ["energi"], ["gaya"], [f"f{i}", f"g{i % 40}"], "fis", 10 + i % 3) for i in range(n)]
    right = [(10_000 + i, ["energi" if i % 2 else "enrgi"], ["gaya"], [f"f{i}", f"g{i % 40}"] if i % 3 else [f"g{i % 40}"], None, None) for i in range(n)]
    got = [tuple(r) for r in linkage.candidates(spark.createDataFrame(left, SIDE), spark.createDataFrame(right, SIDE)).collect()]
    assert {(i, 10_000 + i, 1) for i in range(n) if i % 3} <= set(got)
    assert len(got) < 20 * n and len({g[:2] for g in got}) == len(got)


def test_bare_records_of_a_crowded_key_cost_no_product(spark):
    side = spark.createDataFrame([(i, ["energi"], ["gaya"], [], "fis", 10) for i in range(400)], SIDE)
    got = [tuple(r) for r in linkage.candidates(side, side).collect()]
    assert got and {g[0] for g in got} == {0} and {g[2] for g in got} == {400} and len(got) == 400


def test_few_left_records_meet_all_right_records_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(linkage, "PART", 25)
    left = [(i, [], ["gaya", "medan"], ["langka"], "fis", 10) for i in range(3)]
    right = [(100 + i, [], ["medan", "gaya"], ["langka"] if i % 2 else [], *((None, None), ("kim", 11), ("fis", None))[i % 3]) for i in range(60)]
    got = [tuple(r)[:2] for r in linkage.candidates(spark.createDataFrame(left, SIDE), spark.createDataFrame(right, SIDE)).collect()]
    assert sorted(got) == [(i, 100 + j) for i in range(3) for j in range(60)]


@pytest.mark.parametrize("few", [1, 4])
def test_links_against_all_pairs(spark, monkeypatch, few):
    """Blocking with keys that are soon crowded finds the links that a comparison of all pairs finds."""
    monkeypatch.setattr(linkage, "FEW", few)
    rng = random.Random(few)
    words = [f"istilah{chr(97 + i)}" for i in range(12)]
    rows = [(i, [rng.choice(words)], [rng.choice(("gaya", "medan", "sel"))], [], [f"f{x}" for x in sorted(rng.sample(range(60), 3))], ["kata"], rng.choice(("fis", "kim")), rng.choice((10, 11, 12))) for i in range(150)]
    cols = "id long, core array<string>, kind array<string>, unknown array<string>, facts array<string>, words array<string>, subject string, klass int"
    a = linkage._classes(spark.createDataFrame(rows, cols))
    other = [(1000 + i, c, k, u, f if i % 4 else f[:2], w, s if i % 3 else None, x if i % 5 else 10) for i, c, k, u, f, w, s, x in rows[:100]]
    b = linkage._classes(spark.createDataFrame(other, cols))
    pairs = lambda df: {(r["left_id"], r["right_id"]) for r in linkage.decide(df, 0.5).collect()}
    every = a.select(F.col("id").alias("l")).crossJoin(b.select(F.col("id").alias("r"))).withColumn("times", F.lit(1).cast("long"))
    want, got = pairs(linkage.compare(every, a, b)), pairs(linkage.compare(linkage.candidates(a, b), a, b))
    assert len(want) > 60 and len(got & want) >= 0.95 * len(want)


def test_equal_right_records_all_get_their_pair(spark):
    cols = "id long, title string, body string, grade string"
    left = [(i, f"Gaya nama{chr(97 + i)}", f"isi{i} dan itu{i} lalu nol{i}", "Fisika Kelas X") for i in range(20)]
    right = [(100 + 20 * k + i, *r[1:]) for k in range(2) for i, r in enumerate(left)]
    names = ("id", "title", "body", "grade")
    got = linkage.link(spark.createDataFrame(left, cols), spark.createDataFrame(right, cols), names, names)
    assert {(r["left_id"], r["right_id"]) for r in got.collect()} == {(i, 100 + 20 * k + i) for k in range(2) for i in range(20)}


# 6: consensus -----------------------------------------------------------------


def reviews(seed, n_items=400, n_good=8, n_bad=4):
    rng = random.Random(seed)
    truth = {i: rng.choices(consensus.LABELS, (6, 2, 2, 1, 1))[0] for i in range(n_items)}
    cast = []
    for i, t in truth.items():
        for w in rng.sample(range(n_good + n_bad), 4):
            right = rng.random() < (0.85 if w < n_good else 0.2)
            cast.append((i, f"w{w:02d}", t if right else rng.choice(consensus.LABELS)))
    return truth, cast


def majority(cast):
    by = {}
    for i, _, lab in cast:
        by.setdefault(i, []).append(lab)
    return {i: max(consensus.LABELS, key=labs.count) for i, labs in by.items()}


def test_consensus_beats_the_majority_and_finds_bad_annotators(spark):
    truth, cast = reviews(1)
    items = spark.createDataFrame([(i, "g", None) for i in truth], "item long, grp string, known string")
    votes = spark.createDataFrame(cast, "item long, who string, label string")
    out, people = consensus.infer(items, votes)
    got = {r["item"]: r["label"] for r in out.collect()}
    right = sum(got[i] == t for i, t in truth.items())
    assert right > sum(majority(cast)[i] == t for i, t in truth.items()) and right / len(truth) > 0.88
    rel = {r["who"]: r["reliability"] for r in people.collect()}
    assert min(rel[f"w{w:02d}"] for w in range(8)) > max(rel[f"w{w:02d}"] for w in range(8, 12))


@pytest.mark.parametrize("rounds, hot, stop", [(3, 100_000, 1e-4), (12, 20, 0.02)])
def test_rounds_with_joins_equal_rounds_with_a_broadcast(spark, monkeypatch, rounds, hot, stop):
    monkeypatch.setattr(consensus, "HOT_VOTES", hot)
    monkeypatch.setattr(consensus, "STOP", stop)
    truth, cast = reviews(2, n_items=150)
    items = spark.createDataFrame([(i, "gh"[i % 2], t if i % 9 == 0 else None) for i, t in truth.items()], "item long, grp string, known string")
    votes = spark.createDataFrame(cast, "item long, who string, label string")
    a, some = consensus.infer(items, votes, rounds=rounds)
    b, people = consensus.infer(items, votes, rounds=rounds, max_annotators=0)
    x, y = ({r["item"]: r for r in df.collect()} for df in (a, b))
    assert all(x[i]["label"] == y[i]["label"] and abs(x[i]["confidence"] - y[i]["confidence"]) < 1e-6 and x[i]["agreement"] == y[i]["agreement"] for i in truth)
    u, v = ({r["who"]: r for r in df.collect()} for df in (some, people))
    assert len(u) == 12 and u.keys() == v.keys()
    assert all(abs(u[w]["reliability"] - v[w]["reliability"]) < 1e-6 and (u[w]["n_votes"], u[w]["kind"]) == (v[w]["n_votes"], v[w]["kind"]) for w in u)


def test_consensus_edge_cases(spark):
    items = spark.createDataFrame([(1, "g", "wrong"), (2, "g", None), (3, None, None), (3, None, None), (None, "g", None)], "item long, grp string, known string")
    votes = spark.createDataFrame([(1, "a", "correct"), (2, "a", "partial"), (2, "b", None), (9, "a", "wrong"), (2, None, "wrong"), (2, "c", "apa")], "item long, who string, label string")
    out, people = consensus.infer(items, votes)
    got = {r["item"]: r for r in out.collect()}
    assert set(got) == {1, 2, 3} and got[1]["label"] == "wrong" and got[3]["n_votes"] == 0 and got[3]["agreement"] is None
    assert people.count() == 1
    empty = consensus.infer(items.where("item > 99"), votes.where("item > 99"))
    assert empty[0].count() == 0 and empty[1].count() == 0
    alone = consensus.infer(items, votes.where("item > 99"))[0]
    assert alone.count() == 3


def test_votes_of_the_latest_submission(spark):
    kind = "validation_id long, reviewer string, batch_id long, ratings map<string,string>, missing_triples array<struct<chapter:string,subject:string,relation:string,target:string,description:string>>, updated_at timestamp"
    from datetime import datetime as dt

    m = [("Bab  1", "a", "R", "T", "")]
    ev = spark.createDataFrame([(1, "x", 1, {"007": "Correct", "8": "??"}, [], dt(2024, 1, 1)), (2, "x", 1, {" 7.0": "skip "}, m, dt(2024, 1, 2)), (2, "x", 1, {" 7.0": "skip "}, m, dt(2024, 1, 2)), (3, "y", 1, None, None, None)], kind)
    tr = spark.createDataFrame([(7, "c", "s", "r", "t"), (9, "BAB 1 ", " A", "r", "t")], "triple_id long, chapter string, subject string, relation string, target string")
    assert tuples(consensus.votes(ev, tr).select("triple_id", "reviewer", "label")) == [(7, "x", "abaikan"), (9, "x", "missing")]


# 7: containment ---------------------------------------------------------------

ITEM = "satu dua tiga empat lima enam tujuh delapan sembilan sepuluh sebelas dua belas tiga belas"


def test_leaks_in_all_layouts(spark):
    w = ITEM.split()
    passage = ", ".join(w[1:13]).upper()
    book = json.dumps({"cells": [{"cell_type": "code", "source": ["x = 1\n", " ".join(w[:6]) + "\n", " ".join(w[6:12])], "outputs": [{"text": ["ok"]}]}, {"cell_type": "code", "source": "y", "outputs": [{"data": {"text/plain": [passage]}}, {"traceback": [passage]}]}]})
    split = f"# %% a\n{' '.join(w[:8])}\n# %% b\n{' '.join(w[8:])}"
    docs = [(1000, passage, None), (1001, "# %%\n" + passage, "percent"), (1002, "a\n```\n" + passage + "\n```\n", "fenced"), (1003, book, "json"), (1004, split, "percent"), (1005, " ".join(w[:11]), None), (1006, None, "json"), (1007, "", "fenced"), (1008, "{broken " + passage, "json"), (1009, " ".join(reversed(w)), None), (1000, passage, None), (1010, ("kata " * 5 + "\n") * 3000 + passage, "percent")]
    df = spark.createDataFrame(docs, "doc long, item_id string, layout string")
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, "terlalu pendek"), (3, None)], "i long, t string")
    got = containment.leaked(df, "doc", "item_id", "layout", items, "i", "t")
    assert sorted(r["doc_id"] for r in got.collect()) == [1000, 1001, 1002, 1003, 1008, 1010]
    assert containment.leaked(df, "doc", "item_id", "layout", items.where("i > 9"), "i", "t").count() == 0
    assert containment.leaked(df.where("doc > 9999"), "doc", "item_id", "layout", items, "i", "t").count() == 0
    blocks = containment.leaked(df, "doc", "item_id", "layout", items, "i", "t", item_block=1)
    assert tuples(blocks) == tuples(got)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_leaks_against_brute_force(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(8, 40)))) for i in range(30)]
    index = containment.Index(items, 12)
    for _ in range(40):
        doc: list[str] = []
        while len(doc) < rng.choice((30, 200, 1500)):
            _, text = rng.choice(items)
            a = rng.randrange(30)
            doc += text.split()[a : a + rng.randrange(9, 16)] + rng.choices([*vocab, "lain"], k=rng.randrange(4))
        grams = {tuple(doc[i : i + 12]) for i in range(len(doc) - 11)}
        want = {i: {a for a in range(len(t.split()) - 11) if tuple(t.split()[a : a + 12]) in grams} for i, t in items}
        got = {index.items[n][0]: s for n, (s, _) in index.search([[" ".join(doc)]])[0].items()}
        assert got == {i: s for i, s in want.items() if s}


def test_leaks_of_long_and_repetitive_items():
    rng = random.Random(5)
    long = [f"w{rng.randrange(400)}" for _ in range(500)]
    items = [(1, " ".join(long)), (2, "a " * 60), (3, "satu dua " * 8), (4, "x y " * 5)]
    index = containment.Index(items, 12)
    assert [b for b, _, _ in index.tables] == [index.bands[0], index.bands[2]]
    docs = [[" ".join(long[a : a + 12])] for a in range(0, 489, 7)] + [["lain " + "a " * 12], ["a " * 11], ["satu dua " * 6 + "tiga"], [" ".join(long[100:300]), " ".join(long[300:311])]]
    got = [{index.items[n][0]: s for n, (s, _) in hits.items()} for hits in index.search(docs)]
    assert got[:70] == [{1: {a}} for a in range(0, 489, 7)]
    assert got[70:] == [{2: set(range(49))}, {}, {3: {0, 2, 4}}, {1: set(range(100, 289))}]


def test_notebook_cells():
    assert notebook.cells(None, "json") == [] and notebook.cells("x", "apa") == ["x"]
    assert notebook.cells('{"cells": 3}', "json") == []
    assert notebook.cells('[1]', "json") == ["[1]"]


# 8: mixing --------------------------------------------------------------------


def test_shares_are_reached_within_the_limits(spark):
    rng = random.Random(2)
    sources = {"big": 3000, "mid": 600, "tiny": 60}
    rows = [(i, s, int(rng.lognormvariate(5, 1)) + 1) for i, s in enumerate(s for s, n in sources.items() for _ in range(n))] + [(99999, None, 5), (99998, "other", 5)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    weights = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.2, 3), ("absent", 0.0, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    p = mixing.plan(sizes, weights)
    got = mixing.sample(sizes, p)
    report = {r["source"]: r for r in mixing.shares(got, p).collect()}
    assert set(report) == {"big", "mid", "tiny"}
    for s in report.values():
        assert abs(s["actual_share"] - s["target_share"]) < 0.02 and s["most_repeats"] <= s["max_repeats"]
    assert report["tiny"]["most_repeats"] == 3 and report["tiny"]["docs_used"] == 60
    copies = {r["doc_id"]: r["copies"] for r in got.collect()}
    expected = {r["source"]: r["expected"] / mixing.UNIT for r in p.collect()}
    for i, s, _ in rows:
        if s in expected:
            assert copies.get(i, 0) in (math.floor(expected[s]), math.ceil(expected[s]))


def test_prefix_sums_against_one_pass(spark):
    rows = [(i, "s", i % 50 + 1) for i in range(500)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    p = mixing.plan(sizes, spark.createDataFrame([("s", 1.0, 5)], "source string, target_share double, max_repeats int"), total_tokens=20_000)
    total = mixing.sample(sizes, p).agg(F.sum("copies")).first()[0]
    assert abs(total - 500 * p.first()["expected"] / mixing.UNIT) <= 1


def test_mixing_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a", 3), (2, "", "a", 3), (3, "satu dua <|endoftext|>", "a", 3), (3, "satu dua <|endoftext|>", "a", 3), (4, "x" * 20000, "b", 3), (None, "x", "a", 3)], "id long, text string, src string, n_tokens int")
    sizes = mixing.sized(docs, "id", "text", "src")
    got = {r["doc_id"]: r["n_tokens"] for r in sizes.collect()}
    assert got[1] == 0 and got[2] == 0 and got[3] > 3 and set(got) == {1, 2, 3, 4}
    weights = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2), ("c", 0.1, 1)], "source string, target_share double, max_repeats int")
    p = mixing.plan(sizes.limit(0), weights)
    assert mixing.sample(sizes.limit(0), p).count() == 0 and mixing.shares(mixing.sample(sizes.limit(0), p), p).count() == 3


# 9: abuse ---------------------------------------------------------------------


@pytest.mark.parametrize("raw, want", [("y0u are a b@5tard", "you are a bastard"), ("s-h-u-t up", "shut up"), ("m u l u t busuk", "mulut busuk"), ("tolollll", "tolol"), ("mo​ther", "mother"), ("dasar_bangsat_pergi", "dasar bangsat pergi"), ("n.u.d.e.s", "nudes"), ("99 0.5", "")])
def test_disguised_words(raw, want):
    assert abuse.words_of(raw) == want.split()


def test_long_runs_without_white_space_are_read():
    cells = "".join(f"<td>kata{chr(97 + i % 26)}</td>" for i in range(60))
    found = abuse.words_of(f"kamu goblok<table>{cells}<td>tolol</td></table>")
    assert found[:3] == ["kamu", "goblok", "table"] and "tolol" in found and found.count("td") == 122
    assert "idiot" in abuse.words_of("/".join(["jalan", "idiot"] * 60))
    assert abuse.words_of("go" + "b" * 60 + "lok b" + "@" * 60 + "stard") == ["goblok", "bastard"]
    coded = base64.b64encode(random.Random(1).randbytes(3000)).decode()
    assert abuse.words_of(f"data:image/png;base64,{coded}") == ["data", "image", "png", "base6a"]
    scorer = abuse.Scorer({"tolol": 6.0}, -4.0)
    assert scorer.passage(f"<table>{cells}<td>tolol</td></table>") > 0.5


def test_masked_vowels_share_a_skeleton():
    assert [abuse.skeleton(w) for w in ("f*lthy", "filthy")] == ["flthy"] * 2
    assert abuse.skeleton("aku") == "k" and abuse.skeleton("a") == "a"


def labelled(seed, n=260):
    rng = random.Random(seed)
    bad = ["kamu memang {} sekali dasar {}", "pergi sana {} busuk", "semua orang {} harus diusir"]
    words, noise = ["tolol", "goblok", "xarvak", "mebrin"], [f"kata{i}" for i in range(200)]
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        lines = [" ".join(rng.choices(noise, k=6)) for _ in range(rng.randrange(3, 9))] + ["kamu memang rajin sekali hari ini"] * (rng.random() < 0.3)
        if y:
            lines.insert(rng.randrange(len(lines)), rng.choice(bad).replace("{}", rng.choice(words)))
        rows.append((i, "# %%\n" + "\n".join(lines), "percent", "s", y))
    return rows


def test_held_out_accuracy_and_located_passages(spark):
    rows = labelled(1)
    df = spark.createDataFrame(rows, "doc long, text string, layout string, source string, toxic int")
    scorer = abuse.train(df, df.where("doc < 200").select("doc", "toxic"), "doc", "text", "layout", "doc", "toxic")
    got = {r["doc_id"]: r for r in abuse.score(df, scorer, "doc", "text", "layout", "source").collect()}
    test = [(got[i]["score"] >= abuse.THRESHOLD, y) for i, _, _, _, y in rows if i >= 200]
    assert sum(p == y for p, y in test) / len(test) > 0.93
    assert all("kata" not in got[i]["passage"] for i, _, _, _, y in rows if y and got[i]["score"] >= 0.8)


def test_abuse_edge_cases(spark):
    rows = [(1, None, "json", None), (2, "", None, "s"), (3, "x" * 100_000, "percent", "s"), (4, "kamu goblok", "percent", "s"), (4, "kamu goblok", "percent", "s"), (None, "goblok", "percent", "s")]
    df = spark.createDataFrame(rows, "doc long, score string, layout string, source string")
    none = spark.createDataFrame([], "doc long, toxic int")
    with pytest.warns(UserWarning, match="not fitted"):
        scorer = abuse.train(df, none, "doc", "score", "layout", "doc", "toxic")
    assert not any(r["fitted"] for r in abuse.score(df, scorer, "doc", "score", "layout", "source").collect())
    got = {r["doc_id"]: r["score"] for r in abuse.score(df, scorer, "doc", "score", "layout", "source").collect()}
    assert set(got) == {1, 2, 3, 4} and got[4] > 0.5 and max(got[i] for i in (1, 2, 3)) == 0
    one_class = spark.createDataFrame([(4, 1), (4, None), (77, 0), (None, 1)], "doc long, toxic int")
    with pytest.warns(UserWarning, match="class 0"):
        assert not abuse.train(df, one_class, "doc", "score", "layout", "doc", "toxic").fitted


def test_positives_beyond_the_bound_leave_room_for_negatives(spark):
    rows = [(i, "# %%\nkata satu dua\n" + ("kamu zorblim sekali" if i < 120 else "kamu rajin sekali"), "percent", "s", int(i < 120)) for i in range(240)]
    df = spark.createDataFrame(rows, "doc long, text string, layout string, source string, toxic int")
    scorer = abuse.train(df, df.select("doc", "toxic"), "doc", "text", "layout", "doc", "toxic", max_labelled=60)
    got = abuse.score(df, scorer, "doc", "text", "layout", "source").where(F.col("score") >= abuse.THRESHOLD)
    assert scorer.fitted and {r["doc_id"] for r in got.collect()} == set(range(120))


def test_labels_in_many_partitions(spark):
    rows = [(i, "# %%\n" + ("kamu zorblim sekali" if i < 40 else f"k{i} l{i} m{i}"), "percent", "s", int(i < 40)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc long, text string, layout string, source string, toxic int").repartitionByRange(200, "doc")
    scorer = abuse.train(df, df.select("doc", "toxic"), "doc", "text", "layout", "doc", "toxic")
    assert abuse.score(df, scorer, "doc", "text", "layout", "source").where(F.col("score") >= abuse.THRESHOLD).count() == 40


def test_each_of_many_groups_has_its_own_label_shares(spark, monkeypatch):
    monkeypatch.setattr(consensus, "MAX_GROUPS", 2)
    rows = [(i, f"g{i % 5}", consensus.LABELS[i % 5] if i < 60 else None) for i in range(70)]
    items = spark.createDataFrame(rows, "item long, grp string, known string")
    votes = spark.createDataFrame([(i, w, consensus.LABELS[i % 5]) for i in range(20) for w in ("a", "b")], "item long, who string, label string")
    out, _ = consensus.infer(items, votes, rounds=3)
    assert {r["item"]: r["label"] for r in out.collect()} == {i: consensus.LABELS[i % 5] for i in range(70)}


def test_small_groups_are_pooled(spark, monkeypatch):
    monkeypatch.setattr(consensus, "MAX_GROUPS", 2)
    items = spark.createDataFrame([(i, f"g{i % 5}" if i % 2 else "big", None) for i in range(40)], "item long, grp string, known string")
    votes = spark.createDataFrame([(i, w, "wrong") for i in range(40) for w in ("a", "b")], "item long, who string, label string")
    for kw in ({}, {"max_annotators": 0, "rounds": 2}):
        out, _ = consensus.infer(items, votes, **kw)
        assert {r["label"] for r in out.collect()} == {"wrong"} and out.count() == 40
