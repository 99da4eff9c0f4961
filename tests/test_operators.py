"""Operators on inline rows: edge cases, published values and properties."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rajut.functions import normalize as n
from rajut.functions import scalars as x
from rajut.functions import vocab
from rajut.operators import agreement as g
from rajut.operators import graph, joins, models, skew, upsert, vector
from rajut.sources import files

EDGE = "src_grade string, src string, tgt_grade string, tgt string, rel_type string, confidence double, rel_id long"


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr("v").alias("r")).first()["r"]


@pytest.mark.parametrize("raw, want", [("Skip ", "abaikan"), (None, "unknown"), (" CORRECT\n", "correct"), ("??", "unknown"), ("ignored", "abaikan")])
def test_rating_label(spark, raw, want):
    assert one(spark, n.rating_label, raw) == want


def test_loose_and_scored_labels(spark):
    assert one(spark, n.loose_label, None) == ""
    assert one(spark, n.loose_label, "Apa") == "apa"
    assert one(spark, n.scored_label, "skip") is None
    assert one(spark, n.scored_label, "Wrong") == "wrong"


@pytest.mark.parametrize("raw, num, key", [("0", 0, "0"), ("007", 7, "7"), ("12.0", None, "12"), ("abc", None, "abc"), (None, None, ""), ("000", 0, "0")])
def test_triple_ids(spark, raw, num, key):
    assert one(spark, n.triple_number, raw) == num
    assert one(spark, n.triple_key, raw) == key


@pytest.mark.parametrize("raw, want", [(None, "RELATED_TO"), ("  ", "RELATED_TO"), ("3x lebih besar", "REL_3X_LEBIH_BESAR"), ("a--b__c!", "A_B_C")])
def test_safe_relation(spark, raw, want):
    assert one(spark, n.safe_relation, raw) == want


def test_relation_types(spark):
    assert one(spark, n.relation_type, " bagian_dari ") == "BAGIAN_DARI"
    assert one(spark, n.relation_type, "mengandung") == "BAGIAN_DARI"
    assert one(spark, n.relation_type, "apa saja") is None
    assert one(spark, n.cross_type, None) == "LINTAS_BUKU"
    assert one(spark, n.cross_type, "LINTAS_BUKU_X") == "LINTAS_BUKU_X"
    assert one(spark, n.bare_type, "LINTAS_BUKU_X") == "X"


def test_blank_consensus_wins_over_status(spark):
    df = spark.createDataFrame([("", "wrong"), (None, "wrong"), ("wrong", None), (None, None)], "c string, s string")
    assert [r["k"] for r in df.select(n.not_wrong("c", "s").alias("k")).collect()] == [True, False, False, True]


@pytest.mark.parametrize("raw, want", [("xii", 12), ("12", 12), ("XIV", 14), ("abz", 0), ("mcmxciv", 1994)])
def test_page_number(spark, raw, want):
    assert one(spark, x.page_number, raw) == want


def test_variable(spark):
    f = lambda v: tuple(one(spark, x.variable, v))
    assert f("F (gaya, newton)") == ("F", "gaya", "newton")
    assert f("F (gaya)") == ("F", "gaya", None)
    assert f("hanya teks") == ("hanya teks", None, None)


def counts_frame(spark, both):
    """both: {(r1, r2): n}"""
    return spark.createDataFrame([(a, b) for (a, b), k in both.items() for _ in range(k)], "r1_rating string, r2_rating string")


def test_agreement_edges(spark):
    empty = g.gwet(spark.createDataFrame([], "r1_rating string, r2_rating string")).first()
    assert (empty["n"], empty["pa"], empty["pe"], empty["ac1"]) == (0, 0.0, 0.0, 0.0)
    r = g.gwet(counts_frame(spark, {("correct", "correct"): 10})).first()
    assert r["ac1"] == 1.0


@pytest.mark.parametrize("labels, extra, want", [((140, 6, 2, 3), 0, (0.952, 0.965, 0.958)), ((143, 6, 0, 2), 0, (0.970, 0.970, 0.970)), ((132, 7, 25, 2), 0, (0.819, 0.965, 0.886)), ((136, 6, 5, 19), 29, (0.866, 0.757, 0.808)), ((186, 40, 3, 11), 0, (0.870, 0.881, 0.875))])
def test_published_scores(spark, labels, extra, want):
    rows = [("s", lab, k) for lab, k in zip(("correct", "partial", "wrong", "missing"), labels)] + [("s", "added", extra)]
    r = g.graded_scores(spark.createDataFrame(rows, "course string, label string, weight int"), ["course"]).first()
    assert tuple(round(r[c], 3) for c in ("precision", "recall", "f1")) == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.tuples(st.sampled_from(vocab.SCORED_LABELS), st.sampled_from(vocab.SCORED_LABELS)), st.integers(1, 5), min_size=1))
def test_agreement_is_bounded(spark, both):
    r = g.gwet(counts_frame(spark, both)).first()
    assert -1 - 1e-9 <= r["ac1"] <= 1 + 1e-9
    assert 0 <= r["pa"] <= 1


def test_rated_by_one_is_unknown_and_never_agreed(spark):
    a = spark.createDataFrame([(1, "correct"), (2, "??")], "triple_id long, rating string")
    b = spark.createDataFrame([(2, None), (3, "wrong")], "triple_id long, rating string")
    got = {r["triple_id"]: (r["r1_rating"], r["r2_rating"], r["bucket"]) for r in g.split_agreed(g.align_raters(a, b)).collect()}
    assert got == {1: ("correct", "unknown", "ratings_disagreed_llm"), 2: ("unknown", "unknown", "ratings_disagreed_llm"), 3: ("unknown", "wrong", "ratings_disagreed_llm")}


def graph_of(spark, nodes, edges):
    return spark.createDataFrame(nodes, "grade string, name string"), spark.createDataFrame([(a, b, c, d, "MENGATUR", None, i) for i, (a, b, c, d) in enumerate(edges)], EDGE)


def test_degree_density_modularity(spark):
    nodes, edges = graph_of(spark, [("g", "a"), ("g", "b"), ("h", "c"), ("h", "alone")], [("g", "a", "g", "b"), ("g", "a", "g", "b"), ("g", "a", "g", "a"), ("g", "b", "h", "c")])
    assert {r["name"]: r["degree"] for r in graph.degrees(nodes, edges).collect()} == {"a": 3, "b": 3, "c": 1, "alone": 0}
    assert math.isclose(graph.density(nodes, edges).first()["density"], 4 / 12)
    assert math.isclose(graph.grade_modularity(edges).first()["modularity"], 3 / 4 - (4 * 3 + 0 * 1) / 16)
    none = edges.where(F.lit(False))
    assert graph.grade_modularity(none).first()["modularity"] == 0.0
    assert graph.density(nodes.where(F.lit(False)), none).first()["density"] == 0.0
    assert graph.average_degree(nodes.where(F.lit(False)), none).first()["average_degree"] == 0.0


def test_components_on_a_long_path_and_a_hub(spark):
    nodes = [("g", f"p{i:03d}") for i in range(60)] + [("g", f"h{i}") for i in range(30)] + [("g", "alone")]
    edges = [("g", f"p{i:03d}", "g", f"p{i + 1:03d}") for i in range(59)] + [("g", "h0", "g", f"h{i}") for i in range(1, 30)]
    got = graph.components(*graph_of(spark, nodes, edges)).groupBy("component").count().collect()
    assert sorted(r["count"] for r in got) == [1, 30, 60]


def test_communities_of_two_cliques(spark):
    edges = [("g", f"{c}{i}", "g", f"{c}{j}") for c in "ab" for i in range(5) for j in range(i)] + [("g", "a0", "g", "b0")]
    _, e = graph_of(spark, [("g", "x")], edges)
    for method, local in (("louvain", 10**6), ("greedy", 10**6), ("louvain", 3)):
        m = graph.communities(e, method, local)
        assert m.select("community").distinct().count() == 2
        assert graph.undirected_modularity(e, m).first()["modularity"] > 0.4


def test_longest_chain_with_a_cycle(spark):
    e = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "c", "a"), (4, "c", "d")], "edge_id long, u string, v string")
    r = graph.longest_chain(e).first()
    assert r["n_edges"] == 4 and r["chain"][-1] == "d"


def test_merge_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, o long, v string")
    new = spark.createDataFrame([("b", 3, "q"), ("b", 2, "p"), ("c", 1, "z")], "k string, o long, v string")
    once = upsert.merge(old, new, ["k"], "o")
    assert sorted(tuple(r) for r in once.collect()) == sorted(tuple(r) for r in upsert.merge(once, new, ["k"], "o").collect()) == [("a", 1, "x"), ("b", 3, "q"), ("c", 1, "z")]


def test_review_keeps_comments_and_overwrites_ratings(spark):
    kind = "k string, ratings map<string,string>, comments map<string,string>"
    old = spark.createDataFrame([("t", {"1": "correct", "2": " "}, {"1": "old", "2": ""})], kind)
    new = spark.createDataFrame([("t", {"1": "wrong"}, {"1": "new", "2": "two"})], kind)
    r = upsert.review(old, new, "k").first()
    assert r["ratings"] == {"1": "wrong", "2": " "} and r["comments"] == {"1": "old", "2": "two"} and r["n_reviewers"] == 1


def test_neighbours_of_the_same_group_use_up_places(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "g"), (2, [0.99, 0.1], "g"), (3, [0.9, 0.4], "h"), (4, [0.0, 1.0], None)], "id long, vec array<double>, grp string")
    got = vector.candidate_pairs(vector.block_knn(v, v, 2), v, 0.5)
    assert [(r["source"], r["target"]) for r in got.collect()] == [(3, 2)]
    wide = vector.candidate_pairs(vector.block_knn(v, v, 3), v, 0.5)
    assert sorted((r["source"], r["target"]) for r in wide.collect()) == [(1, 3), (2, 3)]
    assert vector.block_knn(v, v, 1).where("q <> id").count() == 0


def test_known_pairs_are_left_out_in_either_direction(spark):
    p = spark.createDataFrame([(1, 2), (1, 3), (4, 1)], "source long, target long")
    t = spark.createDataFrame([(2, 1, "MENGATUR"), (1, 3, "SIMILAR_TO")], "source long, target long, rel_type string")
    assert sorted((r["source"], r["target"]) for r in vector.without_known(p, t).collect()) == [(1, 3), (4, 1)]


def test_retry_waits_only_for_errors_that_pass():
    calls, waits = [], []

    def client(_):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("503 unavailable")
        return "ok"

    assert models.with_retry(client, sleep=waits.append)("x") == "ok" and len(waits) == 2

    def broken(_):
        raise ValueError("bad request")

    with pytest.raises(ValueError):
        models.with_retry(broken, sleep=waits.append)("x")
    assert len(waits) == 2


def test_left_out_answers_are_none_and_not_cached(spark):
    pairs = spark.createDataFrame([("a", "b", "k1", "p1"), ("c", "d", "k2", "p22"), ("e", "f", "k3", "p3")], "source string, target string, key string, prompt string")
    cache = spark.createDataFrame([("k3", '{"rel_type": "LINTAS_BUKU_MEMPERDALAM", "confidence": 7}')], "key string, answer string")
    client = lambda ps: [None if p == "p1" else '```json\n{"rel_type": "LINTAS_BUKU_SAMA_DENGAN", "confidence": 0.9}\n```' for p in ps]
    out, fresh = models.classify(pairs, cache, client)
    assert {r["key"]: (r["rel_type"], r["confidence"]) for r in out.collect()} == {"k1": ("none", 0.0), "k2": ("LINTAS_BUKU_SAMA_DENGAN", 0.9), "k3": ("LINTAS_BUKU_MEMPERDALAM", 0.5)}
    assert [r["key"] for r in fresh.collect()] == ["k2"]


def test_retrieval_budget(spark):
    rows = spark.createDataFrame([("r", 1, "Bab 1", "energi kinetik")], "key string, book int, chapter string, subject string")
    chunks = spark.createDataFrame([(1, 1, "Bab 1", "3", "energi kinetik " + "x" * 300), (1, 2, "Bab 2", None, "energi " + "y" * 400), (1, 3, "Bab 9", "1", "lain"), (2, 4, "Bab 1", "1", "energi kinetik")], "book int, ord int, chapter string, page string, text string")
    text = models.retrieve(rows, chunks, ["subject"], budget=600).first()["context"]
    assert text.startswith("[Bab 1, p.3, score=5] energi kinetik") and text.endswith("...") and len(text) < 620


def test_shared_variables_chain(spark):
    uses = spark.createDataFrame([("a", "v"), ("b", "v"), ("c", "v"), ("c", "v"), ("d", "w"), (None, "v")], "concept string, variable string")
    assert sorted((r["a"], r["b"]) for r in joins.sharing(uses).collect()) == [("a", "b"), ("b", "c")]


def test_hot_lookup_equals_a_plain_join(spark):
    left = spark.createDataFrame([("hot" if i % 2 else f"k{i % 7}", i) for i in range(400)], "k string, i int")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("w")).withColumn("x", F.length("k"))
    want = sorted(tuple(r) for r in left.join(right, "k").select("k", "i", "w", "x").collect())
    got = skew.lookup(left, right, ["k"], "w", share=0.1, least=50).select("k", "i", "w", "x")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_checkpoint_source_keeps_the_last_valid_record(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"checkpoint_key":"1","reasoning":"old"}\n\n{bad\n{"checkpoint_key":"","reasoning":"x"}\n{"checkpoint_key":"1","reasoning":"new"}\n')
    got = files.read_checkpoint(spark, str(tmp_path))
    assert [(r["checkpoint_key"], r["reasoning"]) for r in got.collect()] == [("1", "new")]
    assert files.read_checkpoint(spark, str(tmp_path / "absent")).count() == 0
    assert files.read_checkpoint(spark, str(tmp_path), resume=False).count() == 0


def test_dump_refuses_to_overwrite(spark, tmp_path):
    e = spark.createDataFrame([("a", "b", "LINTAS_BUKU_X", 0.5), ("a", "c", "none", 0.0), ("a", "d", None, 0.0)], "source string, target string, rel_type string, confidence double")
    objects, _ = files.audit_dump(e, str(tmp_path / "out"))
    assert objects.count() == 1
    with pytest.raises(Exception, match="(?i)exist"):
        files.audit_dump(e, str(tmp_path / "out"))
    files.audit_dump(e, str(tmp_path / "out"), overwrite=True)


def test_survey_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "s.csv").write_text('﻿id,note\nLB1,"a, b ""c"""\n', encoding="utf-8")
    r = files.read_survey_edges(spark, str(tmp_path / "s.csv")).first()
    assert (r["id"], r["note"]) == ("LB1", 'a, b "c"')


def test_streamed_checkpoints_end_at_the_latest_record(spark, tmp_path):
    from rajut.streaming.checkpoints import tail, upsert_to

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"checkpoint_key":"1","reasoning":"one"}\n{"checkpoint_key":"2","reasoning":"two"}\nbroken\n')
    for extra in (None, '{"checkpoint_key":"1","reasoning":"three"}\n'):
        if extra:
            (tmp_path / "in" / "b.jsonl").write_text(extra)
        upsert_to(tail(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    newest = spark.read.parquet(str(tmp_path / "t" / "v=1"))
    assert {r["checkpoint_key"]: r["reasoning"] for r in newest.collect()} == {"1": "three", "2": "two"}


def test_answers_by_index_or_in_order():
    assert models.aligned([(2, "c"), (0, "a")], 3) == ["a", None, "c"]
    assert models.aligned(["a"], 2) == ["a", None] and models.aligned([], 1) == [None]


def _cloud(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 20, dim))
    return [(i, (centres[i % len(centres)] + 0.4 * rng.normal(size=dim)).tolist()) for i in range(n)]


def test_index_recall_on_more_rows_than_it_searches(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 150)  # cells are searched in blocks too
    rows = _cloud(4000, 24, 3)
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = {(r["q"], r["id"]) for r in vector.indexed_knn(df, df, 5, search=900, cell_rows=200).collect()}
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = {(i, int(j)) for i, near in enumerate(np.argsort(-(u @ u.T), axis=1)[:, :5]) for j in near}
    assert len(got & want) >= 0.98 * len(want) and len(got) == len(want)


def test_index_with_a_third_of_equal_vectors(spark):
    rows = _cloud(600, 8, 4) + [(1000 + i, [1.0] * 8) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = vector.indexed_knn(df, df, 3, search=200, cell_rows=50)
    of = {(r["q"], r["rank"]): r["id"] for r in got.where("q >= 1000").collect()}
    assert {k: v for k, v in of.items()} == {(1000 + i, n): 999 + n for i in range(300) for n in (1, 2, 3)}
    exact = {tuple(r) for r in vector.block_knn(df, df, 3).select("q", "id", "rank").collect()}
    assert {tuple(r) for r in vector.indexed_knn(df, df, 3, search=5000).select("q", "id", "rank").collect()} == exact
    assert vector.indexed_knn(df, df.limit(0), 3).count() == 0
