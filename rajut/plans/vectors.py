"""Queries of exact vector search, candidate pairs and classification over the embeddings table."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from rajut.functions import vocab
from rajut.operators import aggregates, graph, models, vector
from rajut.plans.data import table
from rajut.plans.views import concept_edges, concept_nodes, linked_edges, once, relations, sql_list
from rajut.sources.files import audit_dump

QUERIES, ORACLE = {}, {}
K, LEAST = 6, 0.25


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE[name] = once(sql)


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").cast("string").alias("grp"))


def _ranked(s, d, k=K):
    """The nearest of every vector, by the index."""
    v = _vectors(s, d)
    return vector.indexed_knn(v, v, k)


def _pairs(s, d):
    return vector.candidate_pairs(_ranked(s, d), _vectors(s, d), LEAST)


_V = "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, CAST(label AS VARCHAR) AS grp FROM embeddings), s AS (SELECT a.id AS q, b.id AS id, round(list_cosine_similarity(a.e, b.e), 6) AS sim, a.grp AS ga, b.grp AS gb FROM v a, v b), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS rank FROM s)"
_P = _V + f", p AS (SELECT arg_min(q, q) AS source, arg_min(id, q) AS target, arg_min(sim, q) AS similarity, arg_min(ga, q) AS source_grade, arg_min(gb, q) AS target_grade FROM r WHERE rank <= {K} AND sim >= {LEAST} AND q <> id AND ga <> gb GROUP BY least(q, id), greatest(q, id))"


def _sum(x):
    return F.round(x, 5)


_add("v1_cosine", lambda s, d: _vectors(s, d).join(_vectors(s, d).select((F.col("id") + 1).alias("id"), F.col("vec").alias("before")), "id").select("id", F.round(vector.cosine("before", "vec"), 6).alias("sim")), "SELECT a.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1")
_add("v2_knn_topk", lambda s, d: _ranked(s, d).select("q", "rank", "sim"), _V + f" SELECT q, rank, sim FROM r WHERE rank <= {K}")
_add("v3_candidate_pairs", _pairs, _P + " SELECT * FROM p")
_add("v3_normalized_score", lambda s, d: vector.candidate_pairs(_ranked(s, d), _vectors(s, d), 0.65, "normalized", cross_group=False).select("source", "target"), _V + f" SELECT min(q) AS source, arg_min(id, q) AS target FROM r WHERE rank <= {K} AND (1 + sim) / 2 >= 0.65 AND q <> id GROUP BY least(q, id), greatest(q, id)")


def _typed(s, d):
    return table(s, d, "embeddings").where(F.col("vec_id") % 3 == 0).select(F.col("vec_id").alias("target"), F.lit("MENGATUR").alias("rel_type"))


def _new_pairs(s, d):
    p = _pairs(s, d)
    done = p.where((F.col("source") % 3) == 0).select(F.col("target").alias("source"), F.col("source").alias("target"), F.when(F.col("target") % 2 == 0, vocab.SIMILAR).otherwise("MENGATUR").alias("rel_type"))
    return vector.without_known(p, done).select("source", "target")


_add("j13_without_known", _new_pairs, _P + " SELECT source, target FROM p WHERE NOT (source % 3 = 0 AND target % 2 = 1)")
_add("v4_index_info", lambda s, d: vector.index_info(table(s, d, "concepts").dropDuplicates(["concept_id"]).where(F.col("embedding").isNotNull()).select(F.col("embedding_model").alias("model"), F.col("embedding").alias("vec")), 64), "SELECT embedding_model AS model, count(*) AS n, CAST(max(len(e)) AS INTEGER) AS dim, max(len(e)) <> 64 AS stale FROM (SELECT concept_id, any_value(embedding_model) AS embedding_model, any_value(embedding) AS e FROM concepts GROUP BY 1) WHERE e IS NOT NULL GROUP BY 1")
_add("v5_to_embed", lambda s, d: vector.to_embed(table(s, d, "concepts").select(F.col("concept_id").alias("id")).distinct(), table(s, d, "concepts").where(F.col("embedding").isNotNull()).select(F.col("concept_id").alias("id"), F.col("embedding_model").alias("model")), "emb-sains-64"), "SELECT DISTINCT concept_id AS id FROM concepts WHERE concept_id NOT IN (SELECT concept_id FROM concepts WHERE embedding IS NOT NULL AND embedding_model = 'emb-sains-64')")
_add("v6_similar_edges", lambda s, d: vector.similar_edges(_pairs(s, d)), _P + " SELECT least(source, target) AS source, greatest(source, target) AS target, max(similarity) AS score, 'SIMILAR_TO' AS rel_type FROM p GROUP BY 1, 2")
_add("v6_validated", lambda s, d: vector.validated(concept_edges(s, d), vocab.RELATION_TYPES).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n")))


def _client(texts):
    """A deterministic embedding: 4 numbers of the text's hash."""
    return [[b / 255 for b in hashlib.md5((t or "").encode()).digest()[:4]] for t in texts]


def _embedded(s, d):
    rows = table(s, d, "konsep").dropDuplicates(["konsep_id"]).select(F.col("konsep_id").alias("id"), F.col("description").alias("text"))
    cached = rows.where(F.col("id") % 2 == 0).select(F.sha2(F.concat("text", F.lit("m1")), 256).alias("key")).distinct().withColumn("vec", F.array(F.lit(0.5)))
    return vector.embed(rows, cached, "m1", _client).select("id", "hit", F.size("vec").cast("bigint").alias("dim"), F.round(F.col("vec")[0], 6).alias("first"))


_add("v7_embed_cached", _embedded, "WITH k AS (SELECT DISTINCT konsep_id AS id, description AS t FROM konsep), h AS (SELECT DISTINCT t FROM k WHERE id % 2 = 0) SELECT id, t IN (SELECT t FROM h) AS hit, CASE WHEN t IN (SELECT t FROM h) THEN 1 ELSE 4 END AS dim, round(CASE WHEN t IN (SELECT t FROM h) THEN 0.5 ELSE CAST('0x' || md5(coalesce(t, ''))[1:2] AS INTEGER) / 255.0 END, 6) AS first FROM k")
_add("a20_sweep", lambda s, d: aggregates.sweep(_ranked(s, d, 20), [(0.2, 20), (0.25, 15), (0.3, 10), (0.35, 5)]), _V + ", c(threshold, k) AS (VALUES (0.2, 20), (0.25, 15), (0.3, 10), (0.35, 5)), u AS (SELECT threshold, k, least(q, id) AS a, greatest(q, id) AS b FROM r, c WHERE q <> id AND rank <= k AND sim >= threshold) SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(k AS INTEGER) AS k, count(DISTINCT (a, b)) AS n_pairs FROM u GROUP BY 1, 2")


def _answers(prompts):
    """A deterministic classifier; every fifth length is left out, every seventh has an unknown type."""
    out = []
    for p in prompts:
        n = len(p)
        out.append(None if n % 5 == 0 else json.dumps({"rel_type": "APA" if n % 7 == 0 else vocab.CROSS_TYPES[n % 5], "confidence": (n % 12) / 10, "description": "x"}))
    return out


def _classified(s, d):
    nodes = concept_nodes(s, d)
    c = graph.contexts(nodes, linked_edges(s, d)).withColumn("id", F.concat_ws("/", "grade", "name"))
    e = linked_edges(s, d).where(F.col("src_grade") != F.col("tgt_grade")).select(F.concat_ws("/", "src_grade", "src").alias("source"), F.concat_ws("/", "tgt_grade", "tgt").alias("target")).distinct()
    pairs = models.enrich(e, c).withColumn("prompt", models.pair_prompt())
    # what earlier runs have answered
    cached = pairs.where(F.substring("key", 1, 1) < "8").select("key", F.lit('{"rel_type": "LINTAS_BUKU_SAMA_DENGAN", "confidence": 0.8}').alias("answer")).distinct()
    return models.classify(pairs.select("source", "target", "key", "prompt"), cached, _answers)[0]


_add("l5_classify_pairs", lambda s, d: _classified(s, d).select("source", "target", "rel_type", "confidence"))
_add("s14_audit_histogram", lambda s, d: audit_dump(concept_edges(s, d).select(F.col("src").alias("source"), F.col("tgt").alias("target"), "rel_type", "confidence"))[1].select("rel_type", "n", F.col("pos").cast("bigint").alias("pos")))
from rajut.plans.graphs import _TOP  # noqa: E402
from rajut.plans.views import GRAPH  # noqa: E402

ORACLE["s14_audit_histogram"] = once(GRAPH + "SELECT rel_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, rel_type) AS pos FROM edges WHERE rel_type <> 'none' GROUP BY rel_type")
ORACLE["v6_validated"] = once(GRAPH + f"SELECT rel_type, count(*) AS n FROM edges WHERE rel_type IN ({sql_list(vocab.RELATION_TYPES)}) GROUP BY rel_type")
_add("l10_valid_answers", lambda s, d: relations(s, d).select("rel_id", models.valid_answer(F.to_json(F.struct("rel_type", (F.col("confidence") * 2).alias("confidence"), "description")), vocab.RELATION_TYPES).alias("v")).select("rel_id", "v.rel_type", F.round("v.confidence", 6).alias("confidence")), f"SELECT DISTINCT rel_id, CASE WHEN rel_type IN ({sql_list(vocab.RELATION_TYPES)}) THEN rel_type ELSE 'none' END AS rel_type, round(CASE WHEN rel_type NOT IN ({sql_list(vocab.RELATION_TYPES)}) OR rel_type IS NULL THEN 0 WHEN confidence * 2 BETWEEN 0 AND 1 THEN confidence * 2 ELSE 0.5 END, 6) AS confidence FROM relations")


def _enriched(s, d):
    c = graph.contexts(concept_nodes(s, d), linked_edges(s, d)).withColumn("id", F.concat_ws("/", "grade", "name"))
    e = linked_edges(s, d).where(F.col("src_grade") != F.col("tgt_grade")).select(F.concat_ws("/", "src_grade", "src").alias("source"), F.concat_ws("/", "tgt_grade", "tgt").alias("target")).distinct()
    text = lambda side: F.array_join(F.transform(F.col(side)["out_edges"], lambda e: F.concat_ws(">", e["rel_type"], e["target"])), ";")
    rows = models.enrich(e, c).where(F.length("key") == 64)
    return rows.select("source", "target", F.col("a.description").alias("a_description"), F.col("b.description").alias("b_description"), text("a").alias("a_edges"), text("b").alias("b_edges"), F.array_join("shared", ";").alias("shared"))


_add("j14_enriched_pairs", _enriched, GRAPH + _TOP + """, c AS (SELECT n.grade || '/' || n.name AS id, n.description, coalesce(string_agg(o.rel_type || '>' || o.tgt, ';' ORDER BY o.pos), '') AS edges, coalesce(list(o.tgt) FILTER (o.tgt IS NOT NULL), []) AS targets
  FROM nodes n LEFT JOIN o ON o.src_grade = n.grade AND o.src = n.name AND o.pos <= 5 GROUP BY ALL),
p AS (SELECT DISTINCT src_grade || '/' || src AS source, tgt_grade || '/' || tgt AS target FROM linked WHERE src_grade <> tgt_grade)
SELECT source, target, a.description AS a_description, b.description AS b_description, a.edges AS a_edges, b.edges AS b_edges, array_to_string(list_sort(list_distinct(list_intersect(a.targets, b.targets))), ';') AS shared
FROM p JOIN c a ON a.id = p.source JOIN c b ON b.id = p.target""")


def _indexed_answers(prompts):
    """Answers with their index, last first; every fourth length is left out and every seventh has an unknown type."""
    out = [(i, json.dumps({"rel_type": "APA" if len(p) % 7 == 0 else vocab.CROSS_TYPES[len(p) % 5], "confidence": (len(p) % 12) / 10})) for i, p in enumerate(prompts) if len(p) % 4]
    return out[::-1]


def _answered(s, d):
    """Relations as pairs, a third of them in the cache; the rest answered in batches, out of order and with gaps."""
    prompt = F.concat_ws(" ", "src_name", "target", "description")
    pairs = relations(s, d).where(F.length(prompt) > 0).select(F.col("rel_id").alias("source"), F.col("target"), F.sha2(prompt, 256).alias("key"), prompt.alias("prompt"))
    cached = pairs.where(F.length("prompt") % 3 == 0).select("key", F.lit('{"rel_type": "LINTAS_BUKU_SAMA_DENGAN", "confidence": 0.9}').alias("answer")).distinct()
    return models.classify(pairs, cached, _indexed_answers)[0].select(F.col("source").alias("rel_id"), "rel_type", F.round("confidence", 6).alias("confidence"))


_kinds = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(vocab.CROSS_TYPES[:5]))
_add("l4_batch_answers", _answered, f"""WITH r AS (SELECT rel_id, length(concat_ws(' ', src_name, target, description)) AS n FROM relations),
t AS (SELECT rel_id, n, CASE WHEN n % 3 = 0 THEN 'LINTAS_BUKU_SAMA_DENGAN' WHEN n % 4 = 0 OR n % 7 = 0 THEN 'none' ELSE CASE n % 5 {_kinds} END END AS rel_type FROM r WHERE n > 0)
SELECT rel_id, rel_type, CASE WHEN rel_type = 'none' THEN 0.0 WHEN n % 3 = 0 THEN 0.9 WHEN n % 12 > 10 THEN 0.5 ELSE round((n % 12) / 10.0, 6) END AS confidence FROM t""")
_add("o2_similar_order", lambda s, d: vector.similar_edges(_pairs(s, d)).orderBy(F.desc("score"), "source", "target").select("source", "target", "score"), _P + " SELECT least(source, target) AS source, greatest(source, target) AS target, max(similarity) AS score FROM p GROUP BY 1, 2 ORDER BY score DESC, 1, 2")


def _two_indexes(s, d):
    """U4: results of two indexes merged: an id once with its best score, ranked again, cut at k."""
    v = _vectors(s, d)
    even = F.col("id") % 2 == 0
    both = vector.indexed_knn(v, v.where(even), K).unionByName(vector.indexed_knn(v, v.where(~even), K))
    best = Window.partitionBy("q").orderBy(F.desc("sim"), "id")
    one = both.groupBy("q", "id").agg(F.max("sim").alias("sim"))
    return one.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= K).select("q", "rank", "sim")


_add("u4_two_index_merge", _two_indexes, _V + f" SELECT q, rank, sim FROM r WHERE rank <= {K}")


def _flagship(s, d):
    """Cross-group candidate pairs of the nearest neighbours, counted per pair of groups."""
    return _pairs(s, d).groupBy("source_grade", "target_grade").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("similarity"), 5).alias("mean_similarity"))


_add("flagship_cross_groups", _flagship, _P + " SELECT source_grade, target_grade, count(*) AS n_pairs, round(avg(similarity), 5) AS mean_similarity FROM p GROUP BY 1, 2")
