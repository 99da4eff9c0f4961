"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rajut.llm import abuse, chunking, consensus, containment, format_duplicates, linkage, mixing, vector_forest


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# 1: most similar vectors ------------------------------------------------------


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Up to 5 most similar concepts of every concept with a usable embedding, cosine >= 0.82."""
    concepts = _table(spark, d, "concepts").where(F.col("embedding_model") == "emb-sains-64")
    return vector_forest.neighbours(vector_forest.usable(concepts, "concept_id", "embedding", 64), k=5, least=0.82)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    near = p1_neighbours(spark, d)
    return near.select(F.least("id", "other").alias("concept_id_a"), F.greatest("id", "other").alias("concept_id_b")).distinct()


# 3: duplicates hidden by formatting -------------------------------------------


def _konsep_copies(spark, d):
    return format_duplicates.collapse(_table(spark, d, "konsep"), "konsep_id", ["name", "description"], [F.col("name"), F.col("description")])


def _subkonsep_copies(spark, d):
    return format_duplicates.collapse_records(_table(spark, d, "subkonsep"), "sub_id", "record")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [(name, f(spark, d)[1]) for name, f in (("konsep", _konsep_copies), ("subkonsep", _subkonsep_copies))]
    a, b = (m.select(F.lit(name).alias("src_table"), "keep_id", "copy_id") for name, m in parts)
    return a.unionByName(b)


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per different record with the number of its copies."""
    parts = [(name, f(spark, d)[0]) for name, f in (("konsep", _konsep_copies), ("subkonsep", _subkonsep_copies))]
    a, b = (g.select(F.lit(name).alias("src_table"), "keep_id", "n_copies") for name, g in parts)
    return a.unionByName(b)


# 4: splitting oversized texts -------------------------------------------------


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_texts(_table(spark, d, "book_texts"), "text_id", "body")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The texts that had to be cut: those with a second piece."""
    return p4_pieces(spark, d).where(F.col("piece_no") == 1).select("text_id")


def p4_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Each text put together again from its pieces without their overlaps, and whether all pieces keep the limits."""
    words = F.filter(F.split("piece", "[ \t\r\n]+"), lambda w: w != "")
    own = p4_pieces(spark, d).select("text_id", "piece_no", "n_words", "overlap", (F.col("end_word") - F.col("start_word") == F.size(words)).alias("exact"), F.slice(words, F.col("overlap") + 1, F.lit(1_000)).alias("w"))
    again = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "w"))), lambda x: x["w"]))
    fits = F.every((F.col("n_words") <= 800) & (F.col("overlap") <= 200) & F.col("exact"))
    return own.groupBy("text_id").agg(again.alias("w"), fits.alias("fits")).select("text_id", F.size("w").cast("bigint").alias("n_words"), F.md5(F.array_join("w", " ")).alias("digest"), "fits")


# 7: evaluation text in training text ------------------------------------------


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return containment.leaked(_table(spark, d, "documents"), "doc_id", "text", "layout", _table(spark, d, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("item_id", "doc_id")


# 8: mixing sources ------------------------------------------------------------


def _mixture(spark, d):
    sizes = mixing.sized(_table(spark, d, "documents"), "doc_id", "text", "source")
    planned = mixing.plan(sizes, _table(spark, d, "source_weights"))
    return planned, mixing.sample(sizes, planned)


def p8_sample(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[1]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    planned, drawn = _mixture(spark, d)
    return mixing.shares(drawn, planned)


QUERIES = {
    "p1_found": p1_found,
    "p1_neighbours": p1_neighbours,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p4_round_trip": p4_round_trip,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_sample": p8_sample,
    "p8_shares": p8_shares,
}


def _k(x: str) -> str:
    return f"coalesce(lower(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]', '', 'g')), '')"


def _l(x: str) -> str:
    return f"list_transform({x}, lambda e: {_k('e')})"


_COPIES = f"""
WITH k AS (SELECT DISTINCT 'konsep' AS src_table, konsep_id AS id, {_k("name")} AS a, {_k("description")} AS b, '' AS c FROM konsep),
r AS (SELECT sub_id, from_json(record, '{{"name":"VARCHAR","description":"VARCHAR","formula":["VARCHAR"],"variables":["VARCHAR"],"kondisi":["VARCHAR"]}}') AS j FROM subkonsep),
s AS (SELECT DISTINCT 'subkonsep' AS src_table, sub_id AS id, {_k("j.name")} AS a, {_k("j.description")} AS b,
  CAST([{_l("j.formula")}, {_l("j.variables")}, {_l("j.kondisi")}] AS VARCHAR) AS c FROM r),
u AS (SELECT * FROM k UNION ALL SELECT * FROM s),
g AS (SELECT src_table, id, min(id) OVER (PARTITION BY src_table, a, b, c) AS keep_id FROM u)
"""
ORACLE = {
    "p1_found": """WITH v AS (SELECT concept_id, any_value(embedding) AS e FROM concepts
  WHERE embedding_model = 'emb-sains-64' AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY concept_id),
s AS (SELECT a.concept_id AS a, b.concept_id AS b, list_cosine_similarity(a.e, b.e) AS s FROM v a, v b WHERE a.concept_id <> b.concept_id),
r AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM s WHERE s >= 0.82)
SELECT DISTINCT least(a, b) AS concept_id_a, greatest(a, b) AS concept_id_b FROM r WHERE n <= 5""",
    "p3_found": _COPIES + "SELECT src_table, keep_id, id AS copy_id FROM g WHERE id <> keep_id",
    "p3_groups": _COPIES + "SELECT src_table, keep_id, count(*) AS n_copies FROM g GROUP BY ALL",
    "p4_round_trip": "SELECT text_id, len(w) AS n_words, md5(array_to_string(w, ' ')) AS digest, true AS fits FROM (SELECT text_id, regexp_extract_all(any_value(body), '[^ \\t\\r\\n]+') AS w FROM book_texts GROUP BY 1) WHERE len(w) > 0",
    "p4_found": "SELECT DISTINCT text_id FROM book_texts WHERE len(regexp_extract_all(body, '[^ \\t\\r\\n]+')) > 800",
}

ORACLE["p7_found"] = r"""WITH d AS (SELECT doc_id, any_value(text) AS t, any_value(layout) AS l FROM documents WHERE text IS NOT NULL GROUP BY 1),
j AS (SELECT doc_id, unnest(json_extract(t, '$.cells[*]')) AS c FROM d WHERE l = 'json' AND json_valid(t)),
o AS (SELECT doc_id, unnest(json_extract(c, '$.outputs[*]')) AS o FROM j),
v AS (SELECT doc_id, unnest(json_keys(o, '$.data')) AS k, o FROM o),
x AS (
  SELECT doc_id, json_extract(c, '$.source') AS s, '' AS glue FROM j
  UNION ALL SELECT doc_id, json_extract(o, '$.text'), '' FROM o
  UNION ALL SELECT doc_id, json_extract(o, '$.data."' || k || '"'), '' FROM v WHERE NOT starts_with(k, 'image/')
  UNION ALL SELECT doc_id, json_extract(o, '$.traceback'), ' ' FROM o
  UNION ALL SELECT doc_id, json_extract(o, '$.evalue'), '' FROM o
),
cells AS (
  SELECT doc_id, unnest(regexp_split_to_array(t, '(?m)^# %%[^\n]*$')) AS c FROM d WHERE l = 'percent'
  UNION ALL SELECT doc_id, unnest(regexp_split_to_array(t, '(?m)^```[^\n]*$')) FROM d WHERE l = 'fenced'
  UNION ALL SELECT doc_id, t FROM d WHERE coalesce(l, '') NOT IN ('percent', 'fenced', 'json') OR (l = 'json' AND NOT json_valid(t))
  UNION ALL SELECT doc_id, CASE json_type(s) WHEN 'ARRAY' THEN CASE WHEN glue = '' THEN array_to_string(from_json(s, '["VARCHAR"]'), '') ELSE array_to_string(from_json(s, '["VARCHAR"]'), ' ') END WHEN 'VARCHAR' THEN s ->> '$' END FROM x
),
dw AS (SELECT doc_id, regexp_extract_all(lower(c), '[\p{L}\p{N}]+') AS w FROM cells WHERE c IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i : i + 11], ' '))) AS g FROM dw WHERE len(w) >= 12),
iw AS (SELECT item_id, regexp_extract_all(lower(any_value(text)), '[\p{L}\p{N}]+') AS w FROM eval_items GROUP BY 1),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i : i + 11], ' '))) AS g FROM iw WHERE len(w) >= 12)
SELECT DISTINCT item_id, doc_id FROM ig JOIN dg USING (g)"""


# 5: matching entities without keys --------------------------------------------


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    return linkage.link(_table(spark, d, "concepts"), _table(spark, d, "concept_register"), ("concept_id", "name", "description", "grade"), ("register_id", "title", "summary", "level_text"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_links(spark, d).select(F.col("left_id").alias("concept_id"), F.col("right_id").alias("register_id"))


QUERIES |= {"p5_found": p5_found, "p5_links": p5_links}


# 6: consensus of annotators ---------------------------------------------------


def _consensus(spark, d):
    triples = _table(spark, d, "triples").where(F.col("triple_id").isNotNull()).dropDuplicates(["triple_id"])
    items = triples.select(F.col("triple_id").alias("item"), F.col("source").alias("grp"), consensus.label_of(F.col("final_consensus_label")).alias("known"))
    given = _table(spark, d, "expert_validation")
    cast = consensus.votes(given, triples).select(F.col("triple_id").alias("item"), F.col("reviewer").alias("who"), "label")
    return consensus.infer(items, cast, people=given.select(F.col("reviewer").alias("who")))


def p6_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Each triple with its label, confidence, number of votes and agreement of its votes."""
    return _consensus(spark, d)[0].select(F.col("item").alias("triple_id"), F.col("label").alias("final_consensus_label"), "confidence", "n_votes", "agreement")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_consensus(spark, d).select("triple_id", "final_consensus_label")


def p6_reviewers(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d)[1].select(F.col("who").alias("reviewer"), "n_votes", "reliability", "kind")


QUERIES |= {"p6_found": p6_found, "p6_consensus": p6_consensus, "p6_reviewers": p6_reviewers}


# 9: abusive, hateful or sexual content ----------------------------------------


def _abuse_scores(spark, d):
    docs = _table(spark, d, "documents")
    scorer = abuse.train(docs, _table(spark, d, "doc_labels"), "doc_id", "text", "layout", "doc_id", "toxic")
    return abuse.score(docs, scorer, "doc_id", "text", "layout", "source")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _abuse_scores(spark, d).where(F.col("score") >= abuse.THRESHOLD).select("doc_id").distinct()


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every document's score with its most offending passage."""
    best = F.struct("score", "top_score", "source", "passage", "fitted")
    return _abuse_scores(spark, d).groupBy("doc_id").agg(F.max(best).alias("b")).select("doc_id", "b.source", "b.score", "b.top_score", F.when(F.col("b.score") >= abuse.THRESHOLD, F.col("b.passage")).alias("passage"), "b.fitted")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents and share of offending documents per source."""
    flagged = (F.col("score") >= abuse.THRESHOLD).cast("int")
    per_doc = _abuse_scores(spark, d).groupBy("doc_id").agg(F.min("source").alias("source"), F.max(flagged).alias("flagged"), F.max("score").alias("score"))
    return per_doc.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("flagged").alias("n_flagged"), F.avg("flagged").alias("rate"), F.avg("score").alias("mean_score"))


QUERIES |= {"p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}
