"""Queries of graph metrics (G), graph joins (J) and distributions (A) over the domain graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from rajut.functions import vocab
from rajut.functions.normalize import strip
from rajut.functions.scalars import variable
from rajut.functions.text import alike_key
from rajut.operators import aggregates as a
from rajut.operators import books, graph, joins
from rajut.operators.aggregates import confidence_band
from rajut.plans.data import table
from rajut.plans.views import concept_edges, concept_nodes, GRAPH, linked_edges, once, relations, sql_list, sql_strip

QUERIES, ORACLE = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE[name] = once(sql)


def _g(f):
    return lambda s, d: f(concept_nodes(s, d), linked_edges(s, d))


_DEG = """, ends AS (SELECT src_grade AS grade, src AS name FROM linked UNION ALL SELECT tgt_grade, tgt FROM linked WHERE NOT (src_grade = tgt_grade AND src = tgt)),
deg AS (SELECT n.grade, n.name, count(e.name) AS degree FROM nodes n LEFT JOIN ends e ON n.grade = e.grade AND n.name = e.name GROUP BY ALL)"""
_MOD = """SELECT coalesce(sum(inside / m - k_out * k_in / (m * m)), 0.0) AS modularity, coalesce(sum(k_out), 0) AS n_edges FROM (
  SELECT coalesce(o.grade, i.grade) AS grade, CAST(coalesce(k_out, 0) AS DOUBLE) AS k_out, coalesce(inside, 0) AS inside, coalesce(k_in, 0) AS k_in, sum(coalesce(k_out, 0)) OVER () AS m FROM
  (SELECT src_grade AS grade, count(*) AS k_out, count(CASE WHEN src_grade = tgt_grade THEN 1 END) AS inside FROM {e} GROUP BY 1) o FULL JOIN (SELECT tgt_grade AS grade, count(*) AS k_in FROM {e} GROUP BY 1) i ON o.grade = i.grade)"""
_add("g1_average_degree", lambda s, d: graph.average_degree(concept_nodes(s, d), linked_edges(s, d)).select(F.round("average_degree", 6).alias("average_degree"), "n_nodes"), GRAPH + _DEG + "SELECT round(coalesce(avg(degree), 0), 6) AS average_degree, count(*) AS n_nodes FROM deg")
_add("g1_degrees", _g(graph.degrees), GRAPH + _DEG + "SELECT * FROM deg")
_add("g2_density", lambda s, d: graph.density(concept_nodes(s, d), linked_edges(s, d)).withColumn("density", F.round("density", 9)), GRAPH + "SELECT n AS n_nodes, m AS n_edges, round(coalesce(m / nullif(CAST(n AS DOUBLE) * (n - 1), 0), 0), 9) AS density FROM (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM linked) AS m)")
_add("g3_grade_modularity", lambda s, d: graph.grade_modularity(linked_edges(s, d)).select(F.round("modularity", 6).alias("modularity"), F.col("n_edges").cast("double").alias("n_edges")), GRAPH + "SELECT round(modularity, 6) AS modularity, CAST(n_edges AS DOUBLE) AS n_edges FROM (" + _MOD.format(e="linked") + ")")
_VAR = """, v_{v} AS (SELECT (SELECT coalesce(avg(degree), 0) FROM (SELECT n.grade, n.name, count(e.name) AS degree FROM nodes n LEFT JOIN (SELECT src_grade AS grade, src AS name FROM {e} UNION ALL SELECT tgt_grade, tgt FROM {e} WHERE NOT (src_grade = tgt_grade AND src = tgt)) e ON n.grade = e.grade AND n.name = e.name GROUP BY ALL)) AS ad,
 (SELECT modularity FROM (""" + _MOD + """)) AS q, (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM {e}) AS m)"""
_add("g4_robustness", lambda s, d: graph.robustness(concept_nodes(s, d), linked_edges(s, d), F.coalesce("consensus", "status", F.lit("")) == "wrong").withColumn("value", F.round("value", 6)), GRAPH + ", kept AS (SELECT * FROM linked WHERE coalesce(consensus, status, '') <> 'wrong')" + _VAR.format(v="all", e="linked") + _VAR.format(v="kept", e="kept") + ", u AS (SELECT 'all' AS variant, * FROM v_all UNION ALL SELECT 'without_wrong', * FROM v_kept) SELECT variant, metric, round(value, 6) AS value FROM (SELECT variant, 'average_degree' AS metric, CAST(ad AS DOUBLE) AS value FROM u UNION ALL SELECT variant, 'density', m / (CAST(n AS DOUBLE) * (n - 1)) FROM u UNION ALL SELECT variant, 'modularity', q FROM u UNION ALL SELECT variant, 'nodes', CAST(n AS DOUBLE) FROM u UNION ALL SELECT variant, 'edges', CAST(m AS DOUBLE) FROM u)")
_KEY = "coalesce({g}, '') || chr(31) || {n}"
_SIMPLE = ", ends2 AS (SELECT " + _KEY.format(g="src_grade", n="src") + " AS u, " + _KEY.format(g="tgt_grade", n="tgt") + " AS v FROM linked), simple AS (SELECT DISTINCT least(u, v) AS a, greatest(u, v) AS b FROM ends2 WHERE u <> v)"
_CC = ", both_ AS (SELECT a AS u, b AS v FROM simple UNION SELECT b, a FROM simple), reach AS (SELECT " + _KEY.format(g="grade", n="name") + " AS u, " + _KEY.format(g="grade", n="name") + " AS c FROM nodes UNION SELECT b.v, r.c FROM reach r JOIN both_ b ON b.u = r.u), comp AS (SELECT u, min(c) AS component FROM reach GROUP BY u)"
_add("g5_simple_stats", _g(graph.simple_graph_stats), GRAPH.replace("WITH", "WITH RECURSIVE", 1) + _SIMPLE + _CC + "SELECT n AS n_nodes, m AS n_edges, c AS n_components, round(2 * m / (CAST(n AS DOUBLE) * (n - 1)), 3) AS degree_centrality, round(2 * m / (CAST(n AS DOUBLE) * (n - 1)), 3) AS density FROM (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM simple) AS m, (SELECT count(DISTINCT component) FROM comp) AS c)")
_add("g5_greedy_communities", lambda s, d: graph.community_quality(linked_edges(s, d), "greedy"))
_add("g6_louvain_communities", lambda s, d: graph.community_quality(linked_edges(s, d), "louvain"))


def _grade_partition(s, d):
    """The undirected modularity that G5 and G6 maximise, of the given partition by grade."""
    member = concept_nodes(s, d).select(F.concat_ws("\x1f", "grade", "name").alias("u"), F.col("grade").alias("community"))
    return graph.undirected_modularity(linked_edges(s, d), member).select("n_communities", F.round("modularity", 9).alias("modularity"))


_add("g6_partition_modularity", _grade_partition, GRAPH + _SIMPLE + """, p AS (SELECT split_part(a, chr(31), 1) AS ca, split_part(b, chr(31), 1) AS cb FROM simple), k AS (SELECT c, count(*) AS k FROM (SELECT ca AS c FROM p UNION ALL SELECT cb FROM p) GROUP BY 1)
SELECT count(*) AS n_communities, round(coalesce((SELECT count(*) FROM p WHERE ca = cb) * 2.0 / sum(k) - sum(CAST(k AS DOUBLE) * k) / (sum(k) * CAST(sum(k) AS DOUBLE)), 0.0), 9) AS modularity FROM k""")
_add("g7_completeness", lambda s, d: graph.completeness(concept_nodes(s, d), "description").withColumn("completeness", F.round("completeness", 6)), GRAPH + f"SELECT count(*) AS n, count(CASE WHEN {sql_strip('coalesce(description, chr(32))')} <> '' THEN 1 END) AS n_described, round(avg(CASE WHEN {sql_strip('coalesce(description, chr(32))')} <> '' THEN 1 ELSE 0 END), 6) AS completeness FROM nodes")
_add("g8_components", lambda s, d: graph.components(concept_nodes(s, d), linked_edges(s, d)).groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes")), GRAPH.replace("WITH", "WITH RECURSIVE", 1) + _SIMPLE + _CC + "SELECT component, count(*) AS n_nodes FROM comp GROUP BY component")


def _subtopics(s, d):
    k = table(s, d, "konsep").dropDuplicates(["konsep_id"])
    subs = k.where(F.col("sub_bab").isNotNull()).select("book_id", "bab", "sub_bab").distinct()
    return graph.empty_rate(subs, k.where(F.col("deleted_at").isNull() & F.col("sub_bab").isNotNull() & (F.size("relations") > 0)), ["book_id", "bab", "sub_bab"])


_add("g9_empty_subtopics", lambda s, d: _subtopics(s, d).withColumn("empty_rate", F.round("empty_rate", 6)), "WITH s AS (SELECT book_id, bab, sub_bab, max(CASE WHEN deleted_at IS NULL AND len(relations) > 0 THEN 1 ELSE 0 END) AS f FROM konsep WHERE sub_bab IS NOT NULL AND bab IS NOT NULL GROUP BY ALL) SELECT count(*) AS n_parents, CAST(count(*) - sum(f) AS BIGINT) AS n_empty, round(1 - avg(f), 6) AS empty_rate FROM s")
_add("g10_typed_ratio", lambda s, d: graph.typed_ratio(relations(s, d)).withColumn("typed_ratio", F.round("typed_ratio", 6)), f"SELECT count(CASE WHEN rel_type IN ({sql_list(vocab.RELATION_TYPES)}) THEN 1 END) AS n_typed, count(*) AS n_edges, round(avg(CASE WHEN rel_type IN ({sql_list(vocab.RELATION_TYPES)}) THEN 1 ELSE 0 END), 6) AS typed_ratio FROM (SELECT DISTINCT rel_id, rel_type FROM relations) WHERE coalesce(rel_type, '') NOT IN ({sql_list(vocab.STRUCTURAL_TYPES)})")


def _chapter_edges(s, d):
    heads = table(s, d, "konsep").select("book_id", F.regexp_extract("bab", r"^(?:Bab|BAB) (\d+)", 1).try_cast("int").alias("no")).where(F.col("no").isNotNull()).distinct()
    key = lambda c: F.format_string("%03d-%02d", "book_id", c)
    pairs = heads.join(heads.select("book_id", (F.col("no") - 1).alias("no"), F.col("no").alias("then")), ["book_id", "no"])
    return pairs.select(F.xxhash64("book_id", "no").alias("edge_id"), key(F.col("no")).alias("u"), key(F.col("then")).alias("v"))


_CH = "WITH RECURSIVE h AS (SELECT DISTINCT book_id, try_cast(nullif(regexp_extract(bab, '^(?:Bab|BAB) (\\d+)', 1), '') AS INTEGER) AS no FROM konsep), k AS (SELECT book_id, no, printf('%03d-%02d', book_id, no) AS key FROM h WHERE no IS NOT NULL), e AS (SELECT a.key AS u, b.key AS v FROM k a JOIN k b ON a.book_id = b.book_id AND b.no = a.no + 1)"
_add("g11_longest_chain", lambda s, d: graph.longest_chain(_chapter_edges(s, d)).select(F.col("n_edges").cast("bigint").alias("n_edges"), F.array_join("chain", " ").alias("chain")), _CH + ", p AS (SELECT 1 AS n, v AS last, u || ' ' || v AS chain FROM e UNION ALL SELECT p.n + 1, e.v, p.chain || ' ' || e.v FROM p JOIN e ON e.u = p.last WHERE p.n < 10) SELECT CAST(n AS BIGINT) AS n_edges, chain FROM p WHERE last NOT IN (SELECT u FROM e) ORDER BY n DESC, chain LIMIT 1")


def _within(s, d):
    e = _chapter_edges(s, d).select("u", "v")
    return graph.parents_within(e.select(F.col("v").alias("u")).distinct(), e, 4)


_add("g12_parents_within", _within, _CH + ", w AS (SELECT u AS top, v AS x, 1 AS n FROM e UNION SELECT w.top, e.v, w.n + 1 FROM w JOIN e ON e.u = w.x WHERE w.n < 4) SELECT x AS u, min(top) AS parent FROM w GROUP BY x")
_TOP = ", o AS (SELECT *, row_number() OVER (PARTITION BY src_grade, src ORDER BY coalesce(confidence, 0.0) DESC, rel_type, tgt, rel_id) AS pos FROM linked)"
_add("w4_top_out_edges", lambda s, d: graph.top_out_edges(linked_edges(s, d)).select("src_grade", "src", "pos", "rel_type", "tgt", "confidence"), GRAPH + _TOP + "SELECT src_grade, src, pos, rel_type, tgt, confidence FROM o WHERE pos <= 5")
_add("g13_contexts", lambda s, d: graph.contexts(concept_nodes(s, d), linked_edges(s, d)).select("grade", "name", "chapter", F.array_join(F.transform("out_edges", lambda e: F.concat_ws(">", e["rel_type"], e["target"])), ";").alias("edges")), GRAPH + _TOP + "SELECT n.grade, n.name, n.chapter, coalesce(string_agg(o.rel_type || '>' || o.tgt, ';' ORDER BY o.pos), '') AS edges FROM nodes n LEFT JOIN o ON o.src_grade = n.grade AND o.src = n.name AND o.pos <= 5 GROUP BY ALL")
_add("g14_typed_edges", lambda s, d: graph.typed_edges(concept_edges(s, d), ("MENGATUR",), "BER").select("rel_id", "rel_type"), GRAPH + "SELECT rel_id, rel_type FROM edges WHERE rel_type = 'MENGATUR' OR starts_with(rel_type, 'BER')")
_add("g15_between_grades", lambda s, d: graph.between_grades(linked_edges(s, d)), GRAPH + "SELECT count(*) AS n_cross FROM linked WHERE src_grade <> tgt_grade")
_add("g16_grade_nodes", lambda s, d: concept_nodes(s, d).select("grade", "name", F.coalesce(F.nullif(strip("description"), F.lit("")), "name").alias("description")), GRAPH + "SELECT grade, name, coalesce(nullif(" + sql_strip("description") + ", ''), name) AS description FROM nodes")
_add("g17_chapter_relations", lambda s, d: joins.with_ends(_chapter_edges(s, d).select(F.lit("g").alias("src_grade"), F.col("u").alias("src"), F.lit("g").alias("tgt_grade"), F.col("v").alias("tgt")), _chapter_edges(s, d).select(F.lit("g").alias("grade"), F.col("u").alias("name")).distinct()).select("src", "tgt", F.lit("PRASYARAT").alias("rel_type")), _CH + "SELECT u AS src, v AS tgt, 'PRASYARAT' AS rel_type FROM e WHERE v IN (SELECT u FROM e)")

# joins ------------------------------------------------------------------------
_add("j8_target_kind", lambda s, d: joins.target_kind(concept_edges(s, d), concept_nodes(s, d)).select("rel_id", "tgt_label"), GRAPH + "SELECT e.rel_id, CASE WHEN n.name IS NULL THEN 'ConceptTarget' ELSE 'Concept' END AS tgt_label FROM edges e LEFT JOIN nodes n ON n.grade = e.tgt_grade AND n.name = e.tgt WHERE NOT coalesce(e.src_grade = e.tgt_grade AND e.src = e.tgt, false)")
_add("j9_with_ends", lambda s, d: linked_edges(s, d).select("rel_id", "src_grade", "src", "rel_type", "tgt_grade", "tgt"), GRAPH + "SELECT rel_id, src_grade, src, rel_type, tgt_grade, tgt FROM linked")
_add("j10_cross_links", lambda s, d: joins.cross_links(concept_edges(s, d), table(s, d, "books").select(F.col("name").alias("grade"))).groupBy("why").agg(F.count(F.lit(1)).alias("n")), GRAPH + "SELECT why, count(*) AS n FROM (SELECT CASE WHEN trim(coalesce(tgt, '')) = '' OR trim(coalesce(tgt_grade, '')) = '' THEN 'incomplete' WHEN src_grade = tgt_grade THEN 'same_grade' WHEN tgt_grade NOT IN (SELECT name FROM books) THEN 'unknown_grade' ELSE 'created' END AS why FROM edges) GROUP BY why")


def _uses(s, d):
    v = table(s, d, "konsep").dropDuplicates(["konsep_id"]).select("konsep_id", F.explode("variables").alias("raw"))
    return v.select(F.col("konsep_id").alias("concept"), F.concat_ws(" ", variable("raw")["name"], variable("raw")["label"], variable("raw")["unit"]).alias("variable"))


_var = "^([^\\s(]+)\\s*\\(([^,)]+)(?:,\\s*([^)]+))?\\)"
_USES = f"WITH u AS (SELECT DISTINCT konsep_id AS concept, CASE WHEN regexp_matches(raw, '{_var}') THEN concat_ws(' ', nullif(trim(regexp_extract(raw, '{_var}', 1)), ''), nullif(trim(regexp_extract(raw, '{_var}', 2)), ''), nullif(trim(regexp_extract(raw, '{_var}', 3)), '')) ELSE raw END AS variable FROM (SELECT konsep_id, {sql_strip('unnest(variables)')} AS raw FROM (SELECT konsep_id, any_value(variables) AS variables FROM konsep GROUP BY konsep_id)))"
_add("j11_shared_variables", lambda s, d: joins.sharing(_uses(s, d)), _USES + " SELECT * FROM (SELECT variable, lag(concept) OVER (PARTITION BY variable ORDER BY concept) AS a, concept AS b, count(*) OVER (PARTITION BY variable) AS n_users FROM u) WHERE a IS NOT NULL")
_add("j15_optional_children", lambda s, d: joins.optional_children(table(s, d, "konsep").where(F.col("deleted_at").isNull()).select("konsep_id").distinct(), table(s, d, "subkonsep"), "konsep_id", "sub_id").fillna(0, ["first_item"]), "SELECT k.konsep_id, count(DISTINCT s.sub_id) AS n_items, coalesce(min(s.sub_id), 0) AS first_item FROM (SELECT DISTINCT konsep_id FROM konsep WHERE deleted_at IS NULL) k LEFT JOIN subkonsep s ON s.konsep_id = k.konsep_id GROUP BY 1")


def _chapters(s, d):
    k = table(s, d, "konsep").where(F.col("bab").isNotNull()).groupBy("book_id", "bab").agg((F.min("konsep_id") % 200 + 1).cast("int").alias("page_start"))
    return k.select(F.col("book_id").alias("book"), F.col("bab").alias("chapter"), "page_start")


_CHAP = "WITH c AS (SELECT book_id AS book, bab AS chapter, CAST(min(konsep_id) % 200 + 1 AS INTEGER) AS page_start FROM konsep WHERE bab IS NOT NULL GROUP BY ALL), w AS (SELECT book, chapter, page_start, lag(chapter) OVER o AS previous, lead(chapter) OVER o AS next, coalesce(lead(page_start) OVER o, 10000) AS page_end FROM c WINDOW o AS (PARTITION BY book ORDER BY page_start, chapter))"
_add("w1_chapter_order", lambda s, d: books.chapter_order(_chapters(s, d)), _CHAP + "SELECT * FROM w")


def _pages(s, d):
    t = table(s, d, "book_texts").dropDuplicates(["text_id"]).where(F.col("page_label").rlike("^[0-9]+$"))
    return t.select(F.col("book_id").alias("book"), F.col("text_id").alias("page_id"), F.col("page_label").cast("int").alias("page"))


_add("j16_page_chapter", lambda s, d: books.page_chapter(_pages(s, d), books.chapter_order(_chapters(s, d))), _CHAP + ", p AS (SELECT DISTINCT book_id AS book, text_id AS page_id, CAST(page_label AS INTEGER) AS page FROM book_texts WHERE regexp_full_match(page_label, '[0-9]+')) SELECT p.book, p.page_id, p.page, (SELECT arg_max(w.chapter, (w.page_start, w.chapter)) FROM w WHERE w.book = p.book AND w.page_start <= p.page) AS chapter FROM p")
_add("j17_token_links", lambda s, d: books.token_links(table(s, d, "konsep").dropDuplicates(["konsep_id"]).select(F.col("konsep_id").alias("id"), F.col("book_id").alias("book"), F.concat_ws(" ", "name", "description").alias("text")), asked=F.col("id") % 50 == 0), f"""WITH k AS (SELECT konsep_id AS id, any_value(book_id) AS book, list_distinct(list_filter(regexp_extract_all(lower(concat_ws(' ', any_value(name), any_value(description))), '[a-z0-9]+'), lambda t: length(t) >= 4 AND t NOT IN ({sql_list(vocab.TOKEN_STOPWORDS)}))) AS toks FROM konsep GROUP BY 1),
f AS (SELECT id, book, unnest(toks) AS t FROM k),
s AS (SELECT a.id AS a, b.id AS b, count(*) AS n_shared FROM f a JOIN f b ON a.t = b.t AND a.book <> b.book AND a.id <> b.id WHERE a.id % 50 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n_shared DESC, b) AS rank FROM s WHERE n_shared >= 2) SELECT a, b, n_shared, rank FROM r WHERE rank <= 2""")
_add("j19_without_children", lambda s, d: joins.without_children(table(s, d, "konsep").select("konsep_id").distinct(), table(s, d, "subkonsep").where(F.col("konsep_id").isNotNull()), ["konsep_id"]), "SELECT DISTINCT konsep_id FROM konsep WHERE konsep_id NOT IN (SELECT konsep_id FROM subkonsep WHERE konsep_id IS NOT NULL)")
_add("j20_shared_targets", lambda s, d: _shared(s, d))


def _shared(s, d):
    from rajut.operators.models import shared_targets

    c = graph.contexts(concept_nodes(s, d), linked_edges(s, d))
    e = linked_edges(s, d).where((F.col("src") != F.col("tgt")) | (F.col("src_grade") != F.col("tgt_grade")))
    side = lambda g, n, o: c.select(F.col("grade").alias(g), F.col("name").alias(n), F.col("out_edges").alias(o))
    both = e.join(side("src_grade", "src", "oa"), ["src_grade", "src"]).join(side("tgt_grade", "tgt", "ob"), ["tgt_grade", "tgt"])
    return both.select("rel_id", F.array_join(shared_targets(F.col("oa"), F.col("ob")), ";").alias("shared")).where(F.col("shared") != "")


ORACLE["j20_shared_targets"] = once(GRAPH + _TOP + ", x AS (SELECT DISTINCT e.rel_id, p.tgt AS t FROM linked e JOIN o p ON p.src_grade = e.src_grade AND p.src = e.src AND p.pos <= 5 JOIN o q ON q.src_grade = e.tgt_grade AND q.src = e.tgt AND q.pos <= 5 AND q.tgt = p.tgt WHERE e.src <> e.tgt OR e.src_grade <> e.tgt_grade) SELECT rel_id, string_agg(t, ';' ORDER BY t) AS shared FROM x GROUP BY rel_id")

# distributions ----------------------------------------------------------------
_add("a8_graph_counts", lambda s, d: a.count_where(concept_edges(s, d), typed=F.col("rel_type").isNotNull(), cross=F.col("src_grade") != F.col("tgt_grade"), scored=F.col("confidence").isNotNull(), wrong=F.coalesce("consensus", "status") == "wrong"), GRAPH + "SELECT count(*) AS n, count(rel_type) AS typed, count(CASE WHEN src_grade <> tgt_grade THEN 1 END) AS cross, count(confidence) AS scored, count(CASE WHEN coalesce(consensus, status) = 'wrong' THEN 1 END) AS wrong FROM edges".replace("AS cross,", 'AS "cross",'))
_add("a9_embedding_coverage", lambda s, d: a.embedding_coverage(table(s, d, "concepts").dropDuplicates(["concept_id"])), "SELECT count(*) AS n_total, count(embedding) AS n_embedded, count(DISTINCT embedding_model) AS n_models FROM (SELECT concept_id, any_value(embedding) AS embedding, any_value(embedding_model) AS embedding_model FROM concepts GROUP BY 1)")
_add("a10_concepts_per_book", lambda s, d: a.children_per(table(s, d, "books"), table(s, d, "konsep"), "book_id", "konsep_id"), "SELECT b.book_id, count(DISTINCT k.konsep_id) AS n FROM books b LEFT JOIN konsep k ON k.book_id = b.book_id GROUP BY 1")
_add("a11_type_distribution", lambda s, d: a.type_distribution(relations(s, d)), "SELECT rel_type, graph_role, count(DISTINCT rel_id) AS n FROM relations GROUP BY ALL")
_add("a12_label_counts", lambda s, d: concept_nodes(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")).unionByName(linked_edges(s, d).agg(F.count(F.lit(1)).alias("n")).withColumn("label", F.lit("relationships"))), GRAPH + "SELECT 'Concept' AS label, count(*) AS n FROM nodes UNION ALL SELECT 'relationships', count(*) FROM linked")
_add("a13_confidence_by_type", lambda s, d: a.confidence_by_type(concept_edges(s, d)).select("rel_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "least", "most")]), GRAPH + 'SELECT rel_type, count(*) AS n, round(avg(confidence), 6) AS mean, round(median(confidence), 6) AS median, round(min(confidence), 6) AS "least", round(max(confidence), 6) AS most FROM edges WHERE confidence IS NOT NULL GROUP BY rel_type')
_add("a14_direction", lambda s, d: a.direction_distribution(concept_edges(s, d), "BERGANTUNG_PADA").withColumn("share", F.round("share", 6)), GRAPH + "SELECT src_grade, tgt_grade, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM edges WHERE rel_type = 'BERGANTUNG_PADA' GROUP BY ALL")
_add("a15_bridges", lambda s, d: a.bridges(concept_edges(s, d)), GRAPH + ", r AS (SELECT src_grade AS grade, src AS name, tgt_grade AS other FROM edges UNION ALL SELECT tgt_grade, tgt, src_grade FROM edges) SELECT grade, name, count(DISTINCT other) AS reach FROM r WHERE other <> grade GROUP BY ALL HAVING count(DISTINCT other) >= 2 ORDER BY reach DESC, grade, name LIMIT 10")
_add("a16_touched", lambda s, d: a.touched(concept_nodes(s, d), linked_edges(s, d)).withColumn("share", F.round("share", 6)), GRAPH + _DEG + "SELECT count(CASE WHEN degree > 0 THEN 1 END) AS n_touched, count(*) AS n_nodes, round(count(CASE WHEN degree > 0 THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS share FROM deg")


def _survey(s, d):
    r = relations(s, d)
    return r.select("rel_id", F.coalesce(r["rel_type"], F.lit("-")).alias("rel_type"), "confidence", F.when(F.col("status") == "wrong", "Tidak").otherwise("Ya").alias("valid"), F.when(F.col("consensus") == "partial", "Salah").otherwise("Benar").alias("type_ok"), F.when(F.col("tgt_grade").isNull(), "NA").when(F.col("tgt_grade") == F.col("src_grade"), "Benar").otherwise("Terbalik").alias("direction"))


_SURVEY = "WITH s AS (SELECT DISTINCT rel_id, coalesce(rel_type, '-') AS rel_type, confidence, CASE WHEN status = 'wrong' THEN 'Tidak' ELSE 'Ya' END AS valid, CASE WHEN consensus = 'partial' THEN 'Salah' ELSE 'Benar' END AS type_ok, CASE WHEN tgt_grade IS NULL THEN 'NA' WHEN tgt_grade = src_grade THEN 'Benar' ELSE 'Terbalik' END AS direction FROM relations)"
_RATES = "count(*) AS n, round(count(CASE WHEN valid = 'Ya' THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS validity, round(count(CASE WHEN type_ok = 'Benar' THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS type_rate, round(coalesce(count(CASE WHEN direction = 'Benar' THEN 1 END) / CAST(nullif(count(CASE WHEN direction <> 'NA' THEN 1 END), 0) AS DOUBLE), 0), 6) AS direction_rate"
_rounded = ("validity", "type_rate", "direction_rate")


def _round(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


_add("a17_survey_rates", lambda s, d: _round(a.survey_rates(_survey(s, d)), *_rounded), _SURVEY + f"SELECT {_RATES} FROM s")
_add("a18_type_shares", lambda s, d: _round(a.shares(_survey(s, d), ["rel_type", "direction"]), "share"), _SURVEY + "SELECT rel_type, direction, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM s GROUP BY ALL")
_add("a18_direction_by_type", lambda s, d: _round(a.survey_rates(_survey(s, d), ["rel_type"]), *_rounded), _SURVEY + f"SELECT rel_type, {_RATES} FROM s GROUP BY rel_type")
_add("a19_confidence_bands", lambda s, d: _round(a.survey_rates(_survey(s, d).withColumn("band", confidence_band("confidence")), ["band"]), *_rounded), _SURVEY + f"SELECT CASE WHEN confidence < 0.5 THEN '<0.5' WHEN confidence < 0.7 THEN '[0.5,0.7)' WHEN confidence < 0.85 THEN '[0.7,0.85)' WHEN confidence < 1 THEN '[0.85,1)' WHEN confidence = 1 THEN '=1' END AS band, {_RATES} FROM s GROUP BY 1")
_add("a21_totals_by_book", lambda s, d: a.totals_by(relations(s, d), "book_id", "status", ["correct", "wrong", "partial"]), "SELECT book_id, " + ", ".join(f"count(DISTINCT CASE WHEN status = '{x}' THEN rel_id END) AS {x}" for x in ("correct", "wrong", "partial")) + " FROM relations GROUP BY book_id")
_add("a22_counters", lambda s, d: a.count_where(relations(s, d), ["book_id"], blank_target=F.coalesce(F.trim("target"), F.lit("")) == "", late=F.col("ingested_at") > F.col("created_at") + F.expr("interval 7 days")), "SELECT book_id, count(*) AS n, count(CASE WHEN coalesce(trim(target), '') = '' THEN 1 END) AS blank_target, count(CASE WHEN ingested_at > created_at + INTERVAL 7 DAY THEN 1 END) AS late FROM (SELECT DISTINCT rel_id, book_id, target, ingested_at, created_at FROM relations) GROUP BY book_id")
_add("a23_collected_types", lambda s, d: _types(a.collected(table(s, d, "relations").where(F.col("rel_type").isNotNull()), ["src_grade"], "rel_type")), "SELECT src_grade, count(*) AS n_items, string_agg(rel_type, ';' ORDER BY rel_type) AS types FROM (SELECT DISTINCT src_grade, rel_type FROM relations WHERE rel_type IS NOT NULL) GROUP BY src_grade")
_add("s16_labelled_nodes", lambda s, d: concept_nodes(s, d).select("label", "grade", "name"), GRAPH + "SELECT 'Concept' AS label, grade, name FROM nodes")


def _types(parts):
    """One row per grade, as its SQL has it: the parts one after the other."""
    whole = parts.groupBy("src_grade").agg(F.max("n_items").alias("n_items"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "items"))), lambda x: x["items"])).alias("items"))
    return whole.select("src_grade", "n_items", F.array_join(F.transform("items", lambda x: x["rel_type"]), ";").alias("types"))


def _neighbourhood(s, d):
    both = linked_edges(s, d).select("src_grade", "src", "tgt_grade", "tgt")
    turned = both.select(F.col("tgt_grade").alias("src_grade"), F.col("tgt").alias("src"), F.col("src_grade").alias("tgt_grade"), F.col("src").alias("tgt"))
    near = both.unionByName(turned).where((F.col("src_grade") == "Kimia Kelas X") & (F.col("tgt_grade") == "Kimia Kelas X")).select(F.col("src").alias("name"), F.col("tgt").alias("neighbour")).distinct()
    return concept_nodes(s, d).where(F.col("grade") == "Kimia Kelas X").select("name").join(near, "name", "left")


_add("s17_subject_extract", _neighbourhood, GRAPH + ", b AS (SELECT src AS name, tgt AS neighbour FROM linked WHERE src_grade = 'Kimia Kelas X' AND tgt_grade = 'Kimia Kelas X' UNION SELECT tgt, src FROM linked WHERE src_grade = 'Kimia Kelas X' AND tgt_grade = 'Kimia Kelas X') SELECT n.name, b.neighbour FROM nodes n LEFT JOIN b ON b.name = n.name WHERE n.grade = 'Kimia Kelas X'")
def _labels(s, d):
    """Nodes of every label with their number: concepts, and the documents and chapters they are in."""
    c = concept_nodes(s, d)
    shelf = c.select(F.explode(F.array(F.struct(F.lit("Document").alias("label"), F.col("grade").alias("a"), F.lit("").alias("b")), F.struct(F.lit("Bab").alias("label"), F.col("grade").alias("a"), F.col("chapter").alias("b")))).alias("v")).select("v.*").where(F.coalesce("b", F.lit("-")) != "-").distinct()
    return c.select("label").unionByName(shelf.select("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_add("s18_labels", _labels, GRAPH + "SELECT 'Concept' AS label, count(*) AS n FROM nodes HAVING count(*) > 0 UNION ALL SELECT 'Document', count(DISTINCT grade) FROM nodes HAVING count(*) > 0 UNION ALL SELECT 'Bab', count(DISTINCT (grade, chapter)) FROM nodes WHERE chapter IS NOT NULL HAVING count(*) > 0")
_add("u1_union_names", lambda s, d: table(s, d, "konsep").select(alike_key("name").alias("name")).union(table(s, d, "subkonsep").select(alike_key("name"))).distinct(), "SELECT lower(regexp_replace(name, '[^\\p{L}\\p{N}]', '', 'g')) AS name FROM konsep UNION SELECT lower(regexp_replace(name, '[^\\p{L}\\p{N}]', '', 'g')) FROM subkonsep")
_add("u2_bucket_concat", lambda s, d: table(s, d, "triples").dropDuplicates(["triple_id"]).select("triple_id", "source").unionByName(relations(s, d).select(F.col("rel_id").alias("triple_id"), "provenance"), allowMissingColumns=True), "SELECT DISTINCT triple_id, source, NULL AS provenance, 't' AS z FROM triples UNION ALL SELECT DISTINCT rel_id, NULL, provenance, 'r' FROM relations")
ORACLE["u2_bucket_concat"] = "SELECT triple_id, source, CAST(provenance AS VARCHAR) AS provenance FROM (" + ORACLE["u2_bucket_concat"] + ")"
_add("u3_difference", lambda s, d: table(s, d, "konsep").select(alike_key("name").alias("name")).subtract(table(s, d, "glosarium").select(alike_key("term"))), "SELECT DISTINCT lower(regexp_replace(name, '[^\\p{L}\\p{N}]', '', 'g')) AS name FROM konsep EXCEPT SELECT lower(regexp_replace(term, '[^\\p{L}\\p{N}]', '', 'g')) FROM glosarium")
_add("o1_gold_order", lambda s, d: _positions(s, d), "SELECT triple_id, row_number() OVER (PARTITION BY book_id ORDER BY triple_id, source, chapter, subject, relation, target) AS pos FROM (SELECT DISTINCT triple_id, book_id, source, chapter, subject, relation, target FROM triples)")
_add("o6_type_histogram", lambda s, d: concept_edges(s, d).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rel_type"), GRAPH + "SELECT rel_type, count(*) AS n FROM edges GROUP BY rel_type ORDER BY n DESC, rel_type")
_add("o3_grades", lambda s, d: table(s, d, "books").select(F.col("name").alias("grade")).distinct().orderBy("grade"), "SELECT DISTINCT name AS grade FROM books ORDER BY grade")
_add("o4_typed_order", lambda s, d: concept_edges(s, d).select("rel_type", "src", "rel_id").orderBy("rel_type", "src", "rel_id"), GRAPH + "SELECT rel_type, src, rel_id FROM edges ORDER BY rel_type, src, rel_id")


def _positions(s, d):
    from pyspark.sql import Window

    t = table(s, d, "triples").dropDuplicates(["triple_id"])
    return t.select("triple_id", F.row_number().over(Window.partitionBy("book_id").orderBy(F.asc_nulls_last("triple_id"), "source", "chapter", "subject", "relation", "target")).alias("pos"))
