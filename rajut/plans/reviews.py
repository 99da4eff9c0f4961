"""Queries of rater alignment, agreement, scores, judging and write-back."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from rajut.functions import normalize as n
from rajut.functions import vocab
from rajut.operators import agreement as g
from rajut.operators import books, joins, models, upsert
from rajut.plans.data import table
from rajut.plans.views import once, relations, sql_case, sql_list, sql_squeeze, sql_strip

QUERIES, ORACLE = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE[name] = once(sql)


def submissions(s, d):
    """The latest submission of each reviewer and batch."""
    ev = table(s, d, "expert_validation").dropDuplicates(["validation_id"])
    w = Window.partitionBy("reviewer", "batch_id").orderBy(F.desc_nulls_last("updated_at"), F.desc("validation_id"))
    return ev.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def ratings(s, d):
    """triple_id, reviewer, side (r1: odd reviewers, r2: even ones), rating."""
    rows = submissions(s, d).select("reviewer", F.explode("ratings").alias("k", "v")).select(n.triple_number(n.triple_key("k")).alias("triple_id"), "reviewer", n.rating_label("v").alias("rating"))
    one = rows.where(F.col("triple_id").isNotNull()).groupBy("triple_id", "reviewer").agg(F.min("rating").alias("rating"))
    return one.withColumn("side", F.when(F.regexp_extract("reviewer", "([0-9]+)", 1).cast("int") % 2 == 1, "r1").otherwise("r2"))


def sides(s, d):
    """One rating per triple and side, that of the first reviewer of the side."""
    one = ratings(s, d).groupBy("triple_id", "side").agg(F.min_by("rating", "reviewer").alias("rating"))
    return tuple(one.where(F.col("side") == x).select("triple_id", "rating") for x in ("r1", "r2"))


def proposals(s, d):
    rows = submissions(s, d).select("reviewer", F.explode("missing_triples").alias("m")).select("reviewer", "m.*")
    side = F.when(F.regexp_extract("reviewer", "([0-9]+)", 1).cast("int") % 2 == 1, "r1").otherwise("r2")
    clean = rows.select(side.alias("side"), *[n.content_key(c)["k0"].alias(c) for c in g.KEYS])
    return tuple(clean.where(F.col("side") == x).drop("side") for x in ("r1", "r2"))


_low = f"lower({sql_strip('v')})"
_alias = sql_case(_low, vocab.LABEL_ALIASES, _low)
_key = f"regexp_replace(regexp_replace({sql_strip('k')}, '\\.0$', ''), '^0+(.)', '\\1')"
_SUBS = "WITH subs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reviewer, batch_id ORDER BY updated_at DESC NULLS LAST, validation_id DESC) AS rn FROM (SELECT validation_id, any_value(reviewer) AS reviewer, any_value(batch_id) AS batch_id, any_value(ratings) AS ratings, any_value(missing_triples) AS missing_triples, any_value(comments) AS comments, any_value(updated_at) AS updated_at FROM expert_validation GROUP BY validation_id)) WHERE rn = 1)"
_RAT = (
    _SUBS
    + f", raw AS (SELECT reviewer, e.key AS k, e.value AS v FROM (SELECT reviewer, unnest(map_entries(ratings)) AS e FROM subs)), rat AS (SELECT try_cast({_key} AS BIGINT) AS triple_id, reviewer, min(CASE WHEN {_alias} IN ({sql_list(vocab.LABELS)}) THEN {_alias} ELSE 'unknown' END) AS rating, CASE WHEN CAST(regexp_extract(reviewer, '([0-9]+)', 1) AS INTEGER) % 2 = 1 THEN 'r1' ELSE 'r2' END AS side FROM raw WHERE regexp_full_match({_key}, '[0-9]+') GROUP BY ALL)"
    + ", one AS (SELECT triple_id, side, arg_min(rating, reviewer) AS rating FROM rat GROUP BY ALL), r1 AS (SELECT triple_id, rating FROM one WHERE side = 'r1'), r2 AS (SELECT triple_id, rating FROM one WHERE side = 'r2')"
    + ", al AS (SELECT coalesce(r1.triple_id, r2.triple_id) AS triple_id, coalesce(r1.rating, 'unknown') AS r1_rating, coalesce(r2.rating, 'unknown') AS r2_rating FROM r1 FULL JOIN r2 ON r1.triple_id = r2.triple_id)"
    + f", com AS (SELECT r1.triple_id, r1.rating AS r1_rating, r2.rating AS r2_rating FROM r1 JOIN r2 ON r1.triple_id = r2.triple_id WHERE r1.rating IN ({sql_list(vocab.SCORED_LABELS)}) AND r2.rating IN ({sql_list(vocab.SCORED_LABELS)}))"
)


_PROP = _SUBS + ", prop AS (SELECT CASE WHEN CAST(regexp_extract(reviewer, '([0-9]+)', 1) AS INTEGER) % 2 = 1 THEN 'r1' ELSE 'r2' END AS side, " + ", ".join(f"{sql_squeeze('m.' + c)} AS {c}" for c in g.KEYS) + " FROM (SELECT reviewer, unnest(missing_triples) AS m FROM subs)), m1 AS (SELECT " + ", ".join(g.KEYS) + " FROM prop WHERE side = 'r1' AND chapter <> '' AND subject <> '' AND relation <> '' AND target <> ''), m2 AS (SELECT " + ", ".join(g.KEYS) + " FROM prop WHERE side = 'r2' AND chapter <> '' AND subject <> '' AND relation <> '' AND target <> '')"

_add("j1_align_raters", lambda s, d: g.align_raters(*sides(s, d)), _RAT + "SELECT * FROM al")
_add("j2_common_ratings", lambda s, d: g.common_ratings(*sides(s, d)), _RAT + "SELECT * FROM com")
_add("j3_with_context", lambda s, d: g.with_context(g.align_raters(*sides(s, d)), table(s, d, "triples").dropDuplicates(["triple_id"]))[0].select("triple_id", "r1_rating", "r2_rating", "subject", "target"), _RAT + "SELECT DISTINCT al.triple_id, r1_rating, r2_rating, subject, target FROM al JOIN triples USING (triple_id)")
_add("j3_unmapped", lambda s, d: g.with_context(g.align_raters(*sides(s, d)), table(s, d, "triples").dropDuplicates(["triple_id"]))[1].select("triple_id"), _RAT + "SELECT triple_id FROM al WHERE triple_id NOT IN (SELECT triple_id FROM triples)")
_add("j4_missing_agreed", lambda s, d: g.missing_agreed(*proposals(s, d)), _PROP + "SELECT DISTINCT * FROM m1 INTERSECT SELECT * FROM m2")
_K = ", ".join(g.KEYS)
_add("j5_missing_disagreed", lambda s, d: g.missing_disagreed(*proposals(s, d)), _PROP + f"SELECT *, 'r1' AS reviewer FROM m1 WHERE ({_K}) NOT IN (SELECT ({_K}) FROM m2) UNION ALL SELECT *, 'r2' FROM m2 WHERE ({_K}) NOT IN (SELECT ({_K}) FROM m1)".replace("NOT IN (SELECT (", "NOT IN (SELECT row(").replace(f"WHERE ({_K})", f"WHERE row({_K})"))


def _apply_gold(s, d):
    rel = table(s, d, "triples").dropDuplicates(["triple_id"]).select(F.col("triple_id").alias("ord"), "subject", "relation", "target")
    gold = table(s, d, "triples").dropDuplicates(["triple_id"]).where(F.col("final_consensus_label").isNotNull()).select(F.col("triple_id").alias("ord"), "subject", "relation", "target", F.col("final_consensus_label").alias("label"))
    return g.apply_gold(rel, gold).select("ord", "gold_label")


_add("j6_apply_gold", _apply_gold, f"WITH t AS (SELECT DISTINCT triple_id, {sql_squeeze('subject')} AS a, {sql_squeeze('relation')} AS b, {sql_squeeze('target')} AS c, final_consensus_label AS l FROM triples), f AS (SELECT a, b, c, min(triple_id) AS o FROM t GROUP BY ALL), g AS (SELECT a, b, c, arg_max(l, triple_id) AS gold_label FROM t WHERE l IS NOT NULL GROUP BY ALL) SELECT t.triple_id AS ord, CASE WHEN f.o = t.triple_id THEN g.gold_label END AS gold_label FROM t JOIN f USING (a, b, c) LEFT JOIN g USING (a, b, c)")


def _comments(s, d):
    c = submissions(s, d).select(F.explode("comments").alias("raw_id", "comment"))
    return joins.comments_of(table(s, d, "triples").select("triple_id").distinct(), c).where(F.col("comment").isNotNull())


_add("j7_comments", _comments, _SUBS + f", raw AS (SELECT e.key AS k, {sql_strip('e.value')} AS comment FROM (SELECT unnest(map_entries(comments)) AS e FROM subs)), c AS (SELECT {_key} AS k, min(comment) AS comment FROM raw WHERE coalesce(comment, '') <> '' GROUP BY 1) SELECT DISTINCT t.triple_id, c.comment FROM triples t JOIN c ON c.k = CAST(t.triple_id AS VARCHAR)")
_add("a1_split_agreed", lambda s, d: g.split_agreed(g.align_raters(*sides(s, d))).groupBy("bucket", "final_consensus_label").agg(F.count(F.lit(1)).alias("n")), _RAT + "SELECT CASE WHEN r1_rating = r2_rating AND r1_rating <> 'unknown' THEN 'ratings_agreed' ELSE 'ratings_disagreed_llm' END AS bucket, CASE WHEN r1_rating = r2_rating AND r1_rating <> 'unknown' THEN r1_rating END AS final_consensus_label, count(*) AS n FROM al GROUP BY ALL")

def _ac1_sql(by: str, src: str) -> str:
    parts = ", ".join(f"(count(CASE WHEN r1_rating = '{x}' THEN 1 END) + count(CASE WHEN r2_rating = '{x}' THEN 1 END)) / (2.0 * count(*)) AS p{i}" for i, x in enumerate(vocab.SCORED_LABELS))
    grp = f"GROUP BY {by}" if by else ""
    pick = f"{by}, " if by else ""
    return f"SELECT {pick}n, round(pa, 6) AS pa, round(pe, 6) AS pe, round(CASE WHEN n = 0 OR pe = 1 THEN 0 ELSE (pa - pe) / (1 - pe) END, 6) AS ac1 FROM (SELECT *, ({' + '.join(f'(p{i} * (1 - p{i}))' for i in range(4))}) / 3 AS pe FROM (SELECT {pick}count(*) AS n, count(CASE WHEN r1_rating = r2_rating THEN 1 END) / CAST(count(*) AS DOUBLE) AS pa, {parts} FROM {src} {grp}))"


def _round(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


def _common_by_subject(s, d):
    t = table(s, d, "triples").dropDuplicates(["triple_id"]).join(F.broadcast(table(s, d, "books").select("book_id", n.subject_of("name").alias("course"))), "book_id").select("triple_id", "course")
    return g.common_ratings(*sides(s, d)).join(t, "triple_id")


_BY = ", cs AS (SELECT com.*, regexp_replace(b.name, ' Kelas (XII|XI|X)$', '') AS course FROM com JOIN (SELECT DISTINCT triple_id, book_id FROM triples) t USING (triple_id) JOIN books b USING (book_id)), ov AS (SELECT * FROM cs UNION ALL SELECT triple_id, r1_rating, r2_rating, 'Overall' FROM cs)"
_add("a2_gwet_ac1", lambda s, d: _round(g.gwet(g.common_ratings(*sides(s, d))), "pa", "pe", "ac1"), _RAT + _ac1_sql("", "com"))
_add("a3_ac1_by_subject", lambda s, d: _round(g.gwet(g.with_overall(_common_by_subject(s, d), "course"), ["course"]), "pa", "pe", "ac1"), _RAT + _BY + _ac1_sql("course", "ov"))


def _label_rows(s, d):
    """course, actor, label, weight: ratings of both sides, proposals as 'added'."""
    t = table(s, d, "triples").dropDuplicates(["triple_id"]).join(F.broadcast(table(s, d, "books").select("book_id", n.subject_of("name").alias("course"))), "book_id").select("triple_id", "course")
    rated = ratings(s, d).join(t, "triple_id").select("course", F.col("side").alias("actor"), F.col("rating").alias("label"), F.lit(1).alias("weight"))
    books_ = table(s, d, "books").select("book_id", n.subject_of("name").alias("course"))
    added = submissions(s, d).join(F.broadcast(books_), "book_id").select("course", F.when(F.regexp_extract("reviewer", "([0-9]+)", 1).cast("int") % 2 == 1, "r1").otherwise("r2").alias("actor"), F.lit("added").alias("label"), F.coalesce(F.size("missing_triples"), F.lit(0)).alias("weight"))
    return rated.unionByName(added.where(F.col("weight") > 0))


_SUBS_B = _RAT.replace("any_value(updated_at) AS updated_at", "any_value(updated_at) AS updated_at, any_value(book_id) AS book_id")
_LAB = ", bk AS (SELECT book_id, regexp_replace(name, ' Kelas (XII|XI|X)$', '') AS course FROM books), lab AS (SELECT course, side AS actor, rating AS label, 1 AS weight FROM rat JOIN (SELECT DISTINCT triple_id, book_id FROM triples) t USING (triple_id) JOIN bk USING (book_id) UNION ALL SELECT course, CASE WHEN CAST(regexp_extract(reviewer, '([0-9]+)', 1) AS INTEGER) % 2 = 1 THEN 'r1' ELSE 'r2' END, 'added', len(missing_triples) FROM subs JOIN bk USING (book_id)), lo AS (SELECT * FROM lab UNION ALL SELECT 'Overall', actor, label, weight FROM lab), c AS (SELECT course, actor, " + ", ".join(f"sum(CASE WHEN label = '{x}' THEN weight ELSE 0 END) AS {y}" for x, y in (("correct", "correct"), ("partial", '"partial"'), ("wrong", "wrong"), ("missing", "missing"), ("added", "n_missing"))) + " FROM lo GROUP BY ALL), sc AS (SELECT *, correct + 0.5 * \"partial\" + 0.25 * missing AS score FROM c), pr AS (SELECT *, coalesce(score / nullif(CAST(correct + \"partial\" + wrong + missing AS DOUBLE), 0), 0) AS p, coalesce(score / nullif(CAST(correct + \"partial\" + missing + n_missing AS DOUBLE), 0), 0) AS r FROM sc) "
_add("a4_graded_scores", lambda s, d: _round(g.graded_scores(g.with_overall(_label_rows(s, d), "course"), ["course", "actor"]), "precision", "recall", "f1").select("course", "actor", "precision", "recall", "f1"), _SUBS_B + _LAB + 'SELECT course, actor, round(p, 6) AS "precision", round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM pr')
_add("a5_score_counts", lambda s, d: g.graded_scores(g.with_overall(_label_rows(s, d), "course"), ["course", "actor"]).select("course", "actor", *[F.col(c).cast("double").alias(c) for c in ("correct", "wrong", "n_missing")]), _SUBS_B + _LAB + "SELECT course, actor, CAST(correct AS DOUBLE) AS correct, CAST(wrong AS DOUBLE) AS wrong, CAST(n_missing AS DOUBLE) AS n_missing FROM c")
_add("a6_accepted_missing", lambda s, d: g.accepted_missing(table(s, d, "triples").dropDuplicates(["triple_id"]).select(F.when(F.col("source") != "manual_addition", F.col("triple_id")).alias("triple_id"), F.col("final_consensus_label").alias("label"))), "SELECT count(DISTINCT triple_id) AS n_accepted FROM triples WHERE source = 'manual_addition' AND coalesce(final_consensus_label, '') NOT IN ('', 'abaikan', 'unknown')")
_add("a7_course_summary", lambda s, d: ratings(s, d).groupBy("side").agg(F.count(F.lit(1)).alias("n_ratings"), F.countDistinct("triple_id").alias("n_triples"), F.countDistinct("reviewer").alias("n_reviewers")), _RAT + "SELECT side, count(*) AS n_ratings, count(DISTINCT triple_id) AS n_triples, count(DISTINCT reviewer) AS n_reviewers FROM rat GROUP BY side")


def _budget(s, d):
    t = table(s, d, "triples").dropDuplicates(["triple_id"]).select("book_id", "triple_id")
    return g.within_budget(t, [F.col("book_id"), F.col("triple_id")], 100).select("triple_id", "ordinal", "in_budget")


_add("w7_budget", _budget, "SELECT triple_id, row_number() OVER (ORDER BY book_id, triple_id) - 1 AS ordinal, row_number() OVER (ORDER BY book_id, triple_id) <= 100 AS in_budget FROM (SELECT DISTINCT book_id, triple_id FROM triples)")
_add("m11_added_by", lambda s, d: _added_by(s, d), _PROP + f"SELECT {_K}, concat_ws(';', CASE WHEN max(side = 'r1') THEN 'r1' END, CASE WHEN max(side = 'r2') THEN 'r2' END) AS added_by FROM prop GROUP BY ALL")


def _added_by(s, d):
    a, b = proposals(s, d)
    both = a.withColumn("s", F.lit("r1")).unionByName(b.withColumn("s", F.lit("r2"))).groupBy(*g.KEYS).agg(F.max((F.col("s") == "r1")).alias("f1"), F.max((F.col("s") == "r2")).alias("f2"))
    return both.select(*g.KEYS, F.array_join(g.added_by(("r1", F.col("f1")), ("r2", F.col("f2"))), ";").alias("added_by"))


def _review(s, d):
    sub = submissions(s, d)
    by = lambda odd: sub.where((F.regexp_extract("reviewer", "([0-9]+)", 1).cast("int") % 2 == 1) == odd).groupBy("batch_id").agg(F.min_by(F.struct("ratings", "comments"), "reviewer").alias("v")).select("batch_id", "v.*")
    return upsert.review(by(F.lit(True)), by(F.lit(False)), "batch_id").select("batch_id", F.explode("ratings").alias("triple", "rating"), "comments", F.col("n_reviewers").cast("bigint").alias("n_filled")).select("batch_id", "triple", "rating", F.try_element_at("comments", "triple").alias("comment"), "n_filled")


_add("m8_review_writeback", _review, _SUBS + f", s AS (SELECT *, CAST(regexp_extract(reviewer, '([0-9]+)', 1) AS INTEGER) % 2 = 1 AS odd FROM subs), o AS (SELECT batch_id, odd, v.r AS ratings, v.c AS comments FROM (SELECT batch_id, odd, arg_min({{'r': ratings, 'c': comments}}, reviewer) AS v FROM s GROUP BY ALL)), e AS (SELECT batch_id, odd, x.key AS k, x.value AS v FROM (SELECT batch_id, odd, unnest(map_entries(ratings)) AS x FROM o)), m AS (SELECT batch_id, k, coalesce(max(CASE WHEN NOT odd THEN v END), max(CASE WHEN odd THEN v END)) AS v FROM e WHERE batch_id IN (SELECT batch_id FROM o WHERE odd) GROUP BY ALL), d AS (SELECT batch_id, odd, x.key AS k, x.value AS v FROM (SELECT batch_id, odd, unnest(map_entries(comments)) AS x FROM o)), c AS (SELECT batch_id, k, max(CASE WHEN odd THEN v END) AS a, max(CASE WHEN NOT odd THEN v END) AS b FROM d GROUP BY ALL) SELECT m.batch_id, m.k AS triple, m.v AS rating, CASE WHEN {sql_strip('a')} <> '' THEN a ELSE coalesce(b, a) END AS comment, count(CASE WHEN {sql_strip('coalesce(v, chr(32))')} <> '' THEN 1 END) OVER (PARTITION BY m.batch_id) AS n_filled FROM m LEFT JOIN c ON c.batch_id = m.batch_id AND c.k = m.k")


def _add_missing(s, d):
    t = table(s, d, "triples").dropDuplicates(["triple_id"])
    a, b = proposals(s, d)
    return upsert.add_missing(t.select("chapter"), t.where(F.col("source") == "system_generated").select(*g.KEYS), a.unionByName(b)).select("subject", "relation", "target", "subtopic")


_add("m9_add_missing", _add_missing, _PROP + f", t AS (SELECT DISTINCT triple_id, source, {', '.join(sql_squeeze(c) + ' AS ' + c for c in g.KEYS)} FROM triples), x AS (SELECT DISTINCT subject, relation, target, description FROM prop WHERE chapter IN (SELECT chapter FROM t)) SELECT subject, relation, target, CASE WHEN subject NOT IN (SELECT subject FROM t WHERE source = 'system_generated') THEN 'Expert Proposed Triples' END AS subtopic FROM x WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.source = 'system_generated' AND t.subject = x.subject AND t.relation = x.relation AND t.target = x.target AND t.description = x.description)")


def _judge_client(prompts: list[str]) -> list[str]:
    """A deterministic judge: the prompt's length decides."""
    return ["```json\n" + json.dumps({"reasoning": p[:20], "final_consensus_label": ("correct", "partial", "wrong", "Skip ")[len(p) % 4]}) + "\n```" for p in prompts]


def _judged(s, d):
    t = table(s, d, "triples").dropDuplicates(["triple_id"])
    rows = g.within_budget(t.select("book_id", "triple_id", F.concat_ws(" ", "subject", "relation", "target").alias("prompt"), "final_consensus_label"), [F.col("book_id"), F.col("triple_id")], 300)
    done = t.where(F.col("final_consensus_label").isNotNull()).select(F.col("triple_id").cast("string").alias("key"), F.lit("checkpoint").alias("reasoning"), "final_consensus_label")
    return models.judge(rows.select(F.col("triple_id").cast("string").alias("key"), "ordinal", "prompt"), done, _judge_client, 300).select("key", "label")


_add("l7_judge", _judged, "WITH t AS (SELECT *, row_number() OVER (ORDER BY book_id, triple_id) - 1 AS o, length(concat_ws(' ', subject, relation, target)) % 4 AS m FROM (SELECT DISTINCT triple_id, book_id, subject, relation, target, final_consensus_label AS l FROM triples)) SELECT CAST(triple_id AS VARCHAR) AS key, CASE WHEN l IS NOT NULL THEN l WHEN o >= 300 THEN 'unknown' WHEN m = 0 THEN 'correct' WHEN m = 1 THEN 'partial' WHEN m = 2 THEN 'wrong' ELSE 'abaikan' END AS label FROM t")


class _Flaky:
    """A judge that fails with a passing error on two of three calls."""

    calls = 0

    def __call__(self, prompts: list[str]) -> list[str]:
        self.calls += 1
        if self.calls % 3:
            raise RuntimeError("429 rate limit")
        return _judge_client(prompts)


def _no_wait(seconds: float) -> None:
    pass


def _retried(s, d):
    """All triples judged, none from a checkpoint, by a client that has to be asked again."""
    t = table(s, d, "triples").dropDuplicates(["triple_id"])
    rows = t.select(F.col("triple_id").cast("string").alias("key"), F.lit(0).alias("ordinal"), F.concat_ws(" ", "subject", "relation", "target").alias("prompt"))
    none = rows.select("key", F.lit("").alias("reasoning"), F.lit("").alias("final_consensus_label")).limit(0)
    return models.judge(rows, none, models.with_retry(_Flaky(), sleep=_no_wait)).select("key", "reasoning", "label")


_add("l8_retried_judge", _retried, "SELECT DISTINCT CAST(triple_id AS VARCHAR) AS key, p[1:20] AS reasoning, CASE length(p) % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'partial' WHEN 2 THEN 'wrong' ELSE 'abaikan' END AS label FROM (SELECT triple_id, concat_ws(' ', subject, relation, target) AS p FROM triples)")


def _retrieved(s, d):
    t = table(s, d, "triples").dropDuplicates(["triple_id"]).select(F.col("triple_id").alias("key"), F.col("book_id").alias("book"), "chapter", "subject", "target")
    k = table(s, d, "konsep").dropDuplicates(["konsep_id"])
    c = k.select(F.col("book_id").alias("book"), F.col("konsep_id").alias("ord"), F.col("bab").alias("chapter"), F.lit("1").alias("page"), F.col("description").alias("text"))
    return models.retrieve(t, c, ["chapter", "subject", "target"])


_TERMS = f"list_distinct(list_filter(regexp_extract_all(lower(concat_ws(' ', coalesce(chapter, ''), coalesce(subject, ''), coalesce(target, ''))), '[0-9a-zà-öø-ÿ]+'), lambda t: length(t) >= 3 AND t NOT IN ({sql_list(vocab.CONTEXT_STOPWORDS)})))"
_add(
    "l13_context",
    _retrieved,
    f"""WITH t AS (SELECT DISTINCT triple_id AS key, book_id AS book, chapter, {_TERMS} AS terms FROM triples),
c AS (SELECT DISTINCT konsep_id AS ord, book_id AS book, bab AS chapter, description AS text FROM konsep),
s AS (SELECT t.key, c.ord, c.chapter, c.text, len(list_filter(t.terms, lambda x: contains(lower(concat_ws(' ', coalesce(c.chapter, ''), coalesce(c.text, ''))), x))) + CASE WHEN trim(coalesce(t.chapter, ''), ' ') <> '' AND lower(trim(coalesce(c.chapter, ''), ' ')) = lower(trim(t.chapter, ' ')) THEN 3 ELSE 0 END AS score FROM t JOIN c USING (book)),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, ord) AS n FROM s WHERE score >= 1)
SELECT t.key, coalesce(string_agg('[' || coalesce(r.chapter, '') || ', p.1, score=' || CAST(r.score AS VARCHAR) || '] ' || r.text, chr(10) || chr(10) ORDER BY r.n), '') AS context FROM t LEFT JOIN r ON r.key = t.key AND r.n <= 3 GROUP BY t.key""",
)
_add("s9_running_triples", lambda s, d: books.running_triples(table(s, d, "konsep").dropDuplicates(["konsep_id"])).select("book_id", "triple_no", "konsep_id", "pos", "relation"), "WITH k AS (SELECT konsep_id, any_value(book_id) AS book_id, any_value(bab) AS bab, any_value(sub_bab) AS sub_bab, any_value(relations) AS r FROM konsep GROUP BY 1) SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY bab NULLS FIRST, sub_bab NULLS FIRST, konsep_id, i) - 1 AS triple_no, konsep_id, CAST(i - 1 AS INTEGER) AS pos, r[i].rel_type AS relation FROM k, range(1, 1000) x(i) WHERE i <= len(r)")
