"""Queries of upserts (M), ordered picks (W5, W6), extraction (L1, L11) and of sources and sinks (S)."""

from __future__ import annotations

import json
import re
import uuid
from datetime import datetime

from pyspark.sql import functions as F

from rajut.functions.text import alike_key
from rajut.operators import books, models, upsert
from rajut.operators.agreement import first_by_content
from rajut.plans.data import table
from rajut.plans.views import concept_edges, concept_nodes, GRAPH, once, relations, sql_key, sql_squeeze
from rajut.session import checkpoint_dir
from rajut.sources import files

QUERIES, ORACLE = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE[name] = once(sql)


def _konsep(s, d):
    return table(s, d, "konsep").dropDuplicates(["konsep_id"])


_K1 = f"k AS (SELECT DISTINCT konsep_id, book_id, {sql_key('name')} AS name, description FROM konsep)"
_add("w5_first_seen", lambda s, d: first_by_content(_konsep(s, d), [F.col("konsep_id")], "name").select("konsep_id"), "WITH k AS (SELECT DISTINCT konsep_id, " + sql_squeeze('name') + " AS k FROM konsep) SELECT min(konsep_id) AS konsep_id FROM k GROUP BY k")
_add("w6_last_writer", lambda s, d: upsert.last_writer(_konsep(s, d).select("book_id", alike_key("name").alias("name"), "konsep_id", "description"), ["book_id", "name"], "konsep_id"), f"WITH {_K1} SELECT book_id, name, max(konsep_id) AS konsep_id, arg_max(description, konsep_id) AS description FROM k GROUP BY ALL")


def _merge(s, d):
    rows = _konsep(s, d).select("book_id", alike_key("name").alias("name"), "konsep_id")
    old = upsert.last_writer(rows.where(F.col("konsep_id") % 2 == 0), ["book_id", "name"], "konsep_id")
    return upsert.merge(old, rows.where(F.col("konsep_id") % 2 == 1), ["book_id", "name"], "konsep_id")


_add("m1_merge", _merge, f"WITH {_K1} SELECT book_id, name, coalesce(max(CASE WHEN konsep_id % 2 = 1 THEN konsep_id END), max(konsep_id)) AS konsep_id FROM k GROUP BY ALL")
_add("m2_skeleton", lambda s, d: upsert.skeleton(_konsep(s, d).select(F.col("book_id").cast("string").alias("document"), "bab", "sub_bab")), "WITH e AS (SELECT CAST(book_id AS VARCHAR) AS doc, trim(bab) AS bab, trim(sub_bab) AS sub FROM konsep) SELECT DISTINCT 'Document' AS label, doc AS name, CAST(NULL AS VARCHAR) AS parent, doc AS document FROM e UNION SELECT 'Bab', bab, doc, doc FROM e WHERE coalesce(bab, '') <> '' UNION SELECT 'SubBab', sub, bab, doc FROM e WHERE coalesce(bab, '') <> '' AND coalesce(sub, '') <> ''")


def _load(s, d):
    """M3: a load of concepts and relations: valid chapters, merged nodes, typed edges with both ends."""
    from rajut.functions.normalize import is_chapter, relation_type
    from rajut.operators.joins import with_ends

    rows = _konsep(s, d).where(is_chapter("bab"))
    nodes = upsert.last_writer(rows.select(F.col("book_id").alias("grade"), alike_key("name").alias("name"), "konsep_id"), ["grade", "name"], "konsep_id")
    rel = rows.select(F.col("book_id").alias("src_grade"), alike_key("name").alias("src"), F.explode("relations").alias("r"))
    edges = rel.select("src_grade", "src", relation_type("r.rel_type").alias("rel_type"), F.col("src_grade").alias("tgt_grade"), alike_key("r.target").alias("tgt")).where(F.col("rel_type").isNotNull()).distinct()
    return with_ends(edges, nodes).select(F.col("src_grade").alias("book_id"), "src", "rel_type", "tgt")


from rajut.plans.views import SQL_REL_TYPE  # noqa: E402

_add("m3_load", _load, f"WITH k AS (SELECT konsep_id, any_value(book_id) AS book_id, {sql_key('any_value(name)')} AS name, any_value(relations) AS r FROM konsep WHERE regexp_matches(bab, '^(Bab|BAB) ') GROUP BY konsep_id), x AS (SELECT book_id, name, unnest(r) AS e FROM k), y AS (SELECT DISTINCT book_id, name AS src, e.rel_type AS rel_type0, {sql_key('e.target')} AS tgt FROM x), z AS (SELECT book_id, src, tgt, rel_type0 AS rel_type FROM y), w AS (SELECT DISTINCT book_id, src, {SQL_REL_TYPE} AS rt, tgt FROM z) SELECT book_id, src, rt AS rel_type, tgt FROM w WHERE rt IS NOT NULL AND (book_id, tgt) IN (SELECT (book_id, name) FROM k)".replace("(book_id, tgt) IN (SELECT (book_id, name)", "row(book_id, tgt) IN (SELECT row(book_id, name)"))
_add("m4_topics", lambda s, d: _konsep(s, d).select(F.col("konsep_id"), F.coalesce("sub_bab", "bab").alias("topic"), F.when(F.col("sub_bab").isNull(), "Bab").otherwise("SubBab").alias("kind")), "SELECT DISTINCT konsep_id, coalesce(sub_bab, bab) AS topic, CASE WHEN sub_bab IS NULL THEN 'Bab' ELSE 'SubBab' END AS kind FROM konsep")


def _dropped(s, d):
    nodes, edges = upsert.drop_grade(concept_nodes(s, d), concept_edges(s, d), "Kimia Kelas X")
    return nodes.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("nodes")).unionByName(edges.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("edges")))


_add("m5_drop_grade", _dropped, GRAPH + "SELECT count(*) AS n, 'nodes' AS kind FROM nodes WHERE grade <> 'Kimia Kelas X' UNION ALL SELECT count(*), 'edges' FROM edges WHERE coalesce(src_grade <> 'Kimia Kelas X', true) AND coalesce(tgt_grade <> 'Kimia Kelas X', true)")
_add("m6_violations", lambda s, d: upsert.violations(_konsep(s, d).select("book_id", alike_key("name").alias("name")), ["book_id", "name"]), f"WITH {_K1} SELECT book_id, name, count(*) AS n FROM k GROUP BY ALL HAVING count(*) > 1")
_add("m7_unique_pairs", lambda s, d: upsert.unique_pairs(concept_edges(s, d).select("rel_id", "src_grade", "src", "tgt_grade", "tgt"), ["src_grade", "src"], ["tgt_grade", "tgt"], "rel_id").select("rel_id"), GRAPH + "SELECT min(rel_id) AS rel_id FROM edges GROUP BY least(coalesce(src_grade, '') || chr(31) || src, coalesce(tgt_grade, '') || chr(31) || tgt), greatest(coalesce(src_grade, '') || chr(31) || src, coalesce(tgt_grade, '') || chr(31) || tgt)")
_add("m10_cache_stats", lambda s, d: upsert.cache_stats(relations(s, d), "provenance").select("provenance", "n_entries"), "SELECT provenance, count(DISTINCT rel_id) AS n_entries FROM relations GROUP BY provenance")
_add("m10_expired", lambda s, d: upsert.expired(relations(s, d), F.lit("2025-01-01").cast("timestamp")).select("rel_id"), "SELECT DISTINCT rel_id FROM relations WHERE created_at < TIMESTAMPTZ '2025-01-01 00:00:00+00' - INTERVAL 90 DAY")


# extraction -------------------------------------------------------------------
def _extract_client(texts):
    """A deterministic extractor: first and last word of each text."""
    return [json.dumps([{"subject": t.split()[0], "relation": "BAGIAN_DARI", "target": t.split()[-1]}]) if t and t.split() else "no json" for t in texts]


def _extracted(s, d):
    rows = table(s, d, "book_texts").dropDuplicates(["text_id"]).select(F.col("book_id").cast("string").alias("grade"), F.col("text_id").cast("string").alias("chapter"), F.regexp_replace("body", r"[^A-Za-z]+", " ").alias("text"))
    return models.extract(rows, _extract_client).select(F.col("chapter").alias("text_id"), "subject", "target")


_add("l1_extract", _extracted, "WITH t AS (SELECT DISTINCT text_id, trim(regexp_replace(body, '[^A-Za-z]+', ' ', 'g')) AS b FROM book_texts) SELECT CAST(text_id AS VARCHAR) AS text_id, string_split(b, ' ')[1] AS subject, string_split(b, ' ')[-1] AS target FROM t WHERE b <> ''")
def _vocabularies(s, d):
    """The types of each book's relations in the order of their names, and the prompt that they ask for."""
    typed = relations(s, d).where(F.col("rel_type").isNotNull()).select("book_id", cross_type("rel_type", F.coalesce(F.col("tgt_grade") != F.col("src_grade"), F.lit(False))).alias("t"))
    return typed.groupBy("book_id").agg(F.array_sort(F.collect_set("t")).alias("types")).select("book_id", F.size("types").cast("bigint").alias("n_types"), models.prompt_kind(F.col("types")).alias("kind"))


def cross_type(name, between):
    return F.when(between & ~F.col(name).startswith("LINTAS_BUKU"), F.concat(F.lit("LINTAS_BUKU_"), F.col(name))).otherwise(F.col(name))


_add("l9_prompt_kind", _vocabularies, "WITH t AS (SELECT DISTINCT book_id, CASE WHEN coalesce(tgt_grade <> src_grade, false) AND NOT starts_with(rel_type, 'LINTAS_BUKU') THEN 'LINTAS_BUKU_' || rel_type ELSE rel_type END AS t FROM relations WHERE rel_type IS NOT NULL) SELECT book_id, count(*) AS n_types, CASE WHEN starts_with(min(t), 'LINTAS_BUKU_') THEN 'cross_book' ELSE 'concept' END AS kind FROM t GROUP BY 1")


# sources and sinks: written to the shared folder and read again ---------------
def _path(s, name):
    return f"{checkpoint_dir(s).rstrip('/')}/rajut-{name}-{uuid.uuid4().hex}"


def _documents(s, d):
    path = _path(s, "ratings")
    ev = table(s, d, "expert_validation").dropDuplicates(["validation_id"])
    files.write_documents(ev.select("ratings", "comments", F.col("missing_triples").alias("missingTriples"), F.col("general_feedback").alias("generalFeedback")), path)
    back = s.read.schema(files.RATINGS).json(path)
    return back.select(F.explode("ratings").alias("triple", "label"), "generalFeedback").groupBy("triple", "label", "generalFeedback").agg(F.count(F.lit(1)).alias("n"))


_add("s1_documents", _documents, "WITH v AS (SELECT validation_id, any_value(ratings) AS r, any_value(general_feedback) AS f FROM expert_validation GROUP BY 1), e AS (SELECT f, unnest(map_entries(r)) AS x FROM v) SELECT x.key AS triple, x.value AS label, f AS \"generalFeedback\", count(*) AS n FROM e GROUP BY ALL")


def _checkpoint(s, d):
    path = _path(s, "checkpoint")
    t = table(s, d, "triples").dropDuplicates(["triple_id"])
    rec = t.select(F.col("triple_id").cast("string").alias("checkpoint_key"), F.lit("c").alias("checkpoint_name"), "subject", F.lit(None).cast("string").alias("grade"), F.lit("first").alias("reasoning"), F.lit("wrong").alias("final_consensus_label"))
    files.append_checkpoint(rec, path)
    s.createDataFrame([("",), ("{broken",)], "value string").write.mode("append").text(path)
    return files.read_checkpoint(s, path).select("checkpoint_key", "reasoning", "final_consensus_label")


_add("s2_checkpoint", _checkpoint, "SELECT DISTINCT CAST(triple_id AS VARCHAR) AS checkpoint_key, 'first' AS reasoning, 'wrong' AS final_consensus_label FROM triples")


def _survey_csv(s, d):
    path = _path(s, "survey")
    rows = relations(s, d).select(F.concat(F.lit("LB"), F.col("rel_id").cast("string")).alias("id"), F.concat_ws(", ", "rel_type", "status").alias("note"))
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(path)
    return files.read_survey_edges(s, path).select("id", "note")


_add("s5_survey_csv", _survey_csv, "SELECT DISTINCT 'LB' || CAST(rel_id AS VARCHAR) AS id, concat_ws(', ', rel_type, status) AS note FROM relations")


def _survey_answers(s, d):
    path = _path(s, "answers")
    r = relations(s, d).where(F.col("status").isNotNull())
    doc = r.select(F.create_map(F.concat(F.lit("LB"), F.col("rel_id").cast("string")), F.struct(F.col("status").alias("relationValid"))).alias("answers"))
    files.write_documents(doc, path)
    return files.survey_answers(s.read.schema(files.ANSWERS).json(path)).select("id", "relationValid")


_add("j18_survey_join", lambda s, d: _survey_answers(s, d).join(relations(s, d).select(F.concat(F.lit("LB"), F.col("rel_id").cast("string")).alias("id"), "rel_type"), "id"), "SELECT DISTINCT 'LB' || CAST(rel_id AS VARCHAR) AS id, status AS relationValid, rel_type FROM relations WHERE status IS NOT NULL")
def _courses(s, d):
    """Gold files of all books, experts' files of some and mock files of others, discovered again."""
    folder = _path(s, "courses")
    for r in table(s, d, "books").select("book_id", "name").collect():  # a fixed table of 42 rows
        slug = re.sub(r"[^a-z0-9]+", "_", r["name"].lower()) + f"_{r['book_id']}"
        files.put(s, f"{folder}/{slug}{'_mock' if r['book_id'] % 5 == 0 else ''}{files.GOLD}", "[]")
        for n in (1, 2)[: 1 + (r["book_id"] % 3 > 0)]:
            files.put(s, f"{folder}/{slug}_expert_{n}.json", "{}")
    return files.discover_courses(files.listed(s, folder + "/*.json"))


_add("s6_courses", _courses, "WITH c AS (SELECT regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g') || '_' || CAST(book_id AS VARCHAR) AS slug FROM books WHERE book_id % 5 <> 0 AND book_id % 3 <> 0) SELECT slug, array_to_string(list_transform(string_split(slug, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS subject FROM c")


def _latest(s, d):
    """A context file of each book in one of two folders; some change at the same time."""
    folder, day = _path(s, "context"), 86_400_000
    for r in table(s, d, "books").select("book_id").collect():  # a fixed table of 42 rows
        i = r["book_id"]
        files.put(s, f"{folder}/{'ab'[i % 2]}/ebook_context_{i:04d}.json", "{}", changed_ms=(19_000 + i * 7 % 11) * day)
    return files.latest_file(s, folder + "/a/ebook_*.json", folder + "/b/ebook_*.json").select(F.element_at(F.split("path", "/"), -1).alias("name"), F.unix_millis("changed_at").alias("changed_ms"))


_add("s7_latest_file", _latest, "WITH f AS (SELECT CASE WHEN book_id % 2 = 0 THEN 'a' ELSE 'b' END AS folder, 'ebook_context_' || lpad(CAST(book_id AS VARCHAR), 4, '0') || '.json' AS name, (19000 + book_id * 7 % 11) * CAST(86400000 AS BIGINT) AS changed_ms FROM books) SELECT name, CAST(changed_ms AS BIGINT) AS changed_ms FROM f ORDER BY changed_ms DESC, folder DESC, name DESC LIMIT 1")


def _context(s, d):
    k = _konsep(s, d).where(F.col("bab").isNotNull())
    chunks = k.groupBy("book_id", "bab").agg(F.collect_list(F.struct(F.lit("1").alias("page"), F.col("sub_bab").alias("page_label"), F.col("description").alias("text"))).alias("chunks"))
    nested = chunks.groupBy(F.col("book_id").alias("book")).agg(F.collect_list(F.struct(F.col("bab").alias("chapter"), "chunks")).alias("chapters"))
    return books.flat_context(nested).select("book", "chapter", "page", "text")


_add("s8_flat_context", _context, "SELECT book_id AS book, chapter, page, text FROM (SELECT DISTINCT konsep_id, book_id, bab AS chapter, coalesce(nullif(sub_bab, ''), '1') AS page, description AS text FROM konsep WHERE bab IS NOT NULL AND trim(coalesce(description, '')) <> '')")


def _nested(s, d):
    path = _path(s, "graph")
    r = relations(s, d).where(F.col("src_grade").isNotNull())
    flat = r.select(F.col("src_grade").alias("grade"), F.col("book_id").cast("string").alias("chapter"), F.coalesce("graph_role", F.lit("-")).alias("subtopic"), F.col("src_name").alias("concept"), F.col("rel_type").alias("type"), "target", "description")
    files.write_documents(files.nest_books(flat), path)
    back = s.read.schema(files.BOOK).json(path).select("grade", F.explode("chapters").alias("c")).select("grade", F.explode("c.subtopics").alias("t")).select("grade", F.explode("t.concepts").alias("k"))
    return back.groupBy("grade").agg(F.sum(F.size("k.relations")).alias("n_relations"))


_add("s12_nested_export", _nested, "SELECT src_grade AS grade, count(DISTINCT rel_id) AS n_relations FROM relations WHERE src_grade IS NOT NULL GROUP BY 1")


def _exports(s, d):
    """Two exports of one grade under their timestamps; the later name is read again."""
    folder, grade = _path(s, "exports"), "Kimia Kelas X"
    r = relations(s, d).where(F.col("src_grade").isNotNull())
    flat = r.select(F.col("src_grade").alias("grade"), F.col("book_id").cast("string").alias("chapter"), F.coalesce("graph_role", F.lit("-")).alias("subtopic"), F.col("src_name").alias("concept"), F.col("rel_type").alias("type"), "target", "description")
    nested = files.nest_books(flat.where(F.col("grade") == grade))
    paths = [files.export_book(nested.limit(n), folder, grade, datetime(2026, 5, 1 + n)) for n in (0, 1)]
    back = s.read.schema(files.BOOK).json(max(paths)).select("grade", F.explode("chapters").alias("c")).select("grade", "c.chapter", F.explode("c.subtopics").alias("t")).select("grade", "chapter", F.explode("t.concepts").alias("k"))
    return back.groupBy("grade", "chapter", F.col("k.name").alias("concept")).agg(F.sum(F.size("k.relations")).alias("n")).withColumn("file", F.lit(max(paths).rsplit("/", 1)[-1]))


_add("s13_timestamped_export", _exports, "SELECT src_grade AS grade, CAST(book_id AS VARCHAR) AS chapter, src_name AS concept, count(*) AS n, 'kimia_kelas_x_20260502_000000.json' AS file FROM relations WHERE src_grade = 'Kimia Kelas X' GROUP BY ALL")


def _resolved(s, d):
    """Books read through a folder that is given, set, or the default, in that order."""
    setting = "rajut.graph.path"
    before = s.conf.get(setting, None)
    s.conf.set(setting, d)
    try:
        found = [("given", files.resolve(d, setting, s, "/absent")), ("setting", files.resolve(None, setting, s, "/absent")), ("default", files.resolve(None, setting + ".other", s, d))]
    finally:
        s.conf.set(setting, before) if before is not None else s.conf.unset(setting)
    every = None
    for way, path in found:
        one = table(s, path, "books").select(F.lit(way).alias("way"), "book_id", "name")
        every = one if every is None else every.unionByName(one)
    return every


_add("s15_resolved_source", _resolved, "SELECT way, book_id, name FROM books, (VALUES ('given'), ('setting'), ('default')) w(way)")


def _gold(s, d):
    path = _path(s, "gold")
    files.write_documents(table(s, d, "triples").dropDuplicates(["triple_id"]).select("triple_id", "subject", "final_consensus_label"), path)
    return s.read.schema("triple_id long, subject string, final_consensus_label string").json(path)


_add("s11_gold_export", _gold, "SELECT DISTINCT triple_id, subject, final_consensus_label FROM triples")


def _graphs(s, d):
    """A graph file of each book, those of odd ids without a grade, which their names then give."""
    folder = _path(s, "named")
    for r in table(s, d, "books").collect():  # a fixed table of 42 rows
        grade = None if r["book_id"] % 2 else r["name"]
        files.put(s, f"{folder}/{r['name'].lower().replace(' ', '_')}_{r['book_id']}.consensus.json", json.dumps({"grade": grade, "chapters": [{"chapter": r["name"], "subchapters": [str(r["book_id"])]}]}))
    return files.read_graphs(s, folder).select("grade", F.explode("chapters").alias("c")).select("grade", "c.chapter", F.col("c.subchapters")[0].alias("book_id"))


_add("s10_graphs", _graphs, "SELECT CASE WHEN book_id % 2 = 0 THEN name ELSE array_to_string(list_transform(string_split(lower(name) || ' ' || CAST(book_id AS VARCHAR), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS grade, name AS chapter, CAST(book_id AS VARCHAR) AS book_id FROM books")
def _page_parser(content):
    """Pages of a file of JSON lines (label, text)."""
    return [(p.get("page_label"), p["body"]) for p in map(json.loads, bytes(content).decode().splitlines())]


def _pages(s, d):
    """The texts of each book written as one binary file, scanned page by page with an injected parser."""
    path = _path(s, "scans")
    t = table(s, d, "book_texts").dropDuplicates(["text_id"]).where(F.col("body").isNotNull())
    t.repartition("book_id").write.partitionBy("book_id").json(path)
    raw = s.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path).select("path", "content")
    found = books.pages_of(raw, _page_parser)
    return found.groupBy(F.regexp_extract("path", "book_id=([0-9]+)", 1).cast("int").alias("book_id"), F.col("page_label")).agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.length("text")).alias("n_chars"))


_add("s4_pages", _pages, "SELECT book_id, page_label, count(*) AS n_pages, CAST(sum(length(body)) AS BIGINT) AS n_chars FROM (SELECT text_id, any_value(book_id) AS book_id, any_value(page_label) AS page_label, any_value(body) AS body FROM book_texts GROUP BY 1) WHERE body IS NOT NULL GROUP BY ALL")


def _glossaries(s, d):
    """The glossary in three layouts: bold terms within one block, a block an entry, and lines up to a full stop."""
    g = table(s, d, "glosarium").where(F.length("term") <= 45).select((F.col("term_id") % 3).cast("long").alias("book"), "term_id", "term", F.concat(F.regexp_replace(F.trim("definition"), r"[.]+$", ""), F.lit(".")).alias("definition"))
    half = F.floor(F.size(F.split("definition", " ")) / 2).cast("int")
    words = F.split("definition", " ")
    bold = F.col("book") == 0
    split_up = F.when(bold | (F.col("book") == 1), F.array("term", "definition")).otherwise(F.array("term", F.array_join(F.slice(words, 1, half), " "), F.array_join(F.slice(words, half + 1, 100_000), " ")))
    rows = g.select("book", "term_id", F.posexplode(F.filter(split_up, lambda t: t != "")).alias("pos", "text"))
    number = F.col("term_id") * 10 + F.when(bold, 0).otherwise(F.col("pos"))
    block = F.when(bold, F.lit(1)).when(F.col("book") == 1, F.col("term_id")).otherwise(number)
    spans = rows.select("book", F.lit(1).alias("page"), block.cast("long").alias("block"), number.cast("long").alias("line"), "pos", "text", (bold & (F.col("pos") == 0)).alias("bold"), F.lit(10.0).alias("size"))
    heading = spans.select("book").distinct().select("book", F.lit(1).alias("page"), F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("line"), F.lit(0).alias("pos"), F.lit("Glosarium").alias("text"), F.lit(True).alias("bold"), F.lit(16.0).alias("size"))
    return books.glossaries(spans.unionByName(heading))


_add("x5_glossaries", _glossaries, "SELECT term_id % 3 AS book, trim(regexp_replace(term, '\\s+', ' ', 'g')) AS term, regexp_replace(regexp_replace(trim(definition), '[.]+$', '') || '.', '\\s+', ' ', 'g') AS definition FROM glosarium WHERE length(term) <= 45")
_add("l11_sentence_chunks", lambda s, d: books.sentence_chunks(table(s, d, "book_texts"), "text_id", "body").select("text_id", "chunk_no", "n_words", F.md5("chunk").alias("digest")), r"""WITH RECURSIVE
b AS (SELECT text_id, any_value(body) AS body FROM book_texts GROUP BY 1),
s AS (SELECT text_id, list_filter(string_split(regexp_replace(trim(regexp_replace(body, '\s+', ' ', 'g')), '([.?!]) ', '\1' || chr(10), 'g'), chr(10)), lambda x: x <> '') AS s FROM b WHERE body IS NOT NULL),
p AS (SELECT text_id, flatten(list_transform(s, lambda x: list_transform(range(0, (len(string_split(x, ' ')) - 1) // 800 + 1), lambda k: array_to_string(string_split(x, ' ')[k * 800 + 1 : k * 800 + 800], ' ')))) AS s FROM s WHERE len(s) > 0),
z AS (SELECT text_id, s, list_transform(s, lambda x: len(string_split(x, ' '))) AS n FROM p),
c AS (SELECT text_id, s, list_transform(range(0, len(n) + 1), lambda i: CAST(coalesce(list_sum(n[1:i]), 0) AS BIGINT)) AS c, len(n) AS m FROM z),
g AS (
  SELECT text_id, 0 AS chunk_no, CAST(0 AS BIGINT) AS a, list_max(list_filter(range(1, m + 1), lambda j: c[j + 1] <= 800)) AS z FROM c
  UNION ALL
  SELECT text_id, chunk_no + 1, a, list_max(list_filter(range(a + 1, m + 1), lambda j: c[j + 1] - c[a + 1] <= 800)) FROM (
    SELECT g.text_id, g.chunk_no, c.c, c.m, list_min(list_filter(range(g.a + 1, g.z + 1), lambda k: c.c[k + 1] >= greatest(c.c[g.z + 1] - 200, c.c[g.z + 2] - 800))) AS a
    FROM g JOIN c USING (text_id) WHERE g.z < c.m)
)
SELECT text_id, chunk_no, CAST(c[z + 1] - c[a + 1] AS INTEGER) AS n_words, md5(array_to_string(s[a + 1 : z], ' ')) AS digest FROM g JOIN c USING (text_id)""")
