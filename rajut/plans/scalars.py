"""Queries of the normalisers (F) and of text, JSON, key and number functions (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rajut.functions import normalize as n
from rajut.functions import scalars as x
from rajut.functions import vocab
from rajut.functions.text import squeeze
from rajut.plans.data import table
from rajut.plans.views import once, relations, sql_case, sql_key, sql_list, SQL_REL_TYPE, sql_squeeze, sql_strip

QUERIES, ORACLE = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE[name] = once(sql)


def _rel(make):
    """``make`` returns the named columns; they are made when a session exists."""
    return lambda s, d: relations(s, d).select("rel_id", *[c.alias(k) for k, c in make().items()])


def _rel_sql(**cols):
    return "SELECT DISTINCT rel_id, " + ", ".join(f"{v} AS {k}" for k, v in cols.items()) + " FROM relations"


def _ratings(s, d):
    ev = table(s, d, "expert_validation").dropDuplicates(["validation_id"])
    return ev.select("validation_id", F.explode("ratings").alias("k", "v"))


_RATINGS = "(SELECT validation_id, e.key AS k, e.value AS v FROM (SELECT DISTINCT validation_id, unnest(map_entries(ratings)) AS e FROM expert_validation))"
_low = f"lower({sql_strip('v')})"
_alias = sql_case(_low, vocab.LABEL_ALIASES, _low)

_add("f1_rating_label", lambda s, d: _ratings(s, d).groupBy(n.rating_label("v").alias("label")).agg(F.count(F.lit(1)).alias("n")), f"SELECT CASE WHEN {_alias} IN ({sql_list(vocab.LABELS)}) THEN {_alias} ELSE 'unknown' END AS label, count(*) AS n FROM {_RATINGS} GROUP BY ALL")
_add("f2_loose_label", lambda s, d: _ratings(s, d).groupBy(n.loose_label("v").alias("label")).agg(F.count(F.lit(1)).alias("n")), f"SELECT coalesce({_alias}, '') AS label, count(*) AS n FROM {_RATINGS} GROUP BY ALL")
_add("f3_scored_label", lambda s, d: _ratings(s, d).groupBy(n.scored_label("v").alias("label")).agg(F.count(F.lit(1)).alias("n")), f"SELECT CASE WHEN {_alias} IN ({sql_list(vocab.SCORED_LABELS)}) THEN {_alias} END AS label, count(*) AS n FROM {_RATINGS} GROUP BY ALL")
_add("f4_triple_number", lambda s, d: _ratings(s, d).select("validation_id", F.col("k").alias("raw"), F.coalesce(n.triple_number("k").cast("string"), F.lit("-")).alias("triple_id")), f"SELECT validation_id, k AS raw, coalesce(CASE WHEN regexp_full_match({sql_strip('k')}, '[0-9]+') THEN CAST(try_cast({sql_strip('k')} AS BIGINT) AS VARCHAR) END, '-') AS triple_id FROM {_RATINGS}")
_tk = f"regexp_replace({sql_strip('k')}, '\\.0$', '')"
_add("f5_triple_key", lambda s, d: _ratings(s, d).select("validation_id", F.col("k").alias("raw"), n.triple_key("k").alias("triple_key")), f"SELECT validation_id, k AS raw, CASE WHEN regexp_full_match({_tk}, '0+') THEN '0' ELSE regexp_replace({_tk}, '^0+', '') END AS triple_key FROM {_RATINGS}")


_add("f6_content_key", lambda s, d: table(s, d, "triples").dropDuplicates(["triple_id"]).select("triple_id", n.content_key("subject", "relation", "target").alias("k")).select("triple_id", "k.k0", "k.k1", "k.k2"), f"SELECT DISTINCT triple_id, {sql_squeeze('subject')} AS k0, {sql_squeeze('relation')} AS k1, {sql_squeeze('target')} AS k2 FROM triples")
_add("f7_relation_type", _rel(lambda: dict(rel=n.relation_type("rel_type"))), _rel_sql(rel=SQL_REL_TYPE))
_up = "regexp_replace(regexp_replace(regexp_replace(upper(" + sql_strip("coalesce(rel_type, '')") + "), '[^A-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"
_add("f8_safe_relation", _rel(lambda: dict(rel=n.safe_relation("rel_type"))), _rel_sql(rel=f"CASE WHEN {_up} = '' THEN 'RELATED_TO' WHEN regexp_matches({_up}, '^[0-9]') THEN 'REL_' || {_up} ELSE {_up} END"))
_add("f9_compact_json", lambda s, d: table(s, d, "expert_validation").dropDuplicates(["validation_id"]).select("validation_id", n.compact_json(F.map_keys("ratings")).alias("keys_json")), "SELECT DISTINCT validation_id, coalesce(CAST(to_json(map_keys(ratings)) AS VARCHAR), '') AS keys_json FROM expert_validation")
_add("f10_cross_type", _rel(lambda: dict(rel=n.cross_type(n.relation_type("rel_type")))), _rel_sql(rel=f"CASE WHEN ({SQL_REL_TYPE}) IS NULL THEN 'LINTAS_BUKU' ELSE 'LINTAS_BUKU_' || ({SQL_REL_TYPE}) END"))
_add("f11_bare_type", _rel(lambda: dict(rel=n.bare_type(n.cross_type("rel_type")))), _rel_sql(rel="CASE WHEN coalesce(rel_type, '') = '' THEN 'LINTAS_BUKU' ELSE regexp_replace(rel_type, '^LINTAS_BUKU_', '') END"))
_add("f12_full_relations", lambda s, d: table(s, d, "konsep").dropDuplicates(["konsep_id"]).select("konsep_id", F.coalesce(F.size(n.full_relations("relations")), F.lit(0)).cast("bigint").alias("n_full")).withColumn("n_full", F.greatest("n_full", F.lit(0))), f"SELECT konsep_id, CAST(coalesce(len(list_filter(any_value(relations), lambda r: {sql_strip(chr(99) + 'oalesce(r.rel_type, ' + chr(39) * 2 + ')')} <> '' AND {sql_strip('coalesce(r.target, ' + chr(39) * 2 + ')')} <> '')), 0) AS BIGINT) AS n_full FROM konsep GROUP BY konsep_id")
_add("f13_chapters", lambda s, d: table(s, d, "konsep").dropDuplicates(["konsep_id"]).where(n.is_chapter("bab")).select("konsep_id", "bab"), "SELECT DISTINCT konsep_id, bab FROM konsep WHERE regexp_matches(bab, '^(Bab|BAB) ')")


def _missing(s, d):
    ev = table(s, d, "expert_validation").dropDuplicates(["validation_id"])
    return ev.select("validation_id", "reviewer", F.posexplode("missing_triples").alias("pos", "m")).select("validation_id", "reviewer", "pos", "m.*")


_MISSING = "(SELECT validation_id, reviewer, CAST(i - 1 AS INTEGER) AS pos, m.missing_triples[i].chapter AS chapter, m.missing_triples[i].subject AS subject, m.missing_triples[i].relation AS relation, m.missing_triples[i].target AS target, m.missing_triples[i].description AS description FROM (SELECT DISTINCT validation_id, reviewer, missing_triples FROM expert_validation) m, range(1, 500) r(i) WHERE i <= len(m.missing_triples))"
_add("f14_required_fields", lambda s, d: _missing(s, d).where(n.all_present("chapter", "subject", "relation", "target")).select("validation_id", "pos", "subject"), f"SELECT validation_id, pos, subject FROM {_MISSING} WHERE " + " AND ".join(f"{sql_strip('coalesce(' + c + ', ' + chr(39) * 2 + ')')} <> ''" for c in ("chapter", "subject", "relation", "target")))
_lab = f"CASE WHEN {_alias} IN ({sql_list(vocab.LABELS)}) THEN {_alias} ELSE 'unknown' END"
_add("f15_counted_ratings", lambda s, d: _ratings(s, d).where(n.counted(n.rating_label("v"))).select("validation_id", "k"), f"SELECT validation_id, k FROM {_RATINGS} WHERE {_lab} NOT IN ('abaikan', 'unknown')")
_add("f16_not_wrong", lambda s, d: relations(s, d).where(n.not_wrong("consensus", "status")).select("rel_id"), "SELECT DISTINCT rel_id FROM relations WHERE coalesce(consensus, status, '') <> 'wrong'")
_add("f17_refined_description", lambda s, d: table(s, d, "triples").dropDuplicates(["triple_id"]).select("triple_id", n.refined_description("description", "final_consensus_label", F.concat(F.lit("alasan "), "subject"), "source").alias("refined")), f"SELECT DISTINCT triple_id, CASE WHEN final_consensus_label IN ('partial', 'missing') AND source <> 'system_generated' THEN {sql_strip(chr(39) + 'alasan ' + chr(39) + ' || subject')} ELSE {sql_strip('coalesce(description, ' + chr(39) * 2 + ')')} END AS refined FROM triples")
_add("f18_subject", lambda s, d: table(s, d, "books").select("book_id", n.subject_of("name").alias("subject")), "SELECT book_id, regexp_replace(name, ' Kelas (XII|XI|X)$', '') AS subject FROM books")
_add("f19_title", lambda s, d: table(s, d, "source_weights").select("source", n.title_of("source").alias("title")), "SELECT source, list_aggregate(list_transform(string_split(replace(source, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS title FROM source_weights")
_add("f20_plain_text", lambda s, d: table(s, d, "konsep").dropDuplicates(["konsep_id"]).select("konsep_id", n.plain_text("name").alias("plain")), "SELECT DISTINCT konsep_id, trim(regexp_replace(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS plain FROM konsep")
_add("f21_same_pair", lambda s, d: relations(s, d).where(x.same_text("src_name", "target")).select("rel_id"), f"SELECT DISTINCT rel_id FROM relations WHERE {sql_squeeze('src_name')} = {sql_squeeze('target')}")
_add("f22_json_safe", lambda s, d: table(s, d, "concepts").dropDuplicates(["concept_id"]).select("concept_id", F.coalesce(F.size(F.filter("embedding", lambda e: F.isnan(e) | e.isNull())), F.lit(0)).cast("bigint").alias("n_unusable")).withColumn("n_unusable", F.greatest("n_unusable", F.lit(0))), "SELECT concept_id, CAST(coalesce(len(list_filter(any_value(embedding), lambda e: e IS NULL OR isnan(e))), 0) AS BIGINT) AS n_unusable FROM concepts GROUP BY concept_id")
_add("f23_checkpoint_key", lambda s, d: table(s, d, "triples").dropDuplicates(["triple_id"]).select("triple_id", n.checkpoint_key("triple_id", "chapter", "subject", "relation", "target").alias("key")), "SELECT DISTINCT triple_id, concat_ws('|', CAST(triple_id AS VARCHAR), " + ", ".join(f"lower({sql_strip('coalesce(' + c + ', ' + chr(39) * 2 + ')')})" for c in ("chapter", "subject", "relation", "target")) + ") AS key FROM triples")
_add("f24_confidence_gate", lambda s, d: relations(s, d).where(n.passes_gate("rel_type", "confidence", {"MENGATUR": 0.85}, 0.7)).select("rel_id", "confidence"), "SELECT DISTINCT rel_id, confidence FROM relations WHERE confidence >= CASE WHEN rel_type = 'MENGATUR' THEN 0.85 ELSE 0.7 END")


def _toc(s, d):
    """Contents pages made from the chapter headings of each book."""
    heads = table(s, d, "konsep").where(n.is_chapter("bab")).select("book_id", "bab").distinct()
    lines = heads.select("book_id", F.concat(F.col("bab"), F.lit(" ..... "), F.length("bab").cast("string")).alias("line"))
    return lines.groupBy("book_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text"))


_TOC = "(SELECT book_id, string_agg(line, chr(10) ORDER BY line) AS text FROM (SELECT DISTINCT book_id, bab || ' ..... ' || CAST(length(bab) AS VARCHAR) AS line FROM konsep WHERE regexp_matches(bab, '^(Bab|BAB) ')) GROUP BY book_id)"
_re = x.TOC_CHAPTER.replace("(?i)", "").replace("'", "''")
_add("x1_toc_chapters", lambda s, d: _toc(s, d).select("book_id", F.posexplode(x.toc_chapters("text")).alias("pos", "c")).select("book_id", "pos", "c.label", "c.title", F.col("c.page").alias("page")), f"""WITH m AS (SELECT book_id, regexp_extract_all(text, '(?i){_re}', 1) AS a, regexp_extract_all(text, '(?i){_re}', 2) AS b, regexp_extract_all(text, '(?i){_re}', 3) AS c FROM {_TOC})
SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY i) - 1 AS INTEGER) AS pos, a[i] AS label, b[i] AS title, CAST(c[i] AS INTEGER) AS page FROM m, range(1, 500) r(i) WHERE i <= len(a) AND NOT regexp_matches(lower(b[i]), 'glosarium|indeks|daftar pustaka|profil')""")
_sec = x.TOC_SECTION.replace("(?m)", "")


def _sections(s, d):
    heads = table(s, d, "konsep").where(F.col("sub_bab").rlike(r"^[A-Z]\. ")).select("book_id", "sub_bab").distinct()
    return heads.select("book_id", "sub_bab", F.concat(F.lit("\n "), F.col("sub_bab"), F.lit(" .... 12\n")).alias("text"))


_add("x2_toc_sections", lambda s, d: _sections(s, d).select("book_id", "sub_bab", F.explode(x.toc_sections("text")).alias("c")).select("book_id", "sub_bab", "c.letter", "c.title", "c.page"), f"""WITH t AS (SELECT DISTINCT book_id, sub_bab, chr(10) || ' ' || sub_bab || ' .... 12' || chr(10) AS text FROM konsep WHERE regexp_matches(sub_bab, '^[A-Z]\\. '))
SELECT book_id, sub_bab, regexp_extract(text, '(?m){_sec}', 1) AS letter, regexp_extract(text, '(?m){_sec}', 2) AS title, CAST(regexp_extract(text, '(?m){_sec}', 3) AS INTEGER) AS page FROM t WHERE regexp_matches(text, '(?m){_sec}')""")
_add("x3_toc_pages", lambda s, d: _toc(s, d).where(x.is_toc_page("text", F.col("book_id"))).select("book_id"), f"SELECT book_id FROM {_TOC} WHERE book_id <= 20 AND (contains(lower(text), 'daftar isi') OR contains(lower(text), 'bab')) AND regexp_matches(lower(text), '\\.{{3,}}\\s*\\d+')")
_add("x4_glossary_lines", lambda s, d: table(s, d, "glosarium").select("term_id", F.explode(x.glossary_lines(F.concat_ws("\n", F.lit("Glosarium"), F.concat_ws(": ", "term", "definition"), F.lit("a: b: c")))).alias("g")).select("term_id", "g.term", "g.definition"), "SELECT term_id, trim(term) AS term, trim(definition) AS definition FROM glosarium WHERE NOT contains(term || definition, ':')")
_add("x6_topic_lines", lambda s, d: table(s, d, "book_texts").dropDuplicates(["text_id"]).select("text_id", F.size(x.topic_lines("body")).cast("bigint").alias("n_lines")), f"""WITH l AS (SELECT text_id, {sql_strip("line")} AS line FROM (SELECT text_id, unnest(string_split(any_value(coalesce(body, '')), chr(10))) AS line FROM book_texts GROUP BY text_id))
SELECT text_id, count(DISTINCT CASE WHEN line <> '' AND len(regexp_split_to_array(line, '\\s+')) < 10 AND regexp_matches(line, '^\\p{{Lu}}') AND NOT contains(line, 'Peserta didik') AND NOT contains(line, 'Tujuan') AND NOT contains(line, 'Kegiatan') THEN line END) AS n_lines FROM l GROUP BY text_id""")
_ROMANS = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12, "xiii": 13, "xiv": 14, "xv": 15, "xvi": 16, "xvii": 17, "xviii": 18, "xix": 19, "xx": 20}
_add("x7_roman_number", lambda s, d: table(s, d, "books").select("book_id", x.roman_number(F.regexp_extract("name", "(XII|XI|X)$", 1)).cast("int").alias("klass")), "SELECT book_id, CASE regexp_extract(name, '(XII|XI|X)$', 1) WHEN 'X' THEN 10 WHEN 'XI' THEN 11 WHEN 'XII' THEN 12 ELSE 0 END AS klass FROM books")
_add("x8_page_number", lambda s, d: table(s, d, "book_texts").dropDuplicates(["text_id"]).where(F.col("page_label").rlike("^[0-9]+$|^[ivx]+$")).select("text_id", x.page_number("page_label").cast("int").alias("page")), "SELECT DISTINCT text_id, CAST(CASE WHEN regexp_full_match(page_label, '[0-9]+') THEN try_cast(page_label AS INTEGER) ELSE CASE page_label " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _ROMANS.items()) + " END END AS INTEGER) AS page FROM book_texts WHERE regexp_full_match(page_label, '[0-9]+|[ivx]+')")
_var = "^([^\\s(]+)\\s*\\(([^,)]+)(?:,\\s*([^)]+))?\\)"
_add("x9_variables", lambda s, d: table(s, d, "konsep").dropDuplicates(["konsep_id"]).select("konsep_id", F.posexplode("variables").alias("pos", "raw")).select("konsep_id", "pos", x.variable("raw").alias("v")).select("konsep_id", "pos", "v.name", "v.label", "v.unit"), f"""WITH v AS (SELECT konsep_id, CAST(i - 1 AS INTEGER) AS pos, {sql_strip("variables[i]")} AS raw FROM (SELECT konsep_id, any_value(variables) AS variables FROM konsep GROUP BY konsep_id), range(1, 100) r(i) WHERE i <= len(variables))
SELECT konsep_id, pos, CASE WHEN regexp_matches(raw, '{_var}') THEN nullif(trim(regexp_extract(raw, '{_var}', 1)), '') ELSE raw END AS name, CASE WHEN regexp_matches(raw, '{_var}') THEN nullif(trim(regexp_extract(raw, '{_var}', 2)), '') END AS label, CASE WHEN regexp_matches(raw, '{_var}') THEN nullif(trim(regexp_extract(raw, '{_var}', 3)), '') END AS unit FROM v""")


def _tok_sql(col, pattern, least, stop):
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({col}, '')), '{pattern}'), lambda t: length(t) >= {least} AND t NOT IN ({sql_list(stop)})))"


_desc = "any_value(description)"
_add("x10_context_terms", lambda s, d: table(s, d, "konsep").dropDuplicates(["konsep_id"]).select("konsep_id", F.array_join(F.array_sort(x.context_terms("description")), " ").alias("terms")), f"SELECT konsep_id, array_to_string(list_sort({_tok_sql(_desc, '[0-9a-zà-öø-ÿ]+', 3, vocab.CONTEXT_STOPWORDS)}), ' ') AS terms FROM konsep GROUP BY konsep_id")
_add("x11_meaningful_tokens", lambda s, d: table(s, d, "konsep").dropDuplicates(["konsep_id"]).select("konsep_id", F.array_join(F.array_sort(x.meaningful_tokens("description")), " ").alias("terms")), f"SELECT konsep_id, array_to_string(list_sort({_tok_sql(_desc, '[a-z0-9]+', 4, vocab.TOKEN_STOPWORDS)}), ' ') AS terms FROM konsep GROUP BY konsep_id")
_add("x12_chunk_score", lambda s, d: table(s, d, "triples").dropDuplicates(["triple_id"]).select("triple_id", x.chunk_score(x.context_terms("subject"), F.col("chapter"), F.concat_ws(" ", "subject", "target"), F.col("chapter")).cast("bigint").alias("score")), f"SELECT DISTINCT triple_id, CAST(len(list_filter({_tok_sql('subject', '[0-9a-zà-öø-ÿ]+', 3, vocab.CONTEXT_STOPWORDS)}, lambda t: contains(lower(concat_ws(' ', coalesce(chapter, ''), concat_ws(' ', subject, target))), t))) + CASE WHEN trim(coalesce(chapter, '')) <> '' THEN 3 ELSE 0 END AS BIGINT) AS score FROM triples")
_add("x14_list_text", lambda s, d: table(s, d, "konsep").dropDuplicates(["konsep_id"]).select("konsep_id", x.list_text("formula").alias("formulas"), x.edges_text(F.transform("relations", lambda r: F.struct(r["rel_type"].alias("rel_type"), r["target"].alias("target"), F.when(r["description"].isNotNull(), 0.5).alias("confidence")))).alias("edges")), "SELECT konsep_id, CASE WHEN coalesce(len(any_value(formula)), 0) = 0 THEN '(tidak ada)' ELSE array_to_string(any_value(formula), ', ') END AS formulas, CASE WHEN coalesce(len(any_value(relations)), 0) = 0 THEN '  (tidak ada)' ELSE array_to_string(list_transform(any_value(relations), lambda r: '  - ' || coalesce(r.rel_type, '') || ' → ' || chr(34) || coalesce(r.target, '') || chr(34) || CASE WHEN r.description IS NULL THEN '' ELSE ' (conf: 0.50)' END), chr(10)) END AS edges FROM konsep GROUP BY konsep_id")
_add("x15_fingerprint", lambda s, d: table(s, d, "books").select("book_id", x.fingerprint("name", "book_id").alias("fp")), """SELECT book_id, md5('{"p0":"' || name || '","p1":' || CAST(book_id AS VARCHAR) || '}')[1:12] AS fp FROM books""")
_add("x16_cache_key", _rel(lambda: dict(key=x.cache_key("description", F.lit("model-a"), F.lit("v1"), sep="||"))), _rel_sql(key="sha256(concat_ws('||', coalesce(description, ''), 'model-a', 'v1'))"))
_add("x17_pair_text", _rel(lambda: dict(pair=x.pair_text(F.coalesce("src_name", F.lit("")), F.coalesce("target", F.lit("")), F.lit("schema:kg")))), _rel_sql(pair="CASE WHEN coalesce(src_name, '') <= coalesce(target, '') THEN concat_ws('||', coalesce(src_name, ''), coalesce(target, ''), 'schema:kg') ELSE concat_ws('||', coalesce(target, ''), coalesce(src_name, ''), 'schema:kg') END"))
_add("x18_relation_key", _rel(lambda: dict(key=x.relation_key("src_grade", "src_name", "rel_type", "tgt_grade", "target"))), _rel_sql(key="coalesce(src_grade, '') || '|' || coalesce(src_name, '') || '|' || coalesce(rel_type, '') || '|' || coalesce(tgt_grade, '') || '|' || coalesce(target, '')"))
_dims = "CASE " + " ".join(f"WHEN contains(lower(coalesce(embedding_model, '')), '{k}') THEN {v}" for k, v in vocab.EMBEDDING_DIMS.items()) + f" ELSE {vocab.DEFAULT_DIM} END"
_add("x19_embedding_dims", lambda s, d: table(s, d, "concepts").groupBy("embedding_model").agg(F.first(x.embedding_dims("embedding_model")).alias("dims")), f"SELECT DISTINCT embedding_model, CAST({_dims} AS INTEGER) AS dims FROM concepts")
def _unfenced(s, d):
    """Records in fences with and without a language, or bare."""
    fenced = F.when(F.col("sub_id") % 3 == 0, F.concat(F.lit("```json\n"), "record", F.lit("\n```"))).when(F.col("sub_id") % 3 == 1, F.concat(F.lit("```\n"), "record", F.lit("\n```  "))).otherwise(F.col("record"))
    found = F.from_json(x.unfenced(fenced), "name string, description string, formula array<string>")
    return table(s, d, "subkonsep").dropDuplicates(["sub_id"]).select("sub_id", found.alias("j")).select("sub_id", "j.name", "j.description", F.coalesce(F.size("j.formula"), F.lit(-1)).cast("bigint").alias("n_formula"))


_add("x20_unfenced_json", _unfenced, """SELECT sub_id, j.name AS name, j.description AS description, coalesce(len(j.formula), -1) AS n_formula FROM (SELECT DISTINCT sub_id, from_json(record, '{"name":"VARCHAR","description":"VARCHAR","formula":["VARCHAR"]}') AS j FROM subkonsep)""")
_add("x21_dates", _rel(lambda: dict(day=F.date_format("created_at", "yyyy-MM-dd"), ms=F.unix_millis("created_at"))), _rel_sql(day="strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d')", ms="epoch_us(created_at) // 1000"))
_add("x22_ratio", lambda s, d: relations(s, d).groupBy("book_id").agg(x.ratio(F.sum(F.when(F.col("status") == "wrong", 1).otherwise(0)), F.count(F.lit(1)), 6).alias("wrong_rate")), "SELECT book_id, round(CAST(count(DISTINCT CASE WHEN status = 'wrong' THEN rel_id END) AS DOUBLE) / count(DISTINCT rel_id), 6) AS wrong_rate FROM relations GROUP BY book_id")
_add("x23_list_filters", lambda s, d: table(s, d, "konsep").dropDuplicates(["konsep_id"]).select("konsep_id", F.greatest(F.coalesce(F.size(F.filter("relations", lambda r: r["rel_type"].startswith("ME"))), F.lit(0)), F.lit(0)).cast("bigint").alias("n_me"), F.coalesce(F.trim("sub_bab"), F.lit("-")).alias("subtopic")), "SELECT konsep_id, CAST(coalesce(len(list_filter(any_value(relations), lambda r: starts_with(r.rel_type, 'ME'))), 0) AS BIGINT) AS n_me, coalesce(trim(any_value(sub_bab)), '-') AS subtopic FROM konsep GROUP BY konsep_id")
del sql_key, squeeze
