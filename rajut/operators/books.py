"""Books as text: chapters, glossary state, page ranges, token links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rajut.functions.scalars import meaningful_tokens
from rajut.session import cut

LAST_PAGE = 10_000
#: Rows of a block of token_links; rows and tokens that are compared at a time.
LINK_BLOCK, LINK_STEP, LINK_WORDS = 4096, 512, 2048


def chapter_order(chapters: DataFrame) -> DataFrame:
    """Previous and next chapter and the page where the next begins. chapters: book, chapter, page_start."""
    w = Window.partitionBy("book").orderBy("page_start", "chapter")
    return chapters.select("book", "chapter", "page_start", F.lag("chapter").over(w).alias("previous"), F.lead("chapter").over(w).alias("next"), F.coalesce(F.lead("page_start").over(w), F.lit(LAST_PAGE)).alias("page_end"))


def page_chapter(pages: DataFrame, ordered: DataFrame) -> DataFrame:
    """The chapter of each page (first match wins); pages before the first chapter have none.

    As-of within a book: chapters and pages are merged by page and each page takes
    the last chapter start before it, so there is no range join.
    """
    a = ordered.select("book", F.col("page_start").alias("page"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), F.col("chapter"))
    b = pages.select("book", "page", F.lit(1).alias("kind"), "page_id", F.lit(None).cast("string").alias("chapter"))
    w = Window.partitionBy("book").orderBy("page", "kind", "chapter").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("in_chapter", F.last("chapter", ignorenulls=True).over(w)).where(F.col("kind") == 1).select("book", "page_id", "page", F.col("in_chapter").alias("chapter"))


def glossary_pages(pages: DataFrame) -> DataFrame:
    """Pages between the one that opens the glossary and the one that closes it. pages: book, page, text."""
    low = F.lower(F.coalesce("text", F.lit("")))
    upto = Window.partitionBy("book").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    marked = pages.withColumn("_open", F.max(low.rlike(r"\bglosarium\b").cast("int")).over(upto))
    ends = marked.withColumn("_close", F.max(((F.col("_open") == 1) & low.rlike("indeks|daftar pustaka|profil")).cast("int")).over(upto))
    return ends.where((F.col("_open") == 1) & (F.col("_close") == 0)).drop("_open", "_close")


#: Text of this size or more is a heading. Longest terms of the three readings.
HEADING, TERM_LENGTHS = 13, {"bold": 60, "block": 60, "stop": 45}
#: Running headers of the books (fixed values).
HEADERS = ("untuk SMA", "Kelas XII")


def _entries(rows: DataFrame, reading: str, opens: Column, in_term: Column) -> DataFrame:
    """book, reading, at, term, definition of rows (book, at, text): each row where ``opens`` holds begins an entry.

    Rows of an entry where ``in_term`` holds make its term, the others its definition.
    """
    upto = Window.partitionBy("book").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("_opens", opens.cast("int")).withColumn("_entry", F.sum("_opens").over(upto)).where(F.col("_entry") > 0)
    first = Window.partitionBy("book", "_entry").orderBy("at")
    placed = numbered.withColumn("_n", F.row_number().over(first)).withColumn("_term", in_term)
    side = lambda of_term: F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.when(F.col("_term") == of_term, F.struct("at", "text")))), lambda x: x["text"]))
    one = placed.groupBy("book", "_entry").agg(F.min("at").alias("at"), side(True).alias("term"), side(False).alias("definition"))
    neat = lambda c, edge: F.trim(F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), edge, ""))
    tidy = one.select("book", F.lit(reading).alias("reading"), "at", neat("term", r"\s*:+$").alias("term"), neat("definition", r"^:+\s*").alias("definition"))
    return tidy.where((F.col("term") != "") & (F.col("definition") != "") & (F.length("term") <= TERM_LENGTHS[reading]) & ~F.lower("term").isin("glosarium", "daftar pustaka"))


def glossaries(spans: DataFrame, headers: tuple[str, ...] = HEADERS) -> DataFrame:
    """Book, term, definition of glossary pages, whose layout is not known.

    spans: book, page, block, line, pos, text, bold, size. Three readings are tried as
    segmentations of a book: an entry begins at a bold span after one that is not bold;
    at each block of several lines, whose first line is the term; or after a line that
    ends with a full stop. The reading with most terms is kept (ties: in that order); a
    term given twice keeps its first definition. Windows are per book: a glossary is a
    few pages of one.
    """
    heading = (F.col("size") >= HEADING) & (F.lower(F.trim("text")) == "glosarium")
    given = spans.where((F.trim("text") != "") & ~heading).withColumn("at", F.struct("page", "block", "line", "pos"))
    bold = given.select("book", "at", "text", (F.col("bold") & (F.col("size") < HEADING)).alias("_bold"))
    fresh = F.col("_bold") & ~F.coalesce(F.lag("_bold").over(Window.partitionBy("book").orderBy("at")), F.lit(False))

    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])
    lines = given.groupBy("book", "page", "block", "line").agg(F.trim(F.concat_ws(" ", parts)).alias("text")).select("book", F.struct("page", "block", "line").alias("at"), "text")
    block = Window.partitionBy("book", "at.page", "at.block")
    several = lines.withColumn("_lines", F.count(F.lit(1)).over(block)).withColumn("_head", F.row_number().over(block.orderBy("at")) == 1)
    several = several.withColumn("_name", F.max(F.when(F.col("_head"), F.col("text"))).over(block)).where((F.col("_lines") > 1) & ~F.col("_name").rlike("^[0-9]+$"))

    body = lines.where(~F.col("text").rlike("^[0-9]+$") & (F.lower("text") != "glosarium"))
    for h in headers:
        body = body.where(~F.col("text").contains(h))
    after_stop = F.coalesce(F.lag("text").over(Window.partitionBy("book").orderBy("at")).endswith("."), F.lit(True))

    found = [_entries(bold, "bold", fresh, F.col("_bold")), _entries(several, "block", F.col("_head"), F.col("_n") == 1), _entries(body, "stop", after_stop, F.col("_n") == 1)]
    every = None
    for order, f in enumerate(found):
        once = f.groupBy("book", "term").agg(F.min_by("definition", "at").alias("definition"), F.lit(order).alias("order"))
        every = once if every is None else every.unionByName(once)
    sizes = every.groupBy("book", "order").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.groupBy("book").agg(F.max_by("order", F.struct("n", -F.col("order"))).alias("order"))
    return every.join(best, ["book", "order"]).select("book", "term", "definition")


def sentence_chunks(df: DataFrame, id_col: str, text_col: str, limit: int = 800, overlap: int = 200) -> DataFrame:
    """text_id, chunk_no (from 0), n_words, chunk: whole sentences up to ``limit`` words, repeating up to ``overlap`` words.

    A sentence ends at a full stop, question or exclamation mark before white space;
    one of more than ``limit`` words is cut into parts of ``limit`` words first. Each
    chunk takes as many sentences as fit; the next begins as far back as the overlap
    and room for one more sentence allow. Only word counts go to Python. Texts that
    are null or blank give nothing; an id given twice counts once.
    """
    base = df.select(F.col(f"`{id_col}`").alias("text_id"), F.col(f"`{text_col}`").alias("body")).where(F.col("text_id").isNotNull()).dropDuplicates(["text_id"])
    sentences = F.split(F.regexp_replace(F.trim(F.regexp_replace("body", r"\s+", " ")), r"([.?!]) ", "$1\n"), "\n")
    piece = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(F.split(s, " ")) - 1) / limit).cast("int")), lambda k: F.array_join(F.slice(F.split(s, " "), k * limit + 1, limit), " "))
    cut_up = base.withColumn("s", F.filter(F.flatten(F.transform(sentences, piece)), lambda x: x != "")).where(F.size("s") > 0)
    sized = cut_up.select("text_id", "s", F.transform("s", lambda x: F.size(F.split(x, " "))).alias("sizes"))
    id_type = base.schema["text_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, s[a:z], int(sum(sizes[a:z]))) for i, s, sizes in zip(b["text_id"], b["s"], b["sizes"]) for n, (a, z) in enumerate(packed(sizes, limit, overlap))]
            yield pd.DataFrame(rows, columns=["text_id", "chunk_no", "held", "n_words"])

    return sized.mapInPandas(run, f"text_id {id_type}, chunk_no int, held array<string>, n_words int").select("text_id", "chunk_no", "n_words", F.array_join("held", " ").alias("chunk"))


def packed(sizes, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of items: each as long as fits in ``limit``, the next repeating at most ``overlap`` of the one before."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    n, a, out = len(sizes), 0, []
    while True:
        z = int(np.searchsorted(upto, upto[a] + limit, "right")) - 1
        out.append((a, z))
        if z == n:
            return out
        # as early as the overlap and the next item allow, but later than this start
        a = max(a + 1, int(np.searchsorted(upto, max(upto[z] - overlap, upto[z + 1] - limit), "left")))


def flat_context(books: DataFrame) -> DataFrame:
    """Chapter, page and text of the chunks of nested book documents; blank texts dropped."""
    chunk = books.select("book", F.posexplode("chapters").alias("ci", "c")).select("book", "ci", F.col("c.chapter").alias("chapter"), F.posexplode("c.chunks").alias("ki", "k"))
    page = F.coalesce(F.nullif("k.page_label", F.lit("")), F.col("k.page"), F.lit("?"))
    return chunk.where(F.trim(F.coalesce("k.text", F.lit(""))) != "").select("book", "ci", "ki", "chapter", page.alias("page"), F.col("k.text").alias("text"))


def running_triples(konsep: DataFrame) -> DataFrame:
    """Relations of a book with a running number from 0, in the order of chapter, subtopic, concept and position."""
    flat = konsep.select("book_id", "bab", "sub_bab", "konsep_id", "name", F.posexplode("relations").alias("pos", "r"))
    w = Window.partitionBy("book_id").orderBy("bab", "sub_bab", "konsep_id", "pos")
    return flat.select("book_id", (F.row_number().over(w) - 1).alias("triple_no"), "konsep_id", "pos", F.col("name").alias("subject"), F.col("r.rel_type").alias("relation"), F.col("r.target").alias("target"))


def token_links(concepts: DataFrame, least: int = 2, most: int = 2, most_holders: int = 200, asked: Column | None = None) -> DataFrame:
    """Links between concepts of different books that share at least ``least`` meaningful tokens, ``most`` per concept.

    concepts: id, book, text; one row an id. All tokens count. Pairs that share a
    token which at most ``most_holders`` concepts hold meet by it and are scored in
    full. Any other pair shares commoner tokens only, so it is among the links
    only if it is among the best by common tokens, which are found for each
    different set of them (``_common_links``). ``most_holders`` sets the cost, not
    the result. ``asked`` states which concepts ask (all by default); all answer.
    """
    asked = F.lit(True) if asked is None else asked
    toks = cut(concepts.select("id", "book", meaningful_tokens("text").alias("tokens")).where(F.col("book").isNotNull()))
    flat = toks.select("id", "book", F.explode("tokens").alias("t"))
    counts = cut(flat.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1))
    rare = flat.join(counts.where(F.col("c") <= most_holders), "t").drop("c")
    a, b = rare.where(asked).select("t", F.col("id").alias("a"), F.col("book").alias("ba")), rare.select("t", F.col("id").alias("b"), F.col("book").alias("bb"))
    met = a.join(b, "t").where((F.col("ba") != F.col("bb")) & (F.col("a") != F.col("b"))).select("a", "b").distinct()
    full = met.join(toks.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(toks.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    scored = full.select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("n_shared"))
    common = flat.join(counts.where(F.col("c") > most_holders), "t").groupBy("id", "book").agg(F.array_sort(F.collect_list("t")).alias("tokens"))
    both = scored.unionByName(_common_links(common, least, most, asked)).where(F.col("n_shared") >= least)
    once = both.groupBy("a", "b").agg(F.max("n_shared").alias("n_shared"))
    w = Window.partitionBy("a").orderBy(F.desc("n_shared"), "b")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def _common_links(held: DataFrame, least: int, most: int, asked: Column) -> DataFrame:
    """a, b, n_shared: for each concept the ``most`` of other books that share the most of ``tokens``, ties to the smaller id.

    held: id, book, tokens. Concepts of one book with equal tokens are asked once,
    and of a set of tokens only the ids that can be among the ``most`` of any other
    book answer. Askers and answers are compared exactly, block by block.
    """
    same = Window.partitionBy("tokens", "book")
    ranked = held.where(F.size("tokens") >= least).withColumn("asker", F.min("id").over(same)).withColumn("_n", F.row_number().over(same.orderBy("id"))).withColumn("_asks", F.max(asked).over(same))
    ranked = cut(ranked)
    answers = ranked.where(F.col("_n") <= most).withColumn("_n", F.row_number().over(Window.partitionBy("tokens").orderBy("id"))).where(F.col("_n") <= 2 * most)
    askers, given = (_blocks(x) for x in (ranked.where((F.col("_n") == 1) & F.col("_asks")), answers))
    pairs = askers.select(F.col("rows").alias("q")).crossJoin(given.select(F.col("rows").alias("r")))
    id_type = held.schema["id"].dataType.simpleString()
    best = pairs.mapInArrow(_best_of_blocks(least, most), f"asker {id_type}, b {id_type}, n_shared int")
    w = Window.partitionBy("asker").orderBy(F.desc("n_shared"), "b")
    top = best.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
    return ranked.where(asked).select(F.col("id").alias("a"), "asker").join(top, "asker").select("a", "b", "n_shared")


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks of about LINK_BLOCK rows, each an array of (id, book, tokens) in the order of id; a partition each."""
    n = max(1, math.ceil(rows.count() / LINK_BLOCK))
    packed = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("id", "book", "tokens"))).alias("rows"))
    return cut(packed.repartition(n, "block"))


def _best_of_blocks(least: int, most: int):
    """Function for mapInArrow: rows of two blocks (q, r) to the best of r for each of q."""

    def coded(rows: pa.Array, books: dict, words: dict) -> tuple:
        tokens = rows.field("tokens")
        known = tokens.flatten().dictionary_encode()
        code = np.array([words.setdefault(t, len(words)) for t in known.dictionary.to_pylist()], dtype=np.int64)
        book = np.array([books.setdefault(x, len(books)) for x in rows.field("book").to_pylist()], dtype=np.int64)
        sizes = tokens.value_lengths().to_numpy(zero_copy_only=False)
        return rows.field("id"), book, np.repeat(np.arange(len(rows)), sizes), code[known.indices.to_numpy(zero_copy_only=False)], int(sizes.max())

    def compare(q: pa.Array, r: pa.Array) -> pa.RecordBatch:
        books, words = {}, {}
        q_id, q_book, q_row, q_tok, longest = coded(q, books, words)
        r_id, r_book, r_row, r_tok, _ = coded(r, books, words)
        n = len(r)
        kind = np.float32 if (longest + 1) * n < 2**24 else np.float64  # whole numbers up to there are exact
        columns = {k: np.flatnonzero(r_book == k) for k in np.unique(q_book).tolist()}
        place = np.arange(n, 0, -1, dtype=kind)  # the smaller id first
        order = np.argsort(q_book, kind="stable")
        at = np.empty(len(q), np.int64)
        at[order] = np.arange(len(q))
        q_row, q_book = at[q_row], q_book[order]
        askers, found, shared = [], [], []
        for start in range(0, len(q), LINK_STEP):
            stop = min(start + LINK_STEP, len(q))
            mine = (q_row >= start) & (q_row < stop)
            keys = np.zeros((stop - start, n), kind)
            for low in range(0, len(words), LINK_WORDS):
                width = min(LINK_WORDS, len(words) - low)
                x, y = np.zeros((stop - start, width), kind), np.zeros((n, width), kind)
                use = mine & (q_tok >= low) & (q_tok < low + width)
                x[q_row[use] - start, q_tok[use] - low] = n
                use = (r_tok >= low) & (r_tok < low + width)
                y[r_row[use], r_tok[use] - low] = 1
                keys += x @ y.T
            keys += place
            for k in np.unique(q_book[start:stop]).tolist():
                of = np.flatnonzero(q_book[start:stop] == k)
                keys[np.ix_(of, columns[k])] = 0
            lines = np.arange(stop - start)
            for _ in range(min(most, n)):
                j = keys.argmax(axis=1)
                count = -(-keys[lines, j].astype(np.int64) // n) - 1  # key = shared * n + (1 to n), 0 in the own book
                keep = count >= least
                askers.append(order[start:stop][keep])
                found.append(j[keep])
                shared.append(count[keep])
                keys[lines, j] = 0
        return pa.RecordBatch.from_arrays([q_id.take(pa.array(np.concatenate(askers))), r_id.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(shared).astype(np.int32))], names=["asker", "b", "n_shared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield compare(batch.column("q")[i].values, batch.column("r")[i].values)

    return run


def pages_of(files: DataFrame, parser) -> DataFrame:
    """Pages of binary documents by an injected parser(bytes) -> list of (label, text). files: path, content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, i, label, text) for p, c in zip(b["path"], b["content"]) for i, (label, text) in enumerate(parser(c))]
            yield pd.DataFrame(rows, columns=["path", "page", "page_label", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, page_label string, text string")
