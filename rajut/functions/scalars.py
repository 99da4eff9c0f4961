"""Text, JSON, key and number functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rajut.functions import vocab
from rajut.functions.normalize import strip
from rajut.functions.text import squeeze

# fixed values: what a contents line and a section line look like
TOC_CHAPTER = r"(?i)(bab\s+(?:\d+|[IVXLCDM]+))\s+(.+?)\s*\.{2,}\s*(\d+)"
TOC_SECTION = r"(?m)^[ \t]*([A-Z])\.\s+(.+?)\s*\.{2,}\s*(\d+)"
#: Titles after the last chapter (fixed values).
BACK_MATTER = ("glosarium", "indeks", "daftar pustaka", "profil")
#: What stands for an empty list in prompts (fixed value).
NOTHING = "(tidak ada)"
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def toc_chapters(text: Column | str) -> Column:
    """Chapters of a table of contents as structs (label, title, page), back matter left out."""
    found = [F.regexp_extract_all(_c(text), F.lit(TOC_CHAPTER), F.lit(i)) for i in (1, 2, 3)]
    rows = F.transform(F.arrays_zip(*[f.alias(n) for f, n in zip(found, "abc")]), lambda r: F.struct(r["a"].alias("label"), r["b"].alias("title"), r["c"].cast("int").alias("page")))
    return F.filter(rows, lambda r: ~F.lower(r["title"]).rlike("|".join(BACK_MATTER)))


def toc_sections(text: Column | str) -> Column:
    """Lettered sections of a table of contents as structs (letter, title, page)."""
    found = [F.regexp_extract_all(_c(text), F.lit(TOC_SECTION), F.lit(i)) for i in (1, 2, 3)]
    return F.transform(F.arrays_zip(*[f.alias(n) for f, n in zip(found, "abc")]), lambda r: F.struct(r["a"].alias("letter"), r["b"].alias("title"), r["c"].cast("int").alias("page")))


def is_toc_page(text: Column | str, page: Column | str, pages: int = 20) -> Column:
    """Among the first pages, with a chapter word and dotted page numbers."""
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    return (_c(page) <= pages) & (low.contains("daftar isi") | low.contains("bab")) & low.rlike(r"\.{3,}\s*\d+")


def glossary_lines(text: Column | str) -> Column:
    """The 'term: definition' lines of a page, those with exactly one colon."""
    lines = F.transform(F.split(F.coalesce(_c(text), F.lit("")), "\n"), lambda x: F.trim(x))
    pairs = F.transform(F.filter(lines, lambda x: F.size(F.split(x, ":")) == 2), lambda x: F.struct(F.trim(F.split(x, ":")[0]).alias("term"), F.trim(F.split(x, ":")[1]).alias("definition")))
    return F.filter(pairs, lambda p: (p["term"] != "") & (p["definition"] != ""))


def topic_lines(text: Column | str) -> Column:
    """Lines of under ten words that begin with a capital and are no instructions."""
    lines = F.filter(F.transform(F.split(F.coalesce(_c(text), F.lit("")), "\n"), lambda x: strip(x)), lambda x: x != "")
    keep = lambda x: (F.size(F.split(x, r"\s+")) < 10) & x.rlike(r"^\p{Lu}") & ~x.contains("Peserta didik") & ~x.contains("Tujuan") & ~x.contains("Kegiatan")
    return F.array_distinct(F.filter(lines, keep))


def roman_number(c: Column | str) -> Column:
    """A Roman numeral's value; other letters count 0."""
    values = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    digits = F.transform(F.split(F.lower(_c(c)), ""), lambda x: F.coalesce(F.try_element_at(values, x), F.lit(0)))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    step = lambda a, v: F.struct((a["sum"] + F.when(v < a["last"], -v).otherwise(v)).alias("sum"), v.alias("last"))
    return F.aggregate(F.reverse(digits), start, step, lambda a: a["sum"])


def page_number(label: Column | str) -> Column:
    """The number of an arabic or Roman page label."""
    t = strip(label)
    return F.when(t.rlike("^[0-9]+$"), t.try_cast("int")).otherwise(roman_number(t))


def variable(c: Column | str) -> Column:
    """Name, label and unit of 'v (label, unit)'; what does not fit is the name."""
    t = strip(c)
    # fixed value
    pattern = r"^([^\s(]+)\s*\(([^,)]+)(?:,\s*([^)]+))?\)"
    fits = t.rlike(pattern)
    part = lambda i: F.nullif(F.trim(F.regexp_extract(t, pattern, i)), F.lit(""))
    return F.struct(F.when(fits, part(1)).otherwise(t).alias("name"), F.when(fits, part(2)).alias("label"), F.when(fits, part(3)).alias("unit"))


def _tokens(c: Column | str, pattern: str, least: int, stop: list[str]) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit(pattern), F.lit(0))
    return F.array_distinct(F.filter(F.array_except(words, F.array(*[F.lit(s) for s in stop])), lambda t: F.length(t) >= least))


def context_terms(c: Column | str) -> Column:
    """Different words of more than two letters, without stop words."""
    return _tokens(c, "[0-9a-zà-öø-ÿ]+", 3, vocab.CONTEXT_STOPWORDS)


def meaningful_tokens(c: Column | str) -> Column:
    """X11: different words of at least four letters, without stop words."""
    return _tokens(c, "[a-z0-9]+", 4, vocab.TOKEN_STOPWORDS)


def chunk_score(terms: Column | str, chapter: Column | str, text: Column | str, asked: Column | str) -> Column:
    """Number of terms that occur in the chunk, and 3 more for the same chapter."""
    body = F.lower(F.concat_ws(" ", F.coalesce(_c(chapter), F.lit("")), F.coalesce(_c(text), F.lit(""))))
    same = (F.lower(F.trim(F.coalesce(_c(asked), F.lit("")))) != "") & (F.lower(F.trim(F.coalesce(_c(chapter), F.lit("")))) == F.lower(F.trim(_c(asked))))
    return F.size(F.filter(_c(terms), lambda t: F.contains(body, t))) + F.when(same, 3).otherwise(0)


def list_text(c: Column | str) -> Column:
    """A list as text, with a note if it is empty."""
    return F.when(F.coalesce(F.size(_c(c)), F.lit(0)) <= 0, NOTHING).otherwise(F.array_join(_c(c), ", "))


def edges_text(edges: Column | str) -> Column:
    """Out-edges (rel_type, target, confidence) as lines, known confidences with two decimals."""
    conf = lambda e: F.when(e["confidence"].isNull(), "").otherwise(F.format_string(" (conf: %.2f)", e["confidence"]))
    lines = F.transform(_c(edges), lambda e: F.concat(F.lit("  - "), F.coalesce(e["rel_type"], F.lit("")), F.lit(' → "'), F.coalesce(e["target"], F.lit("")), F.lit('"'), conf(e)))
    return F.when(F.coalesce(F.size(_c(edges)), F.lit(0)) <= 0, "  " + NOTHING).otherwise(F.array_join(lines, "\n"))


def fingerprint(*cols: Column | str) -> Column:
    """12 hex digits of a context."""
    return F.substring(F.md5(F.to_json(F.struct(*[_c(c).alias(f"p{i}") for i, c in enumerate(cols)]))), 1, 12)


def cache_key(*parts: Column | str, sep: str = "") -> Column:
    """SHA-256 of text, model and version."""
    return F.sha2(F.concat_ws(sep, *[F.coalesce(_c(p), F.lit("")) for p in parts]), 256)


def pair_text(a: Column | str, b: Column | str, *more: Column | str) -> Column:
    """A pair's text, the same for either order."""
    return F.concat_ws("||", F.array_sort(F.array(_c(a), _c(b))), *[_c(m) for m in more])


def relation_key(*parts: Column | str) -> Column:
    """Parts joined by |, null as ''."""
    return F.concat_ws("|", *[F.coalesce(_c(p), F.lit("")) for p in parts])


def embedding_dims(model: Column | str) -> Column:
    """Dimensions by part of the model's name."""
    low = F.lower(F.coalesce(_c(model), F.lit("")))
    out = F.when(F.lit(False), F.lit(0))
    for part, dim in vocab.EMBEDDING_DIMS.items():
        out = out.when(low.contains(part), F.lit(dim))
    return out.otherwise(F.lit(vocab.DEFAULT_DIM))


def unfenced(c: Column | str) -> Column:
    """A model's answer without the code fence around it."""
    return strip(F.regexp_replace(_c(c), r"^\s*```(?:json)?\s*|\s*```\s*$", ""))


def ratio(a: Column | str, b: Column | str, digits: int | None = None) -> Column:
    """A / b, 0 where b is 0."""
    out = F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(0.0))
    return out if digits is None else F.round(out, digits)


def same_text(a: Column | str, b: Column | str) -> Column:
    """F21 as a test."""
    return squeeze(a) == squeeze(b)
