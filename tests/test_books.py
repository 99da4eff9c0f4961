"""Token links against all pairs."""

import random

import pytest

from rajut.operators import books


def all_links(rows, least=2, most=2):
    out = set()
    toks = {i: set(text.split()) for i, _, text in rows}
    for a, book, _ in rows:
        met = sorted((-len(toks[a] & toks[b]), b) for b, other, _ in rows if None not in (book, other) and other != book and len(toks[a] & toks[b]) >= least)
        out |= {(a, b, -n, k + 1) for k, (n, b) in enumerate(met[:most])}
    return out


@pytest.mark.parametrize("holders, block", [(200, 4096), (5, 4096), (5, 17), (1, 40)])
def test_token_links_count_tokens_that_many_concepts_hold(spark, monkeypatch, holders, block):
    monkeypatch.setattr(books, "LINK_BLOCK", block)
    rng = random.Random(holders)
    common, rare = [f"umum{i}" for i in range(8)], [f"jarang{i}" for i in range(60)]
    rows = [(i, rng.choice((1, 2, 3, 3, 3, None)), " ".join(rng.sample(common, rng.randrange(6)) + rng.sample(rare, rng.randrange(3)))) for i in range(150)]
    out = books.token_links(spark.createDataFrame(rows, "id long, book long, text string"), most_holders=holders)
    assert {tuple(r) for r in out.select("a", "b", "n_shared", "rank").collect()} == all_links(rows)


def test_token_links_of_no_concepts(spark):
    assert books.token_links(spark.createDataFrame([], "id long, book long, text string")).count() == 0


SPANS = "book long, page int, block long, line long, pos int, text string, bold boolean, size double"


def read(spark, *spans):
    """spans: block, line, text, bold, size of one page."""
    rows = [(7, 1, b, ln, p, text, bold, float(size)) for p, (b, ln, text, bold, size) in enumerate(spans)]
    return {r["term"]: r["definition"] for r in books.glossaries(spark.createDataFrame(rows, SPANS)).collect()}


def test_glossary_of_bold_terms(spark):
    got = read(spark, (0, 0, "Glosarium", True, 14), (0, 1, "atom", True, 10), (0, 1, ": bagian kecil", False, 10), (0, 2, "gaya", True, 10), (0, 2, "tarik:", True, 10), (0, 2, " tarikan  atau", False, 10), (0, 3, "dorongan", False, 10), (0, 4, "atom", True, 10), (0, 4, "lain", False, 10))
    assert got == {"atom": "bagian kecil", "gaya tarik": "tarikan atau dorongan"}


def test_glossary_of_blocks(spark):
    got = read(spark, (1, 0, "atom", False, 10), (1, 1, "bagian", False, 10), (1, 2, "kecil", False, 10), (2, 3, "gaya", False, 10), (2, 4, "tarikan", False, 10), (3, 5, "12", False, 10), (3, 6, "halaman", False, 10), (4, 7, "sendiri", False, 10))
    assert got == {"atom": "bagian kecil", "gaya": "tarikan"}


def test_glossary_of_lines_up_to_a_stop(spark):
    lines = ["Glosarium", "atom", "bagian", "kecil.", "12", "Kimia untuk SMA", "gaya", "tarikan."]
    got = read(spark, *[(i, i, t, False, 10) for i, t in enumerate(lines)])
    assert got == {"atom": "bagian kecil.", "gaya": "tarikan."}
    assert read(spark, (0, 0, " ", False, 10)) == {}


def test_sentence_chunks(spark):
    text = " ".join(f"k{i} dua tiga empat lima." for i in range(20))
    rows = [(1, text), (1, text), (2, None), (3, "  "), (4, "kata " * 25), (None, "a b.")]
    got = [(r["text_id"], r["chunk_no"], r["n_words"], r["chunk"]) for r in books.sentence_chunks(spark.createDataFrame(rows, "id long, body string"), "id", "body", limit=22, overlap=6).orderBy("text_id", "chunk_no").collect()]
    first = [c for c in got if c[0] == 1]
    assert all(n <= 22 and c.endswith(".") and n == len(c.split()) for _, _, n, c in first)
    # each chunk repeats the last sentence of the one before, and together they hold all
    assert all(b[3].startswith(a[3].split(". ")[-1].rstrip(".")) for a, b in zip(first, first[1:]))
    assert {w for _, _, _, c in first for w in c.split() if w[0] == "k"} == {f"k{i}" for i in range(20)}
    assert [(n, c.split()) for i, _, n, c in got if i == 4] == [(22, ["kata"] * 22), (3, ["kata"] * 3)]
    assert {c[0] for c in got} == {1, 4}
