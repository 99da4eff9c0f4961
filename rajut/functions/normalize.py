"""Scalar normalisers (F1-F24): column in, column out, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rajut.functions import vocab
from rajut.functions.text import SPACE, squeeze


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mapping(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def strip(c: Column | str) -> Column:
    """Without white space at both ends, line ends included."""
    return F.regexp_replace(_c(c), f"^{SPACE}+|{SPACE}+$", "")


def rating_label(c: Column | str) -> Column:
    """one of the known labels, else 'unknown'."""
    t = F.lower(strip(c))
    t = F.coalesce(F.try_element_at(mapping(vocab.LABEL_ALIASES), t), t)
    return F.when(t.isin(*vocab.LABELS), t).otherwise("unknown")


def loose_label(c: Column | str) -> Column:
    """as F1, but other texts pass and null is ''."""
    t = F.coalesce(F.lower(strip(c)), F.lit(""))
    return F.coalesce(F.try_element_at(mapping(vocab.LABEL_ALIASES), t), t)


def scored_label(c: Column | str) -> Column:
    """the labels that count in the metrics, else null."""
    t = loose_label(c)
    return F.when(t.isin(*vocab.SCORED_LABELS), t)


def triple_number(c: Column | str) -> Column:
    """digits as a number, null for everything else (the text stays beside it)."""
    t = strip(c)
    return F.when(t.rlike("^[0-9]+$"), t.try_cast("bigint"))


def triple_key(c: Column | str) -> Column:
    """an id as text without final .0 and leading zeros; null is ''."""
    t = F.regexp_replace(F.coalesce(strip(_c(c).cast("string")), F.lit("")), r"\.0$", "")
    return F.when(t.rlike("^0+$"), F.lit("0")).otherwise(F.regexp_replace(t, "^0+", ""))


def content_key(*cols: Column | str) -> Column:
    """fields in lower case with single spaces, as a struct to join on."""
    return F.struct(*[squeeze(c).alias(f"k{i}") for i, c in enumerate(cols)])


def relation_type(c: Column | str) -> Column:
    """a canonical type, synonyms mapped; null means the relation is skipped."""
    t = F.upper(strip(c))
    known = F.when(t.isin(*vocab.RELATION_TYPES), t)
    return F.coalesce(known, F.try_element_at(mapping(vocab.RELATION_SYNONYMS), t))


def safe_relation(c: Column | str) -> Column:
    """F8: a name that may stand for a relationship: A-Z, 0-9 and single underscores, no leading digit."""
    t = F.regexp_replace(F.upper(strip(F.coalesce(_c(c), F.lit("")))), "[^A-Z0-9_]", "_")
    t = F.regexp_replace(F.regexp_replace(t, "_+", "_"), "^_|_$", "")
    return F.when(t == "", "RELATED_TO").when(t.rlike("^[0-9]"), F.concat(F.lit("REL_"), t)).otherwise(t)


def compact_json(c: Column | str) -> Column:
    """JSON without spaces; null is ''."""
    return F.coalesce(F.to_json(_c(c)), F.lit(""))


def cross_type(c: Column | str) -> Column:
    """with the cross-book prefix; null and '' are the bare prefix."""
    t = F.coalesce(_c(c), F.lit(""))
    return F.when(t == "", vocab.CROSS_PREFIX).when(t.startswith(vocab.CROSS_PREFIX), t).otherwise(F.concat(F.lit(vocab.CROSS_PREFIX + "_"), t))


def bare_type(c: Column | str) -> Column:
    """without the cross-book prefix."""
    return F.regexp_replace(_c(c), f"^{vocab.CROSS_PREFIX}_", "")


def full_relations(c: Column | str) -> Column:
    """the relations of an array that have a type and a target."""
    return F.filter(_c(c), lambda r: (strip(F.coalesce(r["rel_type"], F.lit(""))) != "") & (strip(F.coalesce(r["target"], F.lit(""))) != ""))


def is_chapter(c: Column | str) -> Column:
    """chapter headings begin with Bab or BAB and a space."""
    return F.coalesce(_c(c).rlike("^(Bab|BAB) "), F.lit(False))


def all_present(*cols: Column | str) -> Column:
    """no field is null or blank."""
    tests = [strip(F.coalesce(_c(c), F.lit(""))) != "" for c in cols]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def counted(label: Column | str) -> Column:
    """labels that are neither to be ignored nor unknown nor blank."""
    return ~F.coalesce(_c(label), F.lit("")).isin("abaikan", "unknown", "")


def not_wrong(consensus: Column | str, status: Column | str) -> Column:
    """F16: a blank consensus wins over the status, only null yields to it."""
    return F.coalesce(_c(consensus), _c(status), F.lit("")) != "wrong"


def refined_description(description, label, reasoning, source) -> Column:
    """the judge's reasoning replaces the description of partial and missing additions."""
    reason = strip(F.coalesce(_c(reasoning), F.lit("")))
    adopt = rating_label(label).isin("partial", "missing") & (reason != "") & ~reason.isin(vocab.AGREED_RATINGS, vocab.AGREED_MISSING) & (strip(F.coalesce(_c(source), F.lit(""))) != "system_generated")
    return F.when(adopt, reason).otherwise(strip(F.coalesce(_c(description), F.lit(""))))


def subject_of(grade: Column | str) -> Column:
    """the subject of a grade such as 'Kimia Kelas XI'."""
    return F.regexp_replace(_c(grade), " Kelas (XII|XI|X)$", "")


def title_of(slug: Column | str) -> Column:
    """a slug as a title."""
    return F.initcap(F.translate(_c(slug), "_-", "  "))


def plain_text(c: Column | str) -> Column:
    """lower case a-z, digits and single spaces."""
    t = F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), "[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(t, " +", " "))


def checkpoint_key(*cols: Column | str) -> Column:
    """values in lower case joined by |; null is '', and 0 is 0."""
    return F.concat_ws("|", *[F.lower(strip(F.coalesce(_c(c).cast("string"), F.lit("")))) for c in cols])


def passes_gate(rel_type: Column | str, confidence: Column | str, gates: dict[str, float] | None = None, default: float = vocab.DEFAULT_GATE) -> Column:
    """confidence reaches the gate of its type; null confidence does not."""
    gates = vocab.CONFIDENCE_GATE if gates is None else gates
    gate = F.lit(default)
    for t, least in gates.items():
        gate = F.when(_c(rel_type) == t, F.lit(least)).otherwise(gate)
    return F.coalesce(_c(confidence) >= gate, F.lit(False))
