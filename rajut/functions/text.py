"""Column expressions on text shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_ALNUM = r"[^\p{L}\p{N}]"
WORD_BYTES = r"[^ \t\r\n]+"
#: Unicode white space.
SPACE = r"[\s\p{Z}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def alike_key(c: Column | str) -> Column:
    """The letters and digits of a text in order, lower-cased; null stays null."""
    return F.lower(F.regexp_replace(_col(c), NOT_ALNUM, ""))


def squeeze(c: Column | str) -> Column:
    """Lower-case, trimmed, inner white space collapsed; null becomes ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), SPACE + "+", " "))


def n_words(c: Column | str) -> Column:
    """Runs of characters other than space, tab, CR and LF; null counts 0."""
    return F.coalesce(F.regexp_count(_col(c), F.lit(WORD_BYTES)), F.lit(0))


def blank_to_null(c: Column | str) -> Column:
    t = F.trim(_col(c))
    return F.when(t == "", None).otherwise(t)
