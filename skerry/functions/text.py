"""Text functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.query import query_words  # noqa: F401

#: Letters, digits and underscore of any script, and the apostrophe.
WORD = r"[\p{L}\p{N}_']+"
BETWEEN = r"[^\p{L}\p{N}_']+"
#: All that counts as blank; none lies beyond U+3000.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def normalize(value: Column) -> Column:
    """Stripped of Unicode blanks, lower case; null as empty."""
    return F.coalesce(F.lower(F.btrim(value.cast("string"), F.lit(BLANKS))), F.lit(""))


def collapse(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"(?U)[\s\x1c-\x1f]+", " "))


def tokens(value: Column) -> Column:
    """Words of at least three characters with a letter.  Split at what lies between
    them: to extract matches copies the whole text for each."""
    return F.filter(F.split(value, BETWEEN, -1), lambda t: (F.length(t) >= 3) & t.rlike(r"\p{L}"))


def tag_value(text: Column) -> Column:
    """A tag without its leading [label]."""
    return F.trim(F.regexp_replace(text, r"^\[[^\]]*\]", ""))


def percent(score: Column) -> Column:
    return F.concat(F.bround(score * 100).cast("int").cast("string"), F.lit("%"))


def clock(seconds: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(seconds / 60), seconds % 60)
