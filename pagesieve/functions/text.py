"""Text: whitespace, cleaning, signatures, lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regular-expression class that Java and RE2 both read.
WHITE_SPACE_CLASS = (
    r"[\t\n\x{0b}\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def text_or_empty(col: Column | str) -> Column:
    """Null strings count as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def trim_unicode(col: Column | str) -> Column:
    """Strip Unicode white space from both ends."""
    return F.btrim(text_or_empty(col), F.lit(WHITE_SPACE))


def clean_text(col: Column | str) -> Column:
    """Collapse every run of Unicode white space to one space and strip the ends."""
    return F.btrim(F.regexp_replace(text_or_empty(col), WHITE_SPACE_CLASS + "+", " "), F.lit(" "))


def content_signature(col: Column | str) -> Column:
    """Hex SHA-256 of the trimmed raw text; inner white space and case count."""
    return F.sha2(trim_unicode(col), 256)


def byte_length(col: Column | str) -> Column:
    return F.octet_length(text_or_empty(col))


def is_blank(col: Column | str) -> Column:
    return trim_unicode(col) == ""


def load_time_ms(nanoseconds: Column | str) -> Column:
    """Whole milliseconds of a positive nanosecond duration, else 0."""
    ns = F.col(nanoseconds) if isinstance(nanoseconds, str) else nanoseconds
    return F.when(ns > 0, F.call_function("div", ns, F.lit(1_000_000))).otherwise(F.lit(0).cast("long"))
