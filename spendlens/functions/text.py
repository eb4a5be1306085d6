"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip() removes (str.isspace): tab, line feed,
# vertical tab, form feed, carriage return, file/group/record/unit separators, space, NEL,
# no-break space, Ogham space mark, en quad ... hair space, line separator, paragraph
# separator, narrow no-break space, medium mathematical space, ideographic space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def utrim(c: Column) -> Column:
    """Remove leading and trailing Unicode whitespace (Spark's ``trim`` only removes spaces).

    ``btrim`` with a literal character set: no regular expression per value.
    """
    return F.btrim(c, F.lit(WHITESPACE))


def has_text(c: Column) -> Column:
    """Whether a text holds anything but blanks, tabs and line ends; the search ends at the first
    character that is none of these. Null for a null text."""
    return c.rlike("[^ \\t\\r\\n]")


def strip_fences(c: Column) -> Column:
    """Remove code fences around a model response, by character sets (not prefixes):
    surrounding whitespace, then any leading run of the characters ` j s o n, then any
    trailing run of backticks."""
    return F.rtrim(F.ltrim(utrim(c), F.lit("`json")), F.lit("`"))


def is_json_array(c: Column) -> Column:
    """True when the text is a JSON array (a bare object or other value is rejected)."""
    return c.rlike(r"^\s*\[")
