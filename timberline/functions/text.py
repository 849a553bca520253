"""Small text helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware trim removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# English month abbreviations, January first.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
MONTH_PATTERN = "|".join(MONTHS)


def trim_space(text: Column) -> Column:
    """Strip Unicode white space on both ends (Spark's plain trim strips only U+0020)."""
    edges = F.left(text, F.lit(1)).isin(*WHITESPACE) | F.right(text, F.lit(1)).isin(*WHITESPACE)
    return F.when(edges, F.btrim(text, F.lit(WHITESPACE))).otherwise(text)


def rtrim_space(text: Column) -> Column:
    # A look at the last character is far cheaper than the trim, which most lines don't need.
    edge = F.right(text, F.lit(1)).isin(*WHITESPACE)
    return F.when(edge, F.rtrim(text, F.lit(WHITESPACE))).otherwise(text)


def after(text: Column, lead: Column) -> Column:
    """The part of ``text`` behind its prefix ``lead``."""
    return F.substring(text, F.length(lead) + 1, F.length(text))


def month_number(name: Column) -> Column:
    """1..12 for an English month abbreviation, else 0."""
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name).cast("int")
