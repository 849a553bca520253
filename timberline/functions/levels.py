"""Severity levels: names, order and recognition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions.text import trim_space

# Canonical names in ascending severity; the position is the ordinal.
LEVELS = ("TRACE", "DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL", "UNKNOWN")
UNKNOWN = LEVELS.index("UNKNOWN")

# Every accepted spelling of a level.
SPELLINGS = {
    "TRACE": "TRACE",
    "DEBUG": "DEBUG",
    "INFO": "INFO",
    "WARN": "WARNING",
    "WARNING": "WARNING",
    "ERROR": "ERROR",
    "CRITICAL": "CRITICAL",
    "FATAL": "CRITICAL",
}


def ordinal(name: str) -> int:
    """Ordinal of a level given by any accepted spelling, on the driver."""
    key = SPELLINGS.get(name.strip().upper(), "UNKNOWN")
    return LEVELS.index(key)


def _spelled(test) -> Column:
    chain = None
    for spelling, level in SPELLINGS.items():
        value = F.lit(LEVELS.index(level))
        chain = F.when(test(spelling), value) if chain is None else chain.when(test(spelling), value)
    return chain.otherwise(F.lit(UNKNOWN))


def level_ord(text: Column) -> Column:
    """Ordinal of a level text; anything not recognised is UNKNOWN."""
    word = F.upper(trim_space(text))
    return _spelled(lambda spelling: word == spelling)


def level_ord_at_end(text: Column) -> Column:
    """Ordinal of the level word that ``text`` ends with, UNKNOWN if it ends with none."""
    tail = F.upper(F.right(text, F.lit(max(map(len, SPELLINGS)))))
    return _spelled(tail.endswith)


def level_name(ord_: Column) -> Column:
    """Canonical name of an ordinal."""
    chain = F
    for number, name in enumerate(LEVELS):
        chain = chain.when(ord_ == number, F.lit(name))
    return chain
