"""Typo-tolerant word search with built-in expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def allowed_typos(term: str) -> int:
    """Edits accepted for a term, by its length."""
    # Below 3 characters none, up to 5 one, beyond that two.
    if len(term) < 3:
        return 0
    return 1 if len(term) <= 5 else 2


def split_terms(text: str) -> list[str]:
    return [t for t in re.split(r"[ \t\n\x0b\f\r]+", text) if t]


def pieces(term: str) -> list[str]:
    """Parts of a term of which at least one stands unchanged in every word within its typos.

    k edits can touch at most k of k + 1 parts, so this is a necessary condition that costs
    only a substring test.
    """
    count = allowed_typos(term) + 1
    bounds = [len(term) * i // count for i in range(count + 1)]
    return [term[a:b] for a, b in zip(bounds, bounds[1:])]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def within_typos(word: Column, term: str) -> Column:
    """Whether a lower-case word is close enough to a lower-case term."""
    typos = allowed_typos(term)
    near = F.abs(F.length(word) - len(term)) <= typos
    return near & (F.levenshtein(word, F.lit(term), typos) >= 0)


def word_matches(word: Column, term: str) -> Column:
    """Whether a lower-case word contains the term or is close to it."""
    return word.contains(term) | within_typos(word, term)


def text_matches(text: Column, search: str) -> Column:
    """Whether, for every term of ``search``, some word of the text matches it.

    Words are runs of ASCII letters, digits and ``_``. Most texts are settled by substring
    tests on the pieces of the terms. From texts that pass them only the words that hold a
    piece are taken out and measured.
    """
    terms = [t.lower() for t in split_terms(search)]
    lowered = F.lower(text)
    candidates, exact = [], []
    for term in terms:
        # A word holds only word characters, so other pieces can never stand in one.
        usable = [p for p in pieces(term) if re.fullmatch(r"[a-z0-9_]+", p)]
        if not usable:
            return F.lit(False)
        candidates.append(any_of([lowered.contains(p) for p in usable]))
        exact.append(_some_word(text, term, usable))
    return all_of(candidates + exact)


def _some_word(text: Column, term: str, held: list[str]) -> Column:
    word = "[A-Za-z0-9_]"
    pattern = f"(?i)(?<!{word}){word}*(?:{'|'.join(held)}){word}*"
    words = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.exists(words, lambda found: word_matches(F.lower(found), term))
