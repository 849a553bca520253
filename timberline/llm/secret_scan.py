"""Secrets in texts: fixed patterns, and values in credential context that are dear to guess.

The value behind a credential word is cut into words, dates, repeats, keyboard walks, runs and
brute-force pieces so that the product of the guesses each piece takes is least (dynamic programming
over positions). A value that takes many guesses is a secret; a placeholder such as ``changeme`` is not.

Words are ranked by a short list of what people choose and, where the file of a tokenizer with word ends is named,
by its vocabulary: merges come in the order of how common they were. A bare value after "is" or a colon
that is one or two of its words, as in "the password is required", is prose. Quoted values may hold
blanks where they are assigned (``=`` or a quoted key); quotations after a plain colon are prose too.
Null and empty texts have no spans. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import unused, with_text_columns

SPAN_TYPE = "array<struct<kind:string,start:int,end:int,log10_guesses:double>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                   ("log10_guesses", pa.float64())]))
# Order of kinds among spans with the same start; the last is the guess-cost method's own.
KINDS = ("assign", "access", "hex", "guess")
# A value in looser context is reported from this many decimal digits of guesses on.
LEAST_LOG10_GUESSES = 8.0

# The base patterns, with the least lengths applied after matching.
_ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
# Looser context: more words, prefixed (DB_, client-, user) and with suffixes, "is" as a link, quoted values with
# any characters but spaces and quotes. "compass", "bypass", "surpass" and "trespass" are no credential words.
_CONTEXT = re.compile(
    r"(?ai)(?:pass(?:word|wd|phrase|code)|(?<!com)(?<!by)(?<!sur)(?<!tres)pass|pwd|secret|token|api[_-]?key|"
    r"private[_-]?key|access[_-]?key|credential)s?"
    r"(?:[_-]?(?:access|key|base|value|text|string|hash|prod|production|dev|test|staging|live|main|primary|secondary|old|new|current|\d{1,3})){0,3}"
    r"[\"']?(?:\x20*(?::=|=>|[:=])\x20*|(\x20+is\x20+))"
    r"(?:\"([^\"\r\n]{6,})\"|'([^'\r\n]{6,})'|([^\s\"',;]{6,}))")
# What stands before a value in quotes that may hold blanks, and a value that is written like words of a sentence.
_ASSIGNED = re.compile(r"=|[\"']\x20*:")
_WORDLIKE = re.compile(r"(?a)([A-Za-z]+)(?:[-/]([A-Za-z]+))?[.:!?)\]]*")
_CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "apikey", "api_key", "api-key", "privatekey", "private_key", "private-key",
                  "accesskey", "access_key", "access-key", "credential")
# A value is searched for further contexts from its start, a longer one from so many characters before its end:
# contexts before those end within the value.
_RESCANNED = 200

# Words people choose for secrets, commonest first; the place is the number of guesses.
COMMON_WORDS = (
    "password passwd pass secret admin test user example changeme default root guest login welcome letmein "
    "master dragon monkey shadow sunshine princess football baseball superman batman love hello qwerty iloveyou "
    "trustno abc key token value string your my the placeholder dummy sample foobar foo bar baz null none true "
    "false todo redacted hidden insert here enter demo temp local dev prod server database api access private "
    "public internal service client company secure summer winter spring autumn january february march april june "
    "july august september october november december monday friday michael daniel jordan charlie thomas"
).split()
# Shorter words of a vocabulary are pieces of anything.
_LEAST_LETTERS = 3
_LEET = str.maketrans("4301$5@7!", "aeolssati")
_KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {key: (row, col + (0, 1.5, 1.75, 2.25)[row]) for row, keys in enumerate(_KEY_ROWS) for col, key in enumerate(keys)}
_DATE = re.compile(r"(?a)(?:(?:19|20)\d\d[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01])"
                   r"|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d)")
_LONGEST_DATE = 10
_LONGEST_UNIT = 8
# Longer values are not remembered between texts.
_CACHED_LENGTH = 200


class Words:
    """Words by the number of guesses they take: the fixed ones, then those of a tokenizer's vocabulary in its order."""

    def __init__(self, vocabulary: str | None):
        ranked = list(COMMON_WORDS)
        if vocabulary:
            with open(vocabulary, encoding="utf-8") as file:
                pieces = json.load(file)["model"]["vocab"]
            whole = (p[:-4] for p in sorted(pieces, key=pieces.get) if p.endswith("</w>"))
            ranked += [w for w in whole if len(w) >= _LEAST_LETTERS and w.isascii() and w.isalpha() and w.islower()]
        self.rank: dict[str, int] = {}
        for word in ranked:
            self.rank.setdefault(word, len(self.rank) + 1)
        self.longest = max(map(len, self.rank))
        self.starts = {w[:_LEAST_LETTERS] for w in self.rank}

    def lengths(self, text: str, at: int) -> range:
        """Lengths that a word of ``text`` from ``at`` on may have."""
        if text[at:at + 2] in self.starts or text[at:at + 3] in self.starts:
            return range(2, min(len(text) - at, self.longest) + 1)
        return range(0)


@lru_cache(maxsize=4)
def words_of(vocabulary: str | None) -> Words:
    return Words(vocabulary)


def _alphabet(text: str) -> int:
    """Size of the character set a brute-force search of this piece has to cover."""
    return max(10 * any(c.isdigit() for c in text) + 26 * any(c.islower() for c in text)
               + 26 * any(c.isupper() for c in text) + 33 * any(not c.isalnum() for c in text)
               + 100 * any(ord(c) > 126 for c in text), 10)


def _next_to(a: str, b: str) -> bool:
    x, y = _PLACE.get(a), _PLACE.get(b)
    return bool(x and y and a != b and abs(x[0] - y[0]) <= 1 and abs(x[1] - y[1]) <= 1)


def _runs(value: str, follows) -> list[int]:
    """For each position the end of the longest run that starts there."""
    ends = [0] * len(value)
    for i in range(len(value) - 1, -1, -1):
        ends[i] = ends[i + 1] if i + 1 < len(value) and follows(value, i) else i + 1
    return ends


def guess_cost(value: str, vocabulary: str | None = None) -> float:
    """log10 of the guesses of the cheapest segmentation; linear in the length of the value."""
    return _known_cost(value, vocabulary) if len(value) <= _CACHED_LENGTH else _least_cost(value, vocabulary)


@lru_cache(maxsize=50_000)
def _known_cost(value: str, vocabulary: str | None) -> float:
    return _least_cost(value, vocabulary)


def _least_cost(value: str, vocabulary: str | None) -> float:
    if not value:
        return 0.0
    words = words_of(vocabulary)
    low = value.lower()
    plain = low.translate(_LEET)
    n = len(value)
    brute = math.log10(_alphabet(value))
    walk_end = _runs(low, lambda v, i: _next_to(v[i], v[i + 1]))
    up_end = _runs(value, lambda v, i: ord(v[i + 1]) - ord(v[i]) == 1)
    down_end = _runs(value, lambda v, i: ord(v[i]) - ord(v[i + 1]) == 1)
    repeat_end = {u: _runs(low, lambda v, i, u=u: i + u < n and v[i] == v[i + u]) for u in range(1, min(_LONGEST_UNIT, n // 2) + 1)}
    best = [math.inf] * (n + 1)
    best[0] = 0.0

    def offer(end: int, cost: float) -> None:
        if cost < best[end]:
            best[end] = cost

    for i in range(n):
        here = best[i]
        offer(i + 1, here + brute)
        for text, leet in ((low, 0.0), (plain, 0.6)):
            for end in (i + length for length in words.lengths(text, i)):
                if rank := words.rank.get(text[i:end]):
                    case = 0.0 if value[i:end] == low[i:end] else 0.3 if value[i:end].istitle() or value[i:end].isupper() else 1.0
                    offer(end, here + math.log10(rank + 1) + leet + case)
        if value[i].isdigit():
            for end in range(i + 4, min(n, i + _LONGEST_DATE) + 1):
                if _DATE.fullmatch(value, i, end):
                    offer(end, here + (2.2 if end - i == 4 else 4.6))
        # A run counts from its start only: every part of it costs as much as the whole.
        if (end := walk_end[i]) - i >= 3:
            offer(end, here + math.log10(47 * 6.0) + 0.4 * (end - i))
        for ends in (up_end, down_end):
            if (end := ends[i]) - i >= 3:
                offer(end, here + math.log10(26.0 * (end - i)))
        for unit, ends in repeat_end.items():
            times = 1 + (ends[i] - i - 1) // unit if ends[i] > i + 1 else 1
            if times >= 2 and unit * times >= 3:
                offer(i + unit * times, here + unit * brute + math.log10(times))
    return best[n]


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans that cover the same places, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _is_prose(value: str, before: str, quoted: bool, words: Words) -> bool:
    """Whether a value behind ``before``, credential word and link, is a part of a sentence."""
    if quoted:
        return any(c.isspace() for c in value) and not _ASSIGNED.search(before)
    # Values are assigned by "=", or by a colon without a blank.
    return before[-1] == " " and "=" not in before and bool(m := _WORDLIKE.fullmatch(value)) and all(
        w.lower() in words.rank for w in m.groups() if w)


def find_spans(text: str, vocabulary: str | None = None) -> list[tuple[str, int, int, float | None]]:
    """All spans by start, then kind; base kinds first, the method's own where base spans do not cover the value.

    A value that a base span covers in part is a secret by the base pattern: its span is added whatever it costs.
    """
    low = text.lower()
    spans = []
    if any(w in low for w in _ASSIGN_WORDS):
        spans += [("assign", m.start(), m.end(), guess_cost(m[2], vocabulary)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end(), None) for m in _ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end(), None) for m in _HEX.finditer(text)]
    if any(w in low for w in _CONTEXT_WORDS):
        taken = _united([(s, e) for _, s, e, _ in spans])
        at, reported = 0, 0
        while m := _CONTEXT.search(text, at):
            left = text[m.start() - 1:m.start()]
            if m[1] and left.isascii() and left.isalnum():
                at = m.start() + 1  # "is" links whole words only
                continue
            start, end = m.span(m.lastindex)
            quoted = m.lastindex in (2, 3)
            if _is_prose(m[m.lastindex], text[m.start():start - quoted], quoted, words_of(vocabulary)):
                at = start
                continue
            at = max(start, end - _RESCANNED)
            before = bisect_right(taken, (end - 1, end)) - 1  # the last base span that starts before the end
            met = before >= 0 and taken[before][1] > start
            if end <= reported or met and taken[before][0] <= start and taken[before][1] >= end:
                continue
            cost = guess_cost(m[m.lastindex], vocabulary)
            if met or cost >= LEAST_LOG10_GUESSES:
                spans.append(("guess", start, end, cost))
                reported = end
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


def scan(df: DataFrame, text: str = "text", spans: str = "spans", vocabulary: str | None = None) -> DataFrame:
    """``df`` with an array column of the secrets of each whole text; ``vocabulary`` is a file that every executor has."""

    def make():
        def step(texts):
            found = [[{"kind": k, "start": s, "end": e, "log10_guesses": c} for k, s, e, c in find_spans(t, vocabulary)] for t in texts]
            return [pa.array(found, _ARROW_SPANS)]

        return step

    return with_text_columns(df, text, [(spans, SPAN_TYPE)], make)


def redacted(text: str, mark: str, vocabulary: str | None = None) -> str:
    """The text with every secret replaced by ``mark``; overlapping spans count as one."""
    out, at = [], 0
    for _, start, end, _ in find_spans(text, vocabulary):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]", vocabulary: str | None = None) -> DataFrame:
    """``df`` with secrets replaced; rows are kept, a null text stays null."""
    def make():
        return lambda texts: [pa.array([redacted(t, mark, vocabulary) for t in texts], pa.string())]

    names, new = df.columns, unused(df, "_redacted")
    done = with_text_columns(df, text, [(new, "string")], make)
    clean = F.when(F.col(f"`{text}`").isNotNull(), F.col(new)).alias(text)
    return done.select(*[clean if c == text else F.col(f"`{c}`") for c in names])
