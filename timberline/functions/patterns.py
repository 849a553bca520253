"""User regular expressions: PCRE spelling in, java.util.regex spelling out.

Search, exclude and custom line patterns are written for PCRE without Unicode
properties. Java differs in a few places, and silently: ``.`` stops at more line
ends, ``\\b`` looks at Unicode letters, ``[`` and ``&&`` are operators inside a
class, group names are narrower. ``to_java`` rewrites exactly those places.
"""

from __future__ import annotations

import re
from re import _parser
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Characters whose presence makes a search text a regular expression.
REGEX_CHARS = frozenset(".^$*+?()[]{}|\\")

_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_NOT_BOUNDARY = f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"

# Bracket class names and their Java property names.
_POSIX = {
    "alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower",
    "punct": "Punct", "graph": "Graph", "print": "Print", "blank": "Blank", "cntrl": "Cntrl",
    "xdigit": "XDigit", "space": "Space", "ascii": "ASCII",
}
# Flags that mean the same on both sides.
_SAME_FLAGS = frozenset("imsx-")

_TOKEN = re.compile(
    r"""(?P<quoted>\\Q.*?(?:\\E|$))
      | (?P<backref>\\k[<{'](?P<ref>\w+)[>}'] | \(\?P=(?P<pyref>\w+)\))
      | (?P<escape>\\.)
      | (?P<posix>\[:(?P<neg>\^?)(?P<cls>[a-z]+):\])
      | (?P<name>\(\?(?:P?<|')(?P<group>[A-Za-z_]\w*)[>'])
      | (?P<flags>\(\?(?P<letters>[a-zA-Z^-]+)[:)])
      | (?P<open>\()
      | (?P<setopen>\[\^?\]?)
      | (?P<setclose>\])
      | (?P<other>.)""",
    re.X | re.S,
)


@dataclass(frozen=True)
class JavaPattern:
    """A translated pattern and the index of each of its named groups."""

    text: str
    groups: dict[str, int]
    # Whether blanks may be ignored in it and '#' may start a comment.
    comments: bool = False


def looks_like_regex(text: str) -> bool:
    return any(ch in REGEX_CHARS for ch in text)


def to_java(pattern: str) -> JavaPattern:
    out: list[str] = ["(?d)"]
    groups: dict[str, int] = {}
    count = 0
    in_set = comments = False
    for match in _TOKEN.finditer(pattern):
        token = match.group(0)
        if in_set:
            out.append(_inside_set(match))
            in_set = not (match["setclose"] or match["setopen"] and token.endswith("]"))
            continue
        if match["name"]:
            count += 1
            groups[match["group"]] = count
            out.append(f"(?<g{count}>")
        elif match["backref"]:
            name = match["ref"] or match["pyref"]
            if name not in groups:
                raise ValueError(f"pattern refers to an unknown group '{name}': {pattern}")
            out.append(f"\\k<g{groups[name]}>")
        elif match["flags"]:
            letters = match["letters"]
            # Others differ between the dialects, as U, J and n do, or are known to one of them only.
            if not _SAME_FLAGS.issuperset(letters) or "xx" in letters:
                raise ValueError(f"the flags '{letters}' are not supported: {pattern}")
            comments |= "x" in letters.partition("-")[0]
            out.append(token)
        elif match["open"]:
            if not pattern.startswith(("?", "*"), match.end()):
                count += 1
            out.append(token)
        elif match["setopen"]:
            in_set = True
            out.append(token.replace("]", "\\]"))
        elif token == "\\b":
            out.append(_BOUNDARY)
        elif token == "\\B":
            out.append(_NOT_BOUNDARY)
        else:
            out.append(token)
    return JavaPattern("".join(out), groups, comments)


def _inside_set(match: re.Match) -> str:
    token = match.group(0)
    if match["posix"]:
        if match["cls"] == "word":
            return "\\W" if match["neg"] else "\\w"
        if match["cls"] not in _POSIX:
            raise ValueError(f"unknown character class '{token}'")
        return f"\\{'P' if match['neg'] else 'p'}{{{_POSIX[match['cls']]}}}"
    if match["escape"] or match["quoted"]:
        return "\\x08" if token == "\\b" else token
    if match["setopen"]:
        # '[', '[^' or '[]' met inside a class: literal characters, a ']' still closes it.
        return token.replace("[", "\\[").replace("^", "\\^")
    if match["setclose"]:
        return token
    # Java would ignore blanks and comments inside a class as well.
    if token.isspace() or token == "#":
        return f"\\{token}"
    return token.replace("[", "\\[").replace("&", "\\&")


def matches_empty(spark: SparkSession, java_pattern: str) -> bool:
    return spark.range(1).select(F.lit("").rlike(java_pattern)).first()[0]


def may_match_empty(spark: SparkSession, pattern: str, java_pattern: str) -> bool:
    """Whether a match can be empty, be it only next to certain characters.

    The least length of a match is taken from Python's parser, which knows most of the dialect.
    """
    if matches_empty(spark, java_pattern):
        return True
    try:
        return _parser.parse(python_spelling(pattern), re.ASCII).getwidth()[0] == 0
    except re.error:
        return False


def python_spelling(pattern: str) -> str:
    return re.sub(r"\(\?<([A-Za-z_])", r"(?P<\1", pattern)


def compile_check(spark: SparkSession, pattern: str, what: str) -> JavaPattern:
    """Translate and compile a pattern before any row is read; ValueError if it is invalid."""
    java = to_java(pattern)
    try:
        matches_empty(spark, java.text)
    except PySparkException as error:
        raise ValueError(f"{what} is not a valid regular expression: {pattern}") from error
    return java
