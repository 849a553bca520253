"""Lines to entries: ``DataFrame[value] -> DataFrame[ts, level, level_ord, message, ...]``.

A strategy is a chain of projections. Each regular expression runs once per line, on
text that earlier steps already cut, and all of it stays inside generated code. A line
no strategy accepts keeps its row with ``is_valid = false``; its other outputs are NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from timberline.functions import levels, patterns
from timberline.functions.planning import computed_once, evaluated_once
from timberline.functions.text import (
    MONTH_PATTERN,
    WHITESPACE,
    after,
    month_number,
    rtrim_space,
    trim_space,
)
from timberline.functions.timestamps import DEFAULT_FORMAT, TimeFormat, iso_to_ts, us_to_iso
from timberline.operators.filters import LogFilter

HEURISTIC = "heuristic"
SYSLOG = "syslog"
CUSTOM = "custom"

# How far into a line a timestamp, and into the rest a bracket, may lie.
STAMP_WINDOW = 40
BRACKET_WINDOW = 100

# The line pattern offered as the named preset.
BRACKET_PRESET = (
    r"^\[(?<timestamp>\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\]\s+(?<level>\w+):\s*(?<message>.*)$"
)

# A noncharacter that Unicode keeps for use inside a program.
_MARK = "\ufdd1"

_DAY = r"\d{4}-\d{2}-\d{2}"
_CLOCK = r"\d{2}:\d{2}:\d{2}"

# Everything up to the end of the timestamp. The kinds are tried in order over the whole
# window, so a later one is used only if no earlier one occurs anywhere in it.
_STAMP = (
    rf"(?s)^.*?{_DAY}[ T]{_CLOCK}[.,]\d{{1,6}}"
    rf"|^.*?{_DAY}[ T]{_CLOCK}"
    rf"|^.*?\d{{2}}/\d{{2}}/\d{{4}} {_CLOCK}"
)
# Everything up to the end of the first level word; the class is a cheap test ahead of the words.
_LEVEL = (
    r"(?s)^.*?(?<![A-Za-z0-9_])(?=[tdiwecfTDIWECF])(?i:"
    + "|".join(sorted(levels.SPELLINGS, key=len, reverse=True))
    + r")(?![A-Za-z0-9_])"
)
# Everything ahead of the message: up to the last near bracket, then up to the first
# separator, then what is stripped from the front.
_LEAD = (
    rf"(?s)^(?:.{{0,{BRACKET_WINDOW - 1}}}\])?(?:.*?(?:\s-\s|:))?[\]\-{WHITESPACE}]*"
)
# Everything ahead of a syslog message.
_SYSLOG = (
    rf"(?d)^(?:{MONTH_PATTERN})\s+\d{{1,2}}\s+{_CLOCK}\s+\S+\s+[^:\[]+(?:\[\d+\])?:\s*"
)
_SYSLOG_DATE = rf"^\w+\s+(\d{{1,2}})\s+({_CLOCK})"


Steps = Callable[[DataFrame, Column, str], DataFrame]


@dataclass(frozen=True)
class Strategy:
    """One way to structure a line, in three stages.

    Each stage maps ``(df, text, name)`` to ``df`` with one more column: ``<name>_ts``, then
    ``<name>_level_ord``, then ``<name>_message``; later stages may use what earlier ones left.
    ``text`` is NULL on lines that belong to another strategy. A NULL time means the line is
    not accepted.
    """

    name: str
    label: str
    time: Steps
    level: Steps
    message: Steps
    # The time stage used to score a sample, where it differs.
    score: Steps | None = None

    @classmethod
    def from_columns(cls, name: str, label: str,
                     build: Callable[[Column], tuple[Column, Column, Column]]) -> Strategy:
        """A strategy from a function ``text -> (time, level text, message)``, built once per line."""
        text_or_empty = lambda column: F.coalesce(column, F.lit(""))

        def time(df: DataFrame, text: Column, p: str) -> DataFrame:
            ts, level, message = build(text)
            own = F.struct(ts.alias("ts"), level.alias("level"), message.alias("message"))
            df = _with(df, p, own=computed_once(own))
            return _with(df, p, ts=F.col(f"{p}_own.ts"))

        return cls(
            name, label, time,
            lambda df, text, p: _with(df, p, level_ord=levels.level_ord(text_or_empty(F.col(f"{p}_own.level")))),
            lambda df, text, p: _with(df, p, message=text_or_empty(F.col(f"{p}_own.message"))),
        )


def _with(df: DataFrame, prefix: str, **columns: Column) -> DataFrame:
    return df.withColumns({f"{prefix}_{name}": column for name, column in columns.items()})


def _stamp_time(lead: Column, lenient: bool) -> Column:
    """Time of a text that ends with one of the three timestamp kinds."""
    plain = F.substring(lead, -3, 1) == ":"
    us = plain & (F.substring(lead, -17, 1) == "/")
    if lenient:
        iso = F.translate(F.regexp_extract(lead, rf"{_DAY}[ T]{_CLOCK}(?:[.,]\d{{1,6}})?$", 0), ",", ".")
        return iso_to_ts(F.when(us, us_to_iso(F.right(lead, F.lit(19)))).otherwise(iso))
    milli = ~plain & F.substring(lead, -4, 1).isin(".", ",") & (F.substring(lead, -13, 1) == " ")
    second = plain & (F.substring(lead, -9, 1) == " ")
    return iso_to_ts(
        F.when(us, us_to_iso(F.right(lead, F.lit(19))))
        .when(second, F.right(lead, F.lit(19)))
        .when(milli, F.translate(F.right(lead, F.lit(23)), ",", "."))
    )


def heuristic(lenient: bool = False) -> Strategy:
    """Timestamp near the start, then a level word, then the message behind brackets and separator."""

    def time(df: DataFrame, text: Column, p: str) -> DataFrame:
        stamp = F.regexp_extract(F.left(text, F.lit(STAMP_WINDOW)), _STAMP, 0)
        df = _with(df, p, stamp=F.nullif(stamp, F.lit("")))
        return _with(df, p, ts=_stamp_time(F.col(f"{p}_stamp"), lenient))

    def level(df: DataFrame, text: Column, p: str) -> DataFrame:
        df = _with(df, p, tail=after(text, F.col(f"{p}_stamp")))
        df = _with(df, p, lead=F.regexp_extract(f"{p}_tail", _LEVEL, 0))
        return _with(df, p, level_ord=levels.level_ord_at_end(F.col(f"{p}_lead")))

    def message(df: DataFrame, text: Column, p: str) -> DataFrame:
        rest, body = F.col(f"{p}_rest"), F.col(f"{p}_body")
        df = _with(df, p, rest=after(F.col(f"{p}_tail"), F.col(f"{p}_lead")))
        df = _with(df, p, cut=after(rest, F.regexp_extract(rest, _LEAD, 0)))
        df = _with(df, p, body=rtrim_space(F.col(f"{p}_cut")))
        return _with(df, p, message=F.when(body == "", trim_space(rest)).otherwise(body))

    # Fixed value: the label.
    return Strategy(HEURISTIC, "Genel (zaman damgasi + seviye)", time, level, message)


def syslog_head(text: Column) -> Column:
    """What precedes the message of a syslog line, empty if the line is not one."""
    return F.regexp_extract(text, _SYSLOG, 0)


def syslog_month(text: Column) -> Column:
    """Month 1..12 of a syslog line, NULL for any other line; the date may be impossible."""
    return F.when(text.rlike(_SYSLOG), month_number(F.left(text, F.lit(3))))


def syslog(year: Column) -> Strategy:
    """Classic syslog; the text has no year, so it comes in as a column. Level is UNKNOWN."""

    def time_in(year: Column) -> Steps:
        def time(df: DataFrame, text: Column, p: str) -> DataFrame:
            head = F.col(f"{p}_head")
            df = _with(df, p, head=F.nullif(syslog_head(text), F.lit("")))
            # No time format has years of five digits: such a line is not accepted.
            four = F.when(year.between(1, 9999), F.lpad(year.cast("string"), 4, "0"))
            return _with(df, p, ts=iso_to_ts(F.concat(
                four, F.lit("-"),
                month_number(F.left(head, F.lit(3))).cast("string"), F.lit("-"),
                F.regexp_extract(head, _SYSLOG_DATE, 1), F.lit(" "),
                F.regexp_extract(head, _SYSLOG_DATE, 2),
            )))
        return time

    return Strategy(
        SYSLOG, "Syslog", time_in(year),
        lambda df, text, p: _with(df, p, level_ord=F.lit(levels.UNKNOWN)),
        lambda df, text, p: _with(df, p, message=trim_space(after(text, F.col(f"{p}_head")))),
        # A sample is scored with a leap year, so 29 February counts whatever the year turns out to be.
        score=time_in(F.lit(2000)),
    )


def custom(spark: SparkSession, pattern: str, time_format: str = DEFAULT_FORMAT) -> Strategy:
    """A user pattern with the named groups ``timestamp``, ``level`` and ``message``.

    The pattern is searched, not anchored. It is checked here, before any row is read. It runs
    once per line: the groups of its first match are laid out behind marks, and the line is cut there.
    """
    java = patterns.compile_check(spark, pattern, "line pattern")
    for group in ("timestamp", "level", "message"):
        if group not in java.groups:
            raise ValueError(f"line pattern has no group named '{group}' "
                             "(timestamp, level and message are required)")
    layout = TimeFormat.of(time_format)
    # The shortest lead makes the match the first one; a line break ends a comment of the pattern.
    whole = f"^(?s:.*?)(?:{java.text}{chr(10) if java.comments else ''})(?s:.*)$"
    laid_out = "".join(f"{_MARK}${java.groups[g]}" for g in ("timestamp", "level", "message"))
    part = lambda p, n: F.get(F.col(f"{p}_parts"), F.lit(n))

    def time(df: DataFrame, text: Column, p: str) -> DataFrame:
        # Without a match the text stays as it is, and has no mark at its start.
        df = _with(df, p, parts=computed_once(F.split(F.regexp_replace(text, whole, laid_out), _MARK, 4)))
        df = _with(df, p, stamp=F.when((part(p, 0) == "") & part(p, 3).isNotNull(), part(p, 1)))
        return _with(df, p, ts=layout.parse(F.col(f"{p}_stamp")))

    return Strategy(
        CUSTOM, "Ozel", time,
        lambda df, text, p: _with(df, p, level_ord=levels.level_ord(F.coalesce(part(p, 2), F.lit("")))),
        lambda df, text, p: _with(df, p, message=F.coalesce(part(p, 3), F.lit(""))),
    )


def structure(lines: DataFrame, strategies: Sequence[Strategy], format_column: str = "format",
              keep: LogFilter | None = None, count: Observation | None = None) -> DataFrame:
    """Entries of ``lines``; with several strategies each line uses the one its format names.

    With ``keep`` only entries that pass it are returned, and each condition is applied as
    soon as its column exists: lines outside the time range are not searched for a level, and
    messages are cut only from entries that pass. ``count`` observes ``total`` and ``parsed``,
    the lines before any condition, whenever the result is written.
    """
    value = F.col("value")
    single = len(strategies) == 1
    columns = lines.columns

    def stage(df: DataFrame, name: str, output: str) -> tuple[DataFrame, Column]:
        chain = None
        for s in strategies:
            mine = F.col(format_column) == s.name
            df = getattr(s, name)(df, value if single else F.when(mine, value), s.name)
            found = F.col(f"{s.name}_{output}")
            if single:
                return df, found
            chain = F.when(mine, found) if chain is None else chain.when(mine, found)
        return df, chain

    df, ts = stage(lines, "time", "ts")
    df = df.withColumn("ts", ts)
    df = df.withColumn("is_valid", evaluated_once(F.col("ts").isNotNull()))
    if count is not None:
        df = df.observe(count, F.count("*").alias("total"), F.count_if("is_valid").alias("parsed"))
    if keep is not None:
        df = df.filter(keep.time_condition())
    df, level_ord = stage(df, "level", "level_ord")
    df = df.withColumn("level_ord", level_ord)
    df = df.withColumn("level_ord", F.when(evaluated_once(F.col("is_valid")), F.col("level_ord")))
    if keep is not None:
        df = df.filter(keep.other_conditions(text=value))
    df, message = stage(df, "message", "message")
    df = df.withColumns({
        "level": levels.level_name(F.col("level_ord")),
        "message": F.when(F.col("is_valid"), message),
        "raw_line": value,
    })
    if single:
        df = df.withColumn(format_column, F.lit(strategies[0].name))
    own = [format_column, "ts", "is_valid", "level_ord", "level", "message", "raw_line"]
    return df.select(*[c for c in columns if c not in own], *own)


def accepted(lines: DataFrame, strategy: Strategy, flag: str) -> DataFrame:
    """``lines`` with a boolean column telling whether the strategy accepts the line."""
    df = (strategy.score or strategy.time)(lines, F.col("value"), strategy.name)
    return df.withColumn(flag, F.col(f"{strategy.name}_ts").isNotNull()).select(*lines.columns, flag)
