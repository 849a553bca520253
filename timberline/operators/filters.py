"""Which entries pass: time range, severity, exclusion, search."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from timberline.functions import levels, patterns
from timberline.functions.fuzzy import all_of, any_of, split_terms, text_matches
from timberline.functions.timestamps import ntz_literal, parse_bound

# The quick ranges.
QUICK_RANGES = ("last_15_minutes", "last_hour", "today", "last_24_hours")

# The model has millisecond times, so a range closes on the last millisecond.
_LAST_MS = timedelta(milliseconds=1)


@dataclass(frozen=True)
class TimeRange:
    """Both ends inclusive, each optional."""

    start: datetime | None = None
    end: datetime | None = None

    def __post_init__(self):
        if self.start and self.end and self.start > self.end:
            raise ValueError(f"the time range starts after it ends: {self.start} > {self.end}")

    @classmethod
    def between(cls, start: str | datetime | None, end: str | datetime | None,
                local_zone: str = "UTC") -> TimeRange:
        """From ISO 8601 bounds; a date alone means its midnight."""
        return cls(parse_bound(start, local_zone), parse_bound(end, local_zone))

    @classmethod
    def days(cls, first: date | None, last: date | None) -> TimeRange:
        """Whole days."""
        return cls(
            first and datetime.combine(first, time.min),
            last and datetime.combine(last, time.min) + timedelta(days=1) - _LAST_MS,
        )

    @classmethod
    def minutes(cls, first: datetime, last: datetime) -> TimeRange:
        """From the start of the first minute to the end of the last."""
        cut = lambda moment: moment.replace(second=0, microsecond=0)
        return cls(cut(first), cut(last) + timedelta(minutes=1) - _LAST_MS)

    @classmethod
    def quick(cls, name: str, as_of: datetime) -> TimeRange:
        """A range relative to ``as_of``, which the caller fixes so that re-runs agree."""
        if name not in QUICK_RANGES:
            raise ValueError(f"unknown quick range '{name}', one of {', '.join(QUICK_RANGES)}")
        if name == "today":
            return cls.days(as_of.date(), as_of.date())
        back = dict(zip(QUICK_RANGES, (timedelta(minutes=15), timedelta(hours=1), None, timedelta(days=1))))
        return cls.minutes(as_of - back[name], as_of)

    def predicate(self, ts: Column) -> Column | None:
        bounds = []
        if self.start:
            bounds.append(ts >= ntz_literal(self.start))
        if self.end:
            # Times finer than a millisecond still belong to the millisecond they start in.
            bounds.append(ts < ntz_literal(self.end + _LAST_MS))
        return all_of(bounds) if bounds else None


def search_predicate(text: Column, search: str) -> Column:
    """A regular expression is searched for as it is; plain words tolerate typos."""
    if patterns.looks_like_regex(search):
        return text.rlike(patterns.to_java(search).text)
    return text_matches(text, search)


def exclude_predicate(text: Column, exclude: str) -> Column:
    """True for texts to drop: the expression matches, or any plain word occurs in any case."""
    if patterns.looks_like_regex(exclude):
        return text.rlike(patterns.to_java(exclude).text)
    lowered = F.lower(text)
    return any_of([lowered.contains(term.lower()) for term in split_terms(exclude)])


@dataclass(frozen=True)
class LogFilter:
    """What an entry must satisfy. Every part is optional; an empty text is no condition."""

    time_range: TimeRange | None = None
    min_level: str | None = None
    search: str = ""
    exclude: str = ""

    def __post_init__(self):
        if self.min_level and levels.ordinal(self.min_level) == levels.UNKNOWN \
                and self.min_level.strip().upper() != "UNKNOWN":
            raise ValueError(f"unknown level '{self.min_level}'")

    def check(self, spark: SparkSession) -> LogFilter:
        """ValueError if a pattern does not compile, before any row is read."""
        for text, what in ((self.search, "search"), (self.exclude, "exclude")):
            if text and patterns.looks_like_regex(text):
                patterns.compile_check(spark, text, what)
        return self

    def time_condition(self, is_valid: Column | str = "is_valid", ts: Column | str = "ts") -> Column:
        """The part that needs no more than the time of an entry."""
        in_range = self.time_range.predicate(_col(ts)) if self.time_range else None
        return _col(is_valid) if in_range is None else _col(is_valid) & in_range

    def other_conditions(self, text: Column, level_ord: Column | str = "level_ord") -> Column:
        """Severity, exclusion and search, cheap conditions first."""
        parts, level_ord = [], _col(level_ord)
        least = levels.ordinal(self.min_level) if self.min_level else levels.UNKNOWN
        if least != levels.UNKNOWN:
            parts.append((level_ord != levels.UNKNOWN) & (level_ord >= least))
        if self.exclude:
            parts.append(~exclude_predicate(text, self.exclude))
        if self.search:
            parts.append(search_predicate(text, self.search))
        return all_of(parts)

    def predicate(self, is_valid: Column | str = "is_valid", ts: Column | str = "ts",
                  level_ord: Column | str = "level_ord", raw_line: Column | str = "raw_line",
                  message: Column | str | None = "message") -> Column:
        """Everything an entry must satisfy, as one conjunction; never NULL.

        Only an entry without a raw line is searched by its message. Entries made from lines
        always have one: with ``message=None`` the message need not be computed.
        """
        text = _col(raw_line)
        if message is not None:
            text = F.coalesce(F.nullif(text, F.lit("")), _col(message))
        return F.coalesce(self.time_condition(is_valid, ts) & self.other_conditions(text, level_ord),
                          F.lit(False))


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column
