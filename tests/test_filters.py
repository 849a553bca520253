import random
import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from timberline import LogFilter, TimeRange
from timberline.functions import patterns
from timberline.functions.fuzzy import text_matches

A = ("04:15 kiln=3 heats", "heats")


def passes(spark, row, flt, ts="2031-05-04 03:02:01.500", level=6, valid=True):
    df = spark.createDataFrame([(row[0], row[1], ts, level, valid)],
                               "raw_line string, message string, t string, level_ord int, is_valid boolean")
    return df.select(flt.check(spark).predicate(ts=F.col("t").cast("timestamp_ntz"))).first()[0]


def distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, line[0] = line[0], i
        for j, y in enumerate(b, 1):
            diagonal, line[j] = line[j], min(diagonal + (x != y), line[j] + 1, line[j - 1] + 1)
    return line[-1]


SYLLABLES = ["ka", "lo", "mi", "RU", "te", "so", "Ne", "ü", "7", "_"]
SIGNS = [r"\d", r"^ka", "lo.*te", "[Rx]U", "(mi|so)$", "te+"]


def close(text, term):
    """Whether a term of a search is part of a word of the text, or a few typos away from one."""
    term = term.lower()
    limit = 0 if len(term) < 3 else 1 if len(term) <= 5 else 2
    return any(term in w or abs(len(w) - len(term)) <= limit and distance(w, term) <= limit
               for w in (x.lower() for x in re.split(r"\W+", text, flags=re.A) if x))


def sequential_predicate(raw, message, search, exclude):
    """Exclusion beats the search; either looks at the raw line where there is one, and takes terms or a pattern."""
    text = raw or message
    if exclude.strip():
        if exclude in SIGNS:
            if re.search(exclude, text):
                return False
        elif any(term.lower() in text.lower() for term in exclude.split()):
            return False
    if not search.strip():
        return True
    return bool(re.search(search, text)) if search in SIGNS else all(close(text, term) for term in search.split())


def test_search_and_exclusion_equal_a_sequential_version(spark):
    rng = random.Random(23)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 5)))
    rows = []
    for n in range(300):
        words = [word() for _ in range(rng.randint(0, 7))]
        message = " ".join(words)
        rows.append((n, rng.choice(["", f"{word()}~{message}={word()}"]), message))
    df = spark.createDataFrame(rows, "n int, raw_line string, message string").withColumns(
        {"ts": F.lit(None).cast("timestamp_ntz"), "level_ord": F.lit(6), "is_valid": F.lit(True)})

    def typo(text):
        at = rng.randrange(len(text))
        return text[:at] + rng.choice(["", "x", "xy"]) + text[at + rng.randint(0, 1):]

    def wanted():
        kind = rng.random()
        if kind < 0.2:
            return rng.choice(["", "  "])
        if kind < 0.35:
            return rng.choice(SIGNS)
        return " ".join(typo(word()) if rng.random() < 0.5 else word().swapcase() for _ in range(rng.randint(1, 2))) or "ka"

    seen = set()
    for _ in range(40):
        search, exclude = wanted(), wanted() if rng.random() < 0.5 else ""
        got = {r.n for r in df.filter(LogFilter(search=search, exclude=exclude).check(spark).predicate()).select("n").collect()}
        want = {n for n, raw, message in rows if sequential_predicate(raw, message, search, exclude)}
        assert got == want, (search, exclude, sorted(got ^ want)[:3])
        seen.add(0 < len(want) < len(rows))
    assert seen == {True, False}


def test_fuzzy_search_equals_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcAé_1/") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 6))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    for term in ["a", "ab", "abc", "aabca", "abcabc", "caba1_b", "ab/cab", "aébca"]:
        want = {n for n, t in enumerate(texts) if close(t, term)}
        got = {r.n for r in df.filter(text_matches(F.col("t"), term)).collect()}
        assert got == want, term


RANGES = [
    # Days take in their last millisecond, on both sides.
    (TimeRange.days(date(2019, 2, 27), date(2019, 3, 1)), [
        ("2019-02-26 23:59:59.999", False), ("2019-02-27 00:00:00", True), ("2019-03-01 23:59:59.999", True), ("2019-03-02 00:00:00", False)]),
    (TimeRange.days(date(2020, 2, 29), date(2020, 2, 29)), [("2020-02-29 04:05:06.070", True), ("2020-03-01 00:00:00", False)]),
    (TimeRange.days(date(2019, 2, 27), None), [("2090-01-01 00:00:00", True), ("2019-02-26 12:00:00", False)]),
    # Minutes forget the seconds of their bounds.
    (TimeRange.minutes(datetime(2019, 7, 1, 23, 58, 59), datetime(2019, 7, 2, 0, 1, 1)), [
        ("2019-07-01 23:57:59.999", False), ("2019-07-01 23:58:00", True), ("2019-07-02 00:01:59.999", True), ("2019-07-02 00:02:00", False)]),
    # Bounds as text, to the millisecond, also in an hour that clocks skip.
    (TimeRange.between("2021-03-28T02:10:00.005", "2021-03-28T02:10:00.005"), [
        ("2021-03-28 02:10:00.005", True), ("2021-03-28 02:10:00.004", False), ("2021-03-28 02:10:00.006", False)]),
    (TimeRange.between(None, "2021-03-28"), [("2021-03-28 00:00:00", True), ("2021-03-28 00:00:00.001", False)]),
    (TimeRange.between("2021-06-30T22:00:00Z", None, "Asia/Tokyo"), [("2021-07-01 07:00:00", True), ("2021-07-01 06:59:59.999", False)]),
    (TimeRange.quick("last_15_minutes", datetime(2022, 1, 1, 0, 5, 30)), [
        ("2021-12-31 23:49:59.999", False), ("2021-12-31 23:50:00", True), ("2022-01-01 00:05:59", True)]),
    (TimeRange.quick("last_hour", datetime(2022, 1, 1, 13, 45)), [("2022-01-01 12:45:00", True), ("2022-01-01 12:44:59.999", False)]),
    (TimeRange.quick("today", datetime(2022, 1, 1, 13, 45)), [("2022-01-01 23:59:59.999", True), ("2021-12-31 23:59:59.999", False)]),
    (TimeRange.quick("last_24_hours", datetime(2022, 1, 1, 13, 45)), [("2021-12-31 13:45:00", True), ("2021-12-31 13:44:59.999", False)]),
]


def test_time_ranges(spark):
    for time_range, cases in RANGES:
        for ts, want in cases:
            assert passes(spark, A, LogFilter(time_range=time_range), ts=ts) == want, (time_range, ts)


def test_levels_and_validity(spark):
    for least, level, want in [("warn", 3, True), ("WARNING", 2, False), ("fatal", 5, True), ("ERROR", 6, False),
                               (None, 6, True), ("UNKNOWN", 0, True), ("trace", 6, False)]:
        assert passes(spark, A, LogFilter(min_level=least), level=level) == want, (least, level)
    assert passes(spark, A, LogFilter(), valid=False) is False


def test_bad_requests(spark):
    with pytest.raises(ValueError):
        TimeRange.between("2026-08-13", "2026-08-12")
    with pytest.raises(ValueError):
        TimeRange.between("yesterday", None)
    with pytest.raises(ValueError):
        TimeRange.quick("last_year", datetime(2026, 1, 1))
    with pytest.raises(ValueError):
        LogFilter(min_level="loud")
    for bad in (LogFilter(search="(a"), LogFilter(exclude="[z-a]")):
        with pytest.raises(ValueError):
            bad.check(spark)


@pytest.mark.parametrize("pattern,text,want", [
    (r"\bERROR\b", "ERRORé", True), (r"\bERROR\b", "ERROR1", False), (r"a.b", "a\rb", True),
    (r"a.b", "a b", True), (r"[[a]x", "[x", True), (r"[a&&b]x", "&x", True), (r"[]a]x", "]x", True),
    (r"[^]a]x", "bx", True), (r"[^]a]x", "]x", False), (r"(?P<a_1>x)\k<a_1>", "xx", True),
    (r"(?<n>x)(?P=n)", "xy", False), (r"^[[:alpha:]]+$", "abc", True), (r"^[[:^digit:]]+$", "a1", False),
    (r"^[[:word:]]+$", "abc_1x", True), (r"^[[:^word:]]+$", "-é", True), (r"^[[:ascii:]]$", "é", False),
    (r"(?x)a b [ c#] # comment", "ab#", True), (r"(?i:A)b", "ab", True), (r"\Q(\E", "(", True), (r"\Bb", "ab", True), (r"(?i)x\.", "X.", True),
])
def test_pattern_dialect(spark, pattern, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.col("t").rlike(patterns.compile_check(spark, pattern, "p").text)).first()[0] == want


@pytest.mark.parametrize("pattern", ["(?U)a+", "(?u)a", "(?d)a", "(?J)a", "(?xx)a b", "[[:letter:]]", "(?i-n:a)"])
def test_what_means_another_thing_is_rejected(spark, pattern):
    with pytest.raises(ValueError):
        patterns.compile_check(spark, pattern, "p")


def test_group_numbers():
    assert patterns.to_java(r"(a)(?:b)(?<x_y>c(d))(?=e)(?P<z>[(]f)").groups == {"x_y": 2, "z": 4}
