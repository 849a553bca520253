import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from timberline.functions.timestamps import TimeFormat
from timberline.operators import structuring


def entries(spark, rows, strategy):
    df = spark.createDataFrame([(n, r) for n, r in enumerate(rows)], "n int, value string")
    return structuring.structure(df, [strategy]).orderBy("n").collect()


# (line, time text or None, level, message)
HEURISTIC = [
    ("[2031-03-09 14:22:05] Warning: kiln 3 cools, °C=412", "2031-03-09 14:22:05", "WARNING", "kiln 3 cools, °C=412"),
    ("== page torn here ==", None, None, None),
    ("[2031-03-09 14:22:06] TRACE: naïve:retry", "2031-03-09 14:22:06", "TRACE", "naïve:retry"),
    ("2029-11-02 08:15:30,004 debug [pool-2] net.kiln.Fan: spins", "2029-11-02 08:15:30.004", "DEBUG", "spins"),
    ("2029-11-02 08:15:31,990 - ERROR  [F[no=4]/[::1]:70:Slow@12] - Lost: 2", "2029-11-02 08:15:31.990", "ERROR", "Lost: 2"),
    ("[2033-01-20 23:00:59.120][q7][BELT/STOP][12ms] torque=9 b", "2033-01-20 23:00:59.120", "UNKNOWN", "torque=9 b"),
    ("07/31/2030 05:06:07 fatal - - boom \u00a0", "2030-07-31 05:06:07", "CRITICAL", "boom"),
    # A separator far behind the level is still taken.
    ("2024-01-01 00:00:00 INFO foo: bar", "2024-01-01 00:00:00", "INFO", "bar"),
    # Nothing behind the separator: the whole rest.
    ("2024-01-01 00:00:00 INFO foo:", "2024-01-01 00:00:00", "INFO", "foo:"),
    # A level word must stand alone, in ASCII terms.
    ("2024-01-01 00:00:00 INFOS ERROR\u00e9 x", "2024-01-01 00:00:00", "ERROR", "\u00e9 x"),
    # No level word: level unknown, still valid.
    ("2024-01-01 00:00:00 hello", "2024-01-01 00:00:00", "UNKNOWN", "hello"),
    # The first kind of timestamp that occurs wins, even if it is no real date.
    ("01/02/2024 10:00:00 2024-02-30 10:00:00.5", None, None, None),
    ("01/02/2024 10:00:00 2024-02-03 10:00:00", "2024-02-03 10:00:00", "UNKNOWN", ""),
    # Beyond 40 characters no timestamp is looked for; one that straddles the limit is cut.
    ("x" * 22 + "2024-01-01 00:00:00 INFO a", None, None, None),
    ("x" * 21 + "2024-01-01 00:00:00 INFO a", "2024-01-01 00:00:00", "INFO", "a"),
    ("x" * 18 + "2024-01-01 00:00:00.1234 INFO a", None, None, None),
    # Only brackets within 100 characters of the level count.
    ("2024-01-01 00:00:00 INFO " + "y" * 98 + "] msg", "2024-01-01 00:00:00", "INFO", "msg"),
    ("2024-01-01 00:00:00 INFO " + "y" * 99 + "] msg", "2024-01-01 00:00:00", "INFO", "y" * 99 + "] msg"),
    ("", None, None, None),
]


def test_heuristic(spark):
    rows = entries(spark, [r[0] for r in HEURISTIC], structuring.heuristic())
    for row, (line, ts, level, message) in zip(rows, HEURISTIC):
        want = datetime.fromisoformat(ts) if ts else None
        assert (row.ts, row.level, row.message, row.raw_line) == (want, level, message, line), line
        assert row.is_valid == (ts is not None)


def plain_time(text, lenient):
    """Whether a text is a time that exists, day or month first, by the layout of its parts."""
    clock = r"(?P<h>\d\d):(?P<mi>\d\d):(?P<s>\d\d)"
    iso = re.fullmatch(rf"(?P<y>\d{{4}})-(?P<m>\d\d)-(?P<d>\d\d)(?P<gap>[ T]){clock}(?:[.,](?P<f>\d+))?", text)
    found = iso or re.fullmatch(rf"(?P<m>\d\d)/(?P<d>\d\d)/(?P<y>\d{{4}}) {clock}", text)
    if not found:
        return False
    if iso and not lenient and (iso["gap"] == "T" or len(iso["f"] or "000") != 3):
        return False
    try:
        datetime(*(int(found[p]) for p in ("y", "m", "d", "h", "mi", "s")))
    except ValueError:
        return False
    return True


def drawn_times(seed, count):
    """Times by a grammar whose numbers now and then leave their range."""
    rng = random.Random(seed)
    near = lambda low, high: rng.choice([low, high, rng.randint(low, high), rng.randint(low, high), rng.choice([low - 1, high + 1])])
    for _ in range(count):
        y, m, d = rng.choice([1600, 1700, 2104, near(1, 9998)]), near(1, 12), near(1, rng.choice([28, 29, 30]))
        clock = f"{near(0, 23) % 100:02d}:{near(0, 59) % 100:02d}:{near(0, 59) % 100:02d}"
        if rng.random() < 0.3:
            yield f"{m:02d}/{d:02d}/{y:04d} {clock}"
        else:
            fraction = rng.choice(["", "", f"{rng.choice('.,')}{'0123456789'[:rng.choice([1, 2, 3, 3, 6])]}"])
            yield f"{y:04d}{rng.choice('---.')}{m:02d}-{d:02d}{rng.choice('   T')}{clock}{fraction}"


@pytest.mark.parametrize("lenient", [False, True])
def test_timestamps_equal_a_plain_parser(spark, lenient):
    texts = list(drawn_times(17, 600))
    rows = entries(spark, texts, structuring.heuristic(lenient))
    got = [(t, r.is_valid) for t, r in zip(texts, rows)]
    assert got == [(t, plain_time(t, lenient)) for t in texts]
    assert 100 < sum(valid for _, valid in got) < 500


@pytest.mark.parametrize("fmt,text,want", [
    ("yyyy-MM-dd HH:mm:ss.zzz", "1997-05-06 20:19:18.007", "1997-05-06 20:19:18.007"),
    ("yyyy-MM-dd HH:mm:ss.zzz", "1997-05-06 20:19:18.07", None),
    ("yyyy/MM/dd HH:mm", "1997-05-06 20:19", None),
    ("HH:mm", "", None),
    ("yyyyMMdd-HH.mm.ss,zzz", "19970506-20.19.18,300", "1997-05-06 20:19:18.300"),
    ("HH.mm/yyyy~MM~dd", "20.19/1997~05~06", "1997-05-06 20:19:00"),
    ("d MMM yyyy h:mm AP", "7 Feb 2024 12:05 am", "2024-02-07 00:05:00"),
    ("d MMM yyyy h:mm AP", "7 Feb 2024 1:05 PM", "2024-02-07 13:05:00"),
    ("d MMM yyyy h:mm AP", "7 Feb 2024 13:05 PM", None),
    ("yy'y'M/d", "98y2/3", "1998-02-03 00:00:00"),
    ("HH:mm:ss.z", "01:02:03.5", "1900-01-01 01:02:03.500"),
])
def test_user_time_formats(spark, fmt, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(TimeFormat.of(fmt).parse(F.col("t"))).first()[0]
    assert got == (datetime.fromisoformat(want) if want else None)


@pytest.mark.parametrize("fmt", ["", "yyyy ddd", "HH t", "HH HH"])
def test_bad_time_formats(fmt):
    with pytest.raises(ValueError):
        TimeFormat.of(fmt)


def test_syslog(spark):
    rows = entries(spark, [
        "Aug 31 15:16:17 buoy-9 gpsd[4]: fix lost  ", "May  7 00:10:20 buoy-9 init: [stage 2] net: up",
        "Feb 29 12:00:00 b p: leap", "Jun 31 12:00:00 b p: x", "Jun 01 12:00:00 b p", "AUG 31 15:16:17 b p: x", "Sep 3 7:00:00 b p: x",
    ], structuring.syslog(F.lit(1995)))
    got = [(str(r.ts) if r.ts else None, r.level, r.message) for r in rows]
    assert got == [("1995-08-31 15:16:17", "UNKNOWN", "fix lost"), ("1995-05-07 00:10:20", "UNKNOWN", "[stage 2] net: up"),
                   *[(None, None, None)] * 5]


def test_custom(spark):
    pattern = r"at (?P<timestamp>\d+/\d+/\d+ \d+h\d+) <(?<level>[a-z]+)>(?: \((?:\w+)\))? (?<message>.*)$"
    rows = entries(spark, [
        "~ at 03/04/2021 18h09 <warn> (oven) bread: done", "at 03/04/2021 18:09 <warn> x", "at 33/04/2021 18h09 <warn> x",
        "at 03/04/2021 18h09 <odd> a\rb\x85c", "at 03/04/2021 18h09 <info> \ufdd1 at 05/04/2021 18h09 <warn> z", "\ufdd103/04/2021 18h09",
    ], structuring.custom(spark, pattern, "dd/MM/yyyy HH'h'mm"))
    assert [(r.is_valid, r.level, r.message) for r in rows] == [
        (True, "WARNING", "bread: done"), (False, None, None), (False, None, None), (True, "UNKNOWN", "a\rb\x85c"),
        (True, "INFO", "\ufdd1 at 05/04/2021 18h09 <warn> z"), (False, None, None)]


def test_a_custom_pattern_runs_once_per_line(spark):
    strategy = structuring.custom(spark, r"(?x) ^(?<timestamp>\S+\ \S+)\ (?<level>\w+)\ (?<message>.*)$  # all parts")
    df = spark.createDataFrame([("2024-01-01 00:00:00 INFO a b",)], "value string")
    got = structuring.structure(df, [strategy])
    assert [(r.level, r.message) for r in got.collect()] == [("INFO", "a b")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("(?<g1>") == 1 and "regexp_extract(" not in plan
    build = lambda t: (F.regexp_extract(t, "^(.{19})", 1).try_cast("timestamp_ntz"), F.regexp_extract(t, r"(\w+) \w+$", 1), F.upper(t))
    plan = structuring.structure(df, [structuring.Strategy.from_columns("own", "Own", build)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract(") == 2


def test_preset_and_optional_group(spark):
    rows = entries(spark, ["[2017-02-03 09:10:11]  fatal:  x ", "2017-02-03 09:10:11 INFO: x"],
                   structuring.custom(spark, structuring.BRACKET_PRESET))
    assert [(r.is_valid, r.level, r.message) for r in rows] == [(True, "CRITICAL", "x "), (False, None, None)]
    rows = entries(spark, ["t=2017-02-03 09:10:11 hi"], structuring.custom(
        spark, r"t=(?<timestamp>\S+ \S+) (?<level>INFO )?(?<message>.*)"))
    assert [(r.level, r.message) for r in rows] == [("UNKNOWN", "hi")]


@pytest.mark.parametrize("pattern", ["(?<timestamp>x)(?<level>y)", "(?<timestamp>(", "(?<a>x"])
def test_custom_is_rejected_early(spark, pattern):
    with pytest.raises(ValueError):
        structuring.custom(spark, pattern)


def test_own_strategy_from_columns(spark):
    build = lambda t: (F.regexp_extract(t, r"^([^|]*)\|", 1).try_cast("timestamp_ntz"),
                       F.regexp_extract(t, r"\|(\w+)\|", 1), F.regexp_extract(t, r"\|\w+\|(.*)$", 1))
    pipe = structuring.Strategy.from_columns("pipe", "Pipe", build)
    rows = entries(spark, ["2024-01-01 01:00:00|warn|hello", "nope"], pipe)
    assert [(r.is_valid, r.level, r.message) for r in rows] == [(True, "WARNING", "hello"), (False, None, None)]
