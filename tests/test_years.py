import os
import random

import pytest
from pyspark.sql import functions as F

from timberline import AnalysisRequest, analyze
from timberline.operators import structuring, years
from timberline.plans import durable
from timberline.sources.text_lines import read_lines, table_lines

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def write(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def runs_of(lines):
    return years.syslog_runs(lines, structuring.syslog_month(F.col("value")), in_order=False)


def runs_of_months(lines, in_order=False):
    return years.month_runs(lines, F.col("m"), F.lit(None), F.lit(None).cast("string"), in_order)


def years_of(spark, path, **options):
    run = analyze(spark, AnalysisRequest(path, **options))
    return [r.ts.year for r in run.sorted().collect()], run.formats.first()


def test_the_year_given_is_that_of_the_first_line(spark, tmp_path):
    path = write(tmp_path, "mail.log", ["Oct  9 04:10:00 relay7 postfix/smtp[811]: queued", "Feb 17 20:41:33 relay7 postfix/qmgr: removed",
                                        "Aug  2 11:00:09 relay7 cron[5]: (root) CMD", "Jan 30 00:59:58 relay7 cron[6]: (root) CMD"])
    got, fmt = years_of(spark, path, syslog_year=1987)
    assert got == [1987, 1988, 1988, 1989]
    assert (fmt.detected, fmt.start_year, fmt.year_origin) == ("syslog", 1987, "explicit")


def test_years_beyond_four_digits_are_not_accepted(spark, tmp_path):
    path = write(tmp_path, "end.log", ["Sep 14 03:00:00 n1 x: a", "Feb  3 03:00:00 n1 x: b"])
    run = analyze(spark, AnalysisRequest(path, syslog_year=9999))
    assert [(r.is_valid, r.ts and r.ts.year) for r in run.entries.orderBy("line_id").collect()] == [(True, 9999), (False, None)]


def test_full_dates_in_the_lines_tell_the_year(spark, tmp_path):
    path = write(tmp_path, "backup.log", ["Jun 21 17:05:40 vault tar[77]: set opened Sun Jun 21 17:05:40 CEST 1992",
                                          "Jun 22 01:00:00 vault tar[78]: 14 volumes"])
    got, fmt = years_of(spark, path)
    assert got == [1992, 1992] and (fmt.label, fmt.year_origin) == ("Syslog", "auto")


def test_a_full_date_behind_two_year_ends(spark, tmp_path):
    path = write(tmp_path, "door.log", [
        "Sep 13 06:30:00 gate2 badge[9]: in", "Feb 11 06:31:10 gate2 badge[9]: in", "Dec 19 18:02:44 gate2 badge[9]: out",
        "Apr  6 09:14:05 gate2 badge[9]: clock set to Fri Apr  6 09:14:05 1979", "Apr  7 06:29:00 gate2 badge[9]: in"])
    assert years_of(spark, path)[0] == [1977, 1978, 1978, 1979, 1979]


def test_the_file_time_is_the_last_resort(spark, tmp_path):
    path = write(tmp_path, "lamp.log", ["Nov  3 22:15:00 pole41 relay: on", "Mar 28 05:40:00 pole41 relay: off"])
    os.utime(path, (1041371400, 1041371400))  # 2002-12-31 21:50:00 UTC
    got, fmt = years_of(spark, path)
    assert got == [2002, 2003] and fmt.year_origin == "mtime_estimate"
    assert years_of(spark, path, local_zone="Asia/Tokyo")[0] == [2003, 2004]


def test_a_year_in_the_name_beats_the_lines(spark, tmp_path):
    path = write(tmp_path, "pump_1984.txt", ["Jul  8 12:00:01 well3 motor[2]: test of Wed Jul  8 12:00:01 1998 done"])
    got, fmt = years_of(spark, path)
    assert got == [1984] and fmt.year_origin == "auto"


def test_file_name_years(spark):
    names = {"a-2003.log": 2003, "x20031.log": None, "1899.log": None, "2003.2004.log": 2003, "a.2004": None,
             "12003-2005_2006": 2005, "2001": 2001}
    df = spark.createDataFrame([(n,) for n in names], "s string")
    assert {r[0]: r[1] for r in df.select("s", years.file_name_year(F.col("s"))).collect()} == names


def test_anchor_rules(spark):
    rows = [
        "Mar  5 01:02:03 h p: Tue Mar 05 01:02:03 UTC 2001 and Tue Mar 5 01:02:03 2002",  # two votes
        "Mar 06 01:02:03 anything Wed Mar 6 01:02:03 2002",   # no host and process needed
        "Mar 07 01:02:03 h p: built Thu Mar 7 01:02:04 1990",  # other time
        "Mar 07 01:02:03 h p: Thu Mar 8 01:02:03 1990",        # other day
        "Mar 07 01:02:03 h p: Thu Apr 7 01:02:03 1990",        # other month
        "Mar 07 01:02:03 h p: Thu Mar 7 01:02:03 19901",       # longer number
        "no head Thu Mar 7 01:02:03 1990",
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "n int, v string")
    lines = table_lines(df, F.col("v"), F.lit("f"), F.col("n"), F.lit(0))
    votes = {r.year: r.votes for r in years.anchor_votes(runs_of(lines)).collect()}
    assert votes == {2001: 1, 2002: 2}
    tie = spark.createDataFrame([("f", 2005, 3), ("f", 2003, 3), ("f", 2001, 1)], "path string, year int, votes long")
    assert years.elect_year(tie).first()[1] == 2003


def sequential(months):
    count, previous, out = 0, 0, []
    for m in months:
        if m:
            count += previous - m >= 6 and previous > 0
            previous = m
        out.append(count)
    return out


@pytest.mark.parametrize("limit", [None, -1])
@pytest.mark.parametrize("kind", ["calm", "wild"])
def test_rollovers_equal_a_sequential_count(spark, limit, kind):
    rng = random.Random(11)
    data, want = [], {}
    for path in ("p", "q", "r"):
        size = {"p": 9000, "q": 2000, "r": 1}[path]
        step = 12 * 6 / size
        months = [int(i * step) % 12 + 1 if kind == "calm" else rng.randint(1, 12) for i in range(size)]
        months = [None if rng.random() < 0.2 else (m + (rng.random() < 0.02) - 1) % 12 + 1 for m in months]
        want[path] = sequential(months)
        data += [(path, i // 2500, i, m) for i, m in enumerate(months)]
    rng.shuffle(data)
    lines = spark.createDataFrame(data, "path string, block long, line_id long, m int")
    rows = years.count_year_starts(lines, years.year_starts(runs_of_months(lines)), limit).filter("m is not null").collect()
    assert len(rows) == sum(r[3] is not None for r in data)
    for r in rows:
        assert r.rollovers == want[r.path][r.line_id]


def test_chunks_hold_many_lines_however_sparse_the_ids(spark):
    lines = spark.range(40_000).select(F.lit("f").alias("path"), F.shiftright("id", 14).alias("block"),
                                       (F.col("id") * 1_000_003 + F.col("id") % 7).alias("line_id"), (F.col("id") / 4000 + 1).cast("int").alias("m"))
    found = years.year_starts(runs_of_months(lines))
    assert years._chunks(found.blocks)[0].count() <= 400 and found.starts.count() == 0
    for limit in (None, -1):
        assert years.count_year_starts(lines, found, limit).filter("rollovers <> 0").count() == 0


def test_runs_join_over_batches_and_splits(spark):
    """Runs of any length, cut anywhere, give the falls of the whole."""
    rng = random.Random(4)
    months = [rng.choice([None, rng.randint(1, 12)]) for _ in range(500)]
    want, previous = set(), None
    for i, m in enumerate(months):
        if m:
            if previous and previous - m >= 6:
                want.add(i)
            previous = m
    for cut in (1, 7, 499):
        lines = spark.createDataFrame([("f", i // cut, i, m) for i, m in enumerate(months)], "path string, block long, line_id long, m int")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
        try:
            found = years.year_starts(runs_of_months(lines))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {r.line_id for r in found.starts.collect()} == want


def test_many_splits_give_the_same_years(spark, tmp_path):
    rng = random.Random(2)
    rows, day = [], 0
    while day < 5 * 365:
        month, year = day // 31 % 12, 2001 + day // 372
        rows.append(f"{MONTHS[month]} {day % 28 + 1:2d} 10:00:00 host app[{year}]: event" if rng.random() < 0.9
                    else "not a syslog line")
        day += rng.randint(0, 2)
    path = write(tmp_path, "long.log", rows)
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert read_lines(spark, path).select("block").distinct().count() > 5
        run = analyze(spark, AnalysisRequest(path, syslog_year=2001))
        got = [(r.ts.year, r.raw_line) for r in run.sorted().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [line for _, line in got] == [r for r in rows if "host" in r]
    assert all(f"[{year}]" in line for year, line in got)


def test_lookup_join_beyond_the_broadcast_limit(spark):
    lines = spark.range(1000).selectExpr("concat('p', id % 3) path", "id line_id")
    table = durable.durable(spark.createDataFrame([("p0", 1), ("p1", 2)], "path string, v int"))
    small = durable.lookup_join(lines, table, ["path"])
    large = durable.lookup_join(lines, table, ["path"], limit=-1)
    assert sorted(small.collect(), key=str) == sorted(large.select(small.columns).collect(), key=str)
    assert "_salt" in large._jdf.queryExecution().optimizedPlan().toString()
    for how, count in [("inner", 667), ("left_semi", 667)]:
        assert durable.lookup_join(lines, table, ["path"], how, limit=-1).count() == count
