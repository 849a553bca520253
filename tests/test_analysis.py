import json
import os
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from timberline import AnalysisRequest, LogFilter, Strategy, TimeRange, analyze
from timberline.operators import structuring
from timberline.plans import analysis
from timberline.plans.durable import durable
from timberline.sinks import exports
from timberline.sources import text_lines
from timberline.sources.text_lines import file_head_sample, read_lines

LEVELS = {"INFO": 21, "TRACE": 4, "WARNING": 11, "ERROR": 6, "CRITICAL": 5}


@pytest.fixture
def harbour(tmp_path):
    """47 lines with known counts, and one torn line as number 20."""
    words = [w for w, n in LEVELS.items() for _ in range(n)]
    hours = ["06"] * 15 + ["07"] * 18 + ["08"] * 12 + ["11"] * 2
    rows = [f"[2019-10-06 {h}:{i:02d}:47] {w}: Bağlama {i}; pier=K{i % 9}Q" for i, (w, h) in enumerate(zip(words, hours))]
    rows.insert(19, "~~ torn page ~~")
    path = tmp_path / "harbour.log"
    path.write_bytes("\r\n".join(rows).encode())
    return path


@pytest.fixture
def syslog(tmp_path):
    path = tmp_path / "lock 1976.log"
    path.write_text("Oct 30 08:09:10 h sluice[1]: gate opens\nFeb 11 12:13:14 h sluice[1]: gate shuts\n")
    return path


def pairs(df):
    return {r[0]: r[-1] for r in df.collect()}


def test_counts_of_a_file(spark, harbour):
    run = analyze(spark, AnalysisRequest(str(harbour)))
    assert run.counters.first().asDict() == {
        "total_lines": 48, "parsed_lines": 47, "unparsed_lines": 1, "filtered_in": 47}
    assert pairs(run.by_level) == LEVELS
    assert [r.level for r in run.by_level.collect()] == ["TRACE", "INFO", "WARNING", "ERROR", "CRITICAL"]
    assert [tuple(r) for r in run.by_hour.collect()] == [
        ("2019-10-06 06:00", 15), ("2019-10-06 07:00", 18), ("2019-10-06 08:00", 12), ("2019-10-06 11:00", 2)]
    assert [tuple(r) for r in run.coverage.collect()] == [("harbour.log", "heuristic", 48, 47)]
    assert pairs(run.level_series) == LEVELS


@pytest.mark.parametrize("marks", [1 << 20, 1])
def test_mixed_formats_in_request_order(spark, harbour, syslog, tmp_path, monkeypatch, marks):
    monkeypatch.setattr("timberline.sources.text_lines.MOST_MARKS", marks)
    empty = tmp_path / "empty.log"
    empty.write_text("")
    plain = tmp_path / "plain.txt"
    plain.write_text("hello\nworld\n\n")
    paths = [str(syslog), str(plain), str(empty), str(harbour)]
    run = analyze(spark, AnalysisRequest(paths))
    formats = {r.source: (r.format, r.detected, r.start_year, r.year_origin) for r in run.formats.collect()}
    assert formats == {
        "lock 1976.log": ("syslog", "syslog", 1976, "auto"), "plain.txt": ("heuristic", "unknown", None, None),
        "empty.log": ("heuristic", "unknown", None, None), "harbour.log": ("heuristic", "heuristic", None, None)}
    rows = run.sorted().collect()
    assert [r.source for r in rows] == ["lock 1976.log"] * 2 + ["harbour.log"] * 47
    assert [r.raw_line for r in rows[2:]] == [
        line for line in harbour.read_bytes().decode().split("\r\n") if line.startswith("[")]
    assert [str(r.ts) for r in rows[:2]] == ["1976-10-30 08:09:10", "1977-02-11 12:13:14"]
    summary = run.summary.first()
    assert (summary.result_count, summary.file_count, summary.total_lines, summary.unparsed_lines) == (49, 4, 53, 4)
    assert (summary.syslog_files, summary.unknown_files, summary.heuristic_files) == (1, 2, 1)


def test_folders_globs_and_repeats(spark, tmp_path):
    for folder, names in {"b": "xy", "a": "z"}.items():
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / f"{n}.log").write_text(f"2024-01-01 00:00:00 INFO {n}\n")
    messages = lambda paths: [r.message for r in analyze(spark, AnalysisRequest(paths)).sorted().collect()]
    assert messages([f"{tmp_path}/b", f"{tmp_path}/a/z.log"]) == ["x", "y", "z"]
    assert messages([f"{tmp_path}/a/*.log", f"{tmp_path}/b/y*"]) == ["z", "y"]
    assert messages([f"{tmp_path}/b/y.log", f"{tmp_path}/a/z.log", f"{tmp_path}/b/y.log"]) == ["y", "z", "y"]
    assert messages([os.path.relpath(f"{tmp_path}/b/y.log"), f"file://{tmp_path}/a"]) == ["y", "z"]


def test_scan_keeps_lines(spark, tmp_path):
    path = tmp_path / "odd.log"
    path.write_bytes("﻿one\r\n\r\ntwo\rhalf\n three\n last ".encode())
    values = [r.value for r in read_lines(spark, str(path)).orderBy("block", "line_id").collect()]
    assert values == ["one", "", "two\rhalf", " three", " last "]


def test_hidden_files_are_refused_or_reported(spark, tmp_path):
    for name in ("a.log", "_b.log", ".c.log"):
        (tmp_path / name).write_text("2024-01-01 00:00:00 INFO x\n" * 3)
    for name in ("_b.log", ".c.log"):
        with pytest.raises(ValueError, match="begin with"):
            analyze(spark, AnalysisRequest([f"{tmp_path}/a.log", f"{tmp_path}/{name}"])).counters.collect()
    with pytest.warns(UserWarning, match="_b.log"):
        assert read_lines(spark, str(tmp_path)).count() == 3


@pytest.mark.parametrize("split", [400, 90])
def test_samples_do_not_depend_on_splits(spark, tmp_path, split):
    path = tmp_path / "late.log"
    rows = [f"no stamp in line {i:02d}" + " " * 40 for i in range(12)] + [f"2024-01-01 00:00:{i:02d} INFO x" for i in range(30)]
    path.write_text("\n".join(rows) + "\n")
    (tmp_path / "few.log").write_text("one\ntwo\n")
    whole = [r.value for r in file_head_sample(spark, [str(path)]).orderBy("block", "line_id").collect()]
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        paths = [str(path), str(tmp_path / "few.log")]
        assert read_lines(spark, str(path)).select("block").distinct().count() > 3
        rows_ = file_head_sample(spark, paths).orderBy("block", "line_id").collect()
        assert [r.value for r in rows_ if r.source == "late.log"] == whole == rows[:20]
        assert sum(r.source == "few.log" for r in rows_) == 2
        formats = {r.source: r.detected for r in analyze(spark, AnalysisRequest(paths)).formats.collect()}
        assert formats == {"late.log": "heuristic", "few.log": "unknown"}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_missing_file_fails_the_run(spark, harbour):
    with pytest.raises(AnalysisException):
        analyze(spark, AnalysisRequest([str(harbour), str(harbour) + ".gone"])).counters.collect()


def test_filtered_run(spark, harbour):
    flt = LogFilter(time_range=TimeRange.between("2019-10-06T07:00:00", None), min_level="error", search="baglama pier",
                    exclude="K1Q")
    run = analyze(spark, AnalysisRequest(str(harbour), filter=flt, format="heuristic"))
    rows = [r for r in harbour.read_bytes().decode().split("\r\n") if r.startswith("[") and r[12:14] >= "07"
            and ("ERROR" in r or "CRITICAL" in r) and "K1Q" not in r]
    # 'baglama' is too far from the pieces that ASCII words leave of the Turkish word.
    assert run.results.count() == 0 and run.counters.first().parsed_lines == 47
    assert run.summary.first().range_is_empty
    flt = LogFilter(flt.time_range, flt.min_level, "lama pier", flt.exclude)
    run = analyze(spark, AnalysisRequest(str(harbour), filter=flt, format="heuristic"))
    assert [r.raw_line for r in run.sorted().collect()] == rows
    assert not run.summary.first().range_is_empty
    spans = run.highlighted().select("message", "spans").collect()
    assert all([m[s.start:s.start + s.length] for s in found] == ["lama", "pier"] for m, found in spans)


def test_sorting_is_stable_in_both_directions(spark, harbour):
    run = analyze(spark, AnalysisRequest(str(harbour), format="heuristic"))
    base = [(r.level_ord, r.ts, r.message) for r in run.sorted().collect()]
    pick = lambda **kw: [(r.level_ord, r.ts, r.message) for r in run.sorted(**kw).collect()]
    assert pick(by="level") == sorted(base, key=lambda r: r[0])
    assert pick(by="level", descending=True) == sorted(base, key=lambda r: -r[0])
    assert pick(by="timestamp", descending=True) == sorted(base, key=lambda r: r[1], reverse=True)
    assert pick(by="source", descending=True) == base
    with pytest.raises(ValueError):
        run.sorted(by="colour")


def test_text_sorts_follow_the_locale(spark, tmp_path):
    words = ["b", "B", "a", "ä", "Z", "_x", "A"]
    (tmp_path / "w.log").write_text("".join(f"2024-01-01 00:00:00 INFO {w}\n" for w in words))
    run = analyze(spark, AnalysisRequest(str(tmp_path / "w.log")))
    assert [r.message for r in run.sorted("message").collect()] == ["_x", "a", "A", "ä", "b", "B", "Z"]


def test_view(spark, tmp_path):
    (tmp_path / "v.log").write_text("2024-01-01 00:00:00,070 INFO a\n2024-01-01 00:00:01 fatal b\n")
    run = analyze(spark, AnalysisRequest(str(tmp_path / "v.log")))
    assert [tuple(r) for r in run.view().collect()] == [
        ("2024-01-01 00:00:00.070", "INFO", "a", "v.log", "2024-01-01 00:00:00,070 INFO a"),
        ("2024-01-01 00:00:01.000", "CRITICAL", "b", "v.log", "2024-01-01 00:00:01 fatal b")]


def parts(folder, suffix):
    return b"".join(p.read_bytes() for p in sorted(Path(folder).glob(f"part-*{suffix}")))


def test_csv_bytes(spark, tmp_path):
    messages = ['plain', 'semi;colon', 'say "hi"', ' lead', '#hash', "it's, ok", 'tab\tin', 'back\\slash', 'ğ', '"', 'cr\rin']
    (tmp_path / "c.log").write_bytes("".join(
        f"[2016-02-09 06:00:{i:02d}] INFO x: {m}\n" for i, m in enumerate(messages)).encode())
    pattern = r"^\[(?<timestamp>[^\]]*)\] (?<level>\w+) x: (?<message>.*)$"
    run = analyze(spark, AnalysisRequest(str(tmp_path / "c.log"), line_pattern=pattern))
    for _ in range(2):  # the second export replaces the first
        assert run.export(path=str(tmp_path / "out")) == "csv"
    quote = lambda m: '"' + m.replace('"', '""') + '"' if any(c in m for c in ';"\r') else m
    want = "﻿timestamp; level; message; source \n" + "".join(
        f"2016-02-09T06:00:{i:02d};INFO;{quote(m)};c.log\n" for i, m in enumerate(messages))
    got = parts(tmp_path / "out", ".csv").decode()
    assert got.replace(want[:want.index("\n") + 1], "") == want[want.index("\n") + 1:]
    assert got.startswith("﻿timestamp; level; message; source \n")
    assert {r.message for r in exports.read_csv(spark, str(tmp_path / "out")).collect()} >= set(messages[:4])


def test_json_export(spark, harbour, tmp_path):
    run = analyze(spark, AnalysisRequest(str(harbour), export_format="JSON", output_path=str(tmp_path / "out")))
    assert run.export(by="level") == "json"
    rows = [json.loads(line) for line in parts(tmp_path / "out/entries", ".json").decode().splitlines()]
    assert list(rows[0]) == ["timestamp", "level", "message", "source"]
    assert Counter(r["level"] for r in rows) == LEVELS
    assert [r["level"] for r in rows] == [w for w in ("TRACE", "INFO", "WARNING", "ERROR", "CRITICAL") for _ in range(LEVELS[w])]
    stats = json.loads(parts(tmp_path / "out/stats", ".json"))
    assert stats == {
        "totalLines": 48, "parsedLines": 47, "unparsedLines": 1, "filteredInCount": 47, "countsByLevel": LEVELS,
        "countsByHourBucket": {"2019-10-06 06:00": 15, "2019-10-06 07:00": 18, "2019-10-06 08:00": 12, "2019-10-06 11:00": 2}}
    assert list(stats["countsByLevel"]) == sorted(LEVELS)
    rows = [json.loads(line) for line in parts(tmp_path / "out/counters", ".json").decode().splitlines()]
    assert {r["key"]: r["n"] for r in rows if r["kind"] == "level"} == LEVELS
    assert {r["key"]: r["n"] for r in rows if r["kind"] == "lines"} == {
        "total_lines": 48, "parsed_lines": 47, "unparsed_lines": 1, "filtered_in": 47}


def test_export_as_the_scan_brings_it(spark, harbour, tmp_path):
    flt = LogFilter(min_level="error")
    run = analyze(spark, AnalysisRequest(str(harbour), format="heuristic", filter=flt))
    assert run.export(path=str(tmp_path / "out"), name="json", ordered=False) == "json"
    rows = [json.loads(line) for line in parts(tmp_path / "out/entries", ".json").decode().splitlines()]
    assert Counter(r["level"] for r in rows) == {k: LEVELS[k] for k in ("ERROR", "CRITICAL")}
    stats = json.loads(parts(tmp_path / "out/stats", ".json"))
    assert (stats["totalLines"], stats["parsedLines"], stats["filteredInCount"]) == (48, 47, 11)
    written = run._export_input(None)[0]
    assert "raw_line" not in written.columns and "value" not in written.columns
    plan = run._structured(flt)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_export_format_choice():
    assert [exports.export_format(p, n) for p, n in [("a.JSON", None), ("a.txt", None), ("a.json", "csv")]] == [
        "json", "csv", "csv"]
    with pytest.raises(ValueError):
        exports.export_format("a", "xml")


@pytest.mark.parametrize("bad", [
    {"syslog_year": 999}, {"syslog_year": 10000}, {"export_format": "csv"}, {"output_path": "x"},
    {"export_format": "xml", "output_path": "x"}, {"format": "nope"}, {"timestamp_format": "ddd"}])
def test_bad_requests(bad):
    with pytest.raises(ValueError):
        AnalysisRequest("a.log", **bad)


def test_patterns_are_checked_before_reading(spark):
    for options in ({"line_pattern": "(?<timestamp>x)"}, {"filter": LogFilter(search="(")}):
        with pytest.raises(ValueError):
            analyze(spark, AnalysisRequest("/does/not/exist", **options))


def test_own_strategy_takes_part_in_detection(spark, harbour, tmp_path):
    (tmp_path / "p.txt").write_text("2024-01-01 01:00:00|warn|hello\n" * 3)
    pipe = Strategy.from_columns("pipe", "Pipe", lambda t: (
        F.regexp_extract(t, r"^([^|]*)\|", 1).try_cast("timestamp_ntz"),
        F.regexp_extract(t, r"\|(\w+)\|", 1), F.regexp_extract(t, r"([^|]*)$", 1)))
    run = analyze(spark, AnalysisRequest([str(tmp_path / "p.txt"), str(harbour)], strategies=(pipe,)))
    # The heuristic accepts these lines as well, and wins the tie.
    assert {r.source: r.format for r in run.formats.collect()} == {"p.txt": "heuristic", "harbour.log": "heuristic"}
    assert run.summary.first().pipe_files == 0
    (tmp_path / "p.txt").write_text("x" * 40 + "\n2024|warn|x\n")
    never = Strategy.from_columns("any", "Any", lambda t: (
        F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"), F.lit("info"), F.upper(t)))
    run = analyze(spark, AnalysisRequest([str(tmp_path / "p.txt"), str(harbour)], strategies=(pipe, never)))
    assert (run.summary.first().any_files, run.summary.first().file_count) == (2, 2)
    assert {r.source: r.label for r in run.formats.collect()} == {"p.txt": "Any", "harbour.log": "Any"}
    assert run.results.count() == 50


def test_structuring_works_on_a_stream(spark, harbour, tmp_path):
    (tmp_path / "in").mkdir()
    os.link(harbour, tmp_path / "in/harbour.log")
    lines = spark.readStream.option("lineSep", "\n").text(str(tmp_path / "in"))
    entries = structuring.structure(lines, [structuring.heuristic()])
    passed = entries.filter(LogFilter(min_level="ERROR").predicate())
    query = (passed.select("level").writeStream.format("memory").queryName("errors")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(60)
    assert pairs(spark.sql("SELECT level, count(*) FROM errors GROUP BY level")) == {"ERROR": 6, "CRITICAL": 5}


def test_plans(spark, harbour):
    flt = LogFilter(min_level="WARNING", time_range=TimeRange.between("2019-10-06", None), search="Ba.*")
    run = analyze(spark, AnalysisRequest(str(harbour), format="heuristic", filter=flt))
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plan = text(run.results.select("ts", "level"))
    # No Python, no shuffle, each expression once, and nothing that is not asked for.
    assert "Python" not in plan and "Exchange" not in plan and "Join" not in plan
    assert plan.count("regexp_extract(") == 2
    plan = text(run.results.select("message"))
    assert plan.count("regexp_extract(") == 3
    # From the top: messages are cut above both filters, levels between them, times below.
    message, level = plan.index("(?s)^(?:.{0,99}"), plan.index("(?i:")
    first, second = plan.index(") Filter "), plan.rindex(") Filter ")
    assert message < first < level < second < plan.index("(?s)^.*?\\d{4}")


def test_a_head_is_read_without_the_rest(spark, tmp_path):
    """20 lines of files of several megabytes, one with lines longer than a read, one compressed."""
    import gzip

    sizes = {}
    for i in range(3):
        path = tmp_path / f"big{i}.log"
        path.write_text("".join(f"2024-01-01 00:00:00 INFO line {k} of {i}\n" for k in range(300_000)))
        sizes[path.name] = path.stat().st_size
    (tmp_path / "wide.log").write_text("".join(f"{k}" + "x" * 90_000 + "\r\n" for k in range(30)))
    (tmp_path / "few.log").write_bytes("﻿one\r\n\ntwo".encode())
    with gzip.open(tmp_path / "zipped.log.gz", "wt") as f:
        f.write("packed\n" * 30)
    files = text_lines.input_files(spark, [str(tmp_path)])
    assert files.count() == 6
    heads = text_lines.read_heads(files, 20).collect()
    taken = {os.path.basename(r.path): r.head_bytes for r in heads}
    assert all(taken[name] <= 0.01 * size for name, size in sizes.items())
    by_file = {}
    for r in sorted(file_head_sample(spark, [str(tmp_path)]).collect(), key=lambda r: r.line_id):
        by_file.setdefault(r.source, []).append(r.value)
    assert by_file["big1.log"] == [f"2024-01-01 00:00:00 INFO line {k} of 1" for k in range(20)]
    assert by_file["wide.log"] == [f"{k}" + "x" * 90_000 for k in range(20)]
    assert by_file["few.log"] == ["one", "", "two"] and by_file["zipped.log.gz"] == ["packed"] * 20


def test_files_that_cannot_be_opened_are_scanned(spark, tmp_path, monkeypatch):
    (tmp_path / "a.log").write_text("".join(f"line {k}\n" for k in range(50)))
    (tmp_path / "b.log").write_text("only\n")
    closed = lambda files, count: files.select("path", F.when(F.col("path").endswith("b.log"), F.lit(0).cast("long")).alias("line_id"),
                                               F.lit("only").alias("value"), F.lit(0).alias("head_bytes"))
    monkeypatch.setattr(text_lines, "read_heads", closed)
    rows = file_head_sample(spark, [str(tmp_path)]).collect()
    assert sorted(r.value for r in rows if r.source == "a.log") == sorted(f"line {k}" for k in range(20))
    assert [r.value for r in rows if r.source == "b.log"] == ["only"]


def test_scans_open_only_the_files_asked_for(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"f{i}.log").write_text(f"line of {i}\n" * 2000)
    wanted = durable(text_lines.input_files(spark, [str(tmp_path)]).filter(F.col("path").rlike("f(3|17)[.]log$")).select("path"))
    lines = read_lines(spark, [str(tmp_path)], only=wanted)
    assert {r.source: r["count"] for r in lines.groupBy("source").count().collect()} == {"f3.log": 2000, "f17.log": 2000}
    bare = read_lines(spark, [str(tmp_path)])
    marks = text_lines.file_marks(wanted)
    kept = bare.select("path").distinct().filter(F.substr(F.lit(marks), text_lines._mark(F.col("path"), len(marks)) + 1, F.lit(1)) == "1")
    assert kept.count() <= 8


def test_one_preparatory_scan_of_syslog_files(spark, tmp_path, monkeypatch):
    """Years by votes of the content: the files are read twice, for the months and for the entries."""
    (tmp_path / "door.log").write_text("".join(f"{m} {d:2d} 06:30:00 gate2 badge[9]: in {f'Fri {m} {d} 06:30:00 1979' if d == 7 else ''}\n"
                                               for m in ("Oct", "Feb", "Nov", "Jan") for d in range(1, 28)))
    scans = []
    real = text_lines.read_lines
    monkeypatch.setattr(analysis, "read_lines", lambda *a, **k: scans.append(1) or real(*a, **k))
    run = analyze(spark, AnalysisRequest(str(tmp_path / "door.log")))
    assert run.formats.first().year_origin == "auto"
    assert sorted({r.ts.year for r in run.entries.collect()}) == [1978, 1979, 1980]
    assert len(scans) == 2


@pytest.mark.parametrize("glob, path, hit", [
    ("/a/*.log", "/a/b.log", True), ("/a/*.log", "/a/b/c.log", False), ("/a/?.l[o-p]g", "/a/x.log", True), ("/a/[!x].log", "/a/x.log", False),
    ("/a/{b,c?}/d", "/a/cx/d", True), ("/a/{b,c?}/d", "/a/c/d", False), ("/a+b/(c)", "/a+b/(c)", True), ("/a/\\*.log", "/a/*.log", True)])
def test_globs_stay_inside_names(glob, path, hit):
    assert bool(re.search(text_lines._glob_pattern(glob), path)) == hit
