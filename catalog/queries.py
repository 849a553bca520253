"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import lines as L
from catalog import oracles as O
from timberline import BRACKET_PRESET, AnalysisRequest, LogFilter, Strategy, TimeRange, analyze
from timberline.functions.timestamps import TimeFormat
from timberline.operators import detection, highlight, ordering, stats, structuring, years
from timberline.plans.durable import durable, lookup_join, scratch_dir
from timberline.sinks import exports
from timberline.sources.text_lines import read_lines, table_lines

ROW = ("line_id", "ts", "is_valid", "level", "level_ord", "message")
ENTRY = ("line_id", "ts", "level", "message")
WARN = LogFilter(min_level="WARNING")
EVERYTHING = LogFilter()


def app_entries(spark: SparkSession, sf_dir: str, flt: LogFilter = EVERYTHING) -> DataFrame:
    lines = L.app_lines(spark, sf_dir)
    entries = structuring.structure(lines, [structuring.heuristic()])
    return entries.withColumn("passed", flt.check(spark).predicate(message=None))


def app_results(spark: SparkSession, sf_dir: str, flt: LogFilter = EVERYTHING) -> DataFrame:
    lines = L.app_lines(spark, sf_dir)
    return structuring.structure(lines, [structuring.heuristic()], keep=flt.check(spark))


def app_cells(spark, sf_dir, flt=EVERYTHING, keys=()) -> DataFrame:
    return stats.count_cells(app_entries(spark, sf_dir, flt), keys=keys)


def passing(flt: LogFilter) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: app_results(spark, sf, flt).select(*ENTRY)


def level_counts(spark, sf_dir):
    return stats.counts_by_level(app_cells(spark, sf_dir, WARN))


def line_counters(spark, sf_dir):
    return stats.line_counters(app_cells(spark, sf_dir, WARN))


def hourly_counts(spark, sf_dir):
    return stats.counts_by_hour(app_cells(spark, sf_dir))


def stats_grouping_sets(spark, sf_dir):
    return stats.all_groupings(app_cells(spark, sf_dir, WARN))


def run_summary(spark, sf_dir):
    """Files of every built-in format and of a registered one, with a range and a level that leave some entries."""
    flt = LogFilter(time_range=TimeRange.between("2024-01-10", None), min_level="ERROR")
    request = AnalysisRequest(filter=flt, strategies=(pipe_strategy(),), syslog_year=L.FIRST_YEAR)
    return analyze(spark, request, mixed_lines(spark, sf_dir).unionByName(pipe_lines(spark, sf_dir))).summary


def level_series(spark, sf_dir):
    return stats.level_series(app_cells(spark, sf_dir))


def parse_coverage(spark, sf_dir):
    return stats.parse_coverage(app_cells(spark, sf_dir, keys=("source", "format")))


def heuristic_parse_bracket(spark, sf_dir):
    return app_entries(spark, sf_dir).select(*ROW)


def heuristic_parse_log4j(spark, sf_dir):
    lines = L.app_lines(spark, sf_dir, L.LOG4J_LINE)
    return structuring.structure(lines, [structuring.heuristic()]).select(*ROW)


def timestamp_validity(spark, sf_dir):
    text = F.expr(O.TIME_TEXT)
    return L.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("line_id"), TimeFormat.of("yyyy-MM-dd HH:mm:ss").parse(text).alias("ts"))


def time_format_parse(spark, sf_dir):
    text = F.expr("""concat(day(o_orderdate), '. ', substr('JanFebMarAprMayJunJulAugSepOctNovDec',
        month(o_orderdate) * 3 - 2, 3), case when o_orderkey % 9 = 0 then '' else ' ' end, year(o_orderdate), ' ',
        case when o_orderkey % 24 % 12 = 0 then 12 else o_orderkey % 24 % 12 end, ':',
        lpad(o_orderkey % 60, 2, '0'), case when o_orderkey % 24 < 12 then ' am' else ' pm' end)""")
    return L.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("line_id"), TimeFormat.of("d'.' MMM yyyy h:mm ap").parse(text).alias("ts"))


def syslog_parse(spark, sf_dir):
    lines = L.syslog_lines(spark, sf_dir)
    return structuring.structure(lines, [structuring.syslog(F.lit(1996))]).select(
        "line_id", "ts", "is_valid", "level", "message")


def custom_regex_parse(spark, sf_dir):
    pattern = r"^(?<timestamp>\d{2}/\d{2}/\d{4} \d{2}:\d{2}) <(?<level>\w+)> node-\d+ says (?<message>.*)$"
    strategy = structuring.custom(spark, pattern, "dd/MM/yyyy HH:mm")
    return structuring.structure(L.app_lines(spark, sf_dir, L.NODE_LINE), [strategy]).select(
        "line_id", "ts", "is_valid", "level", "message")


def default_preset_parse(spark, sf_dir):
    strategy = structuring.custom(spark, BRACKET_PRESET)
    return structuring.structure(L.app_lines(spark, sf_dir), [strategy]).select(
        "line_id", "ts", "is_valid", "level", "message")


# --- formats and years ---------------------------------------------------------------

def mixed_lines(spark, sf_dir) -> DataFrame:
    return reduce(DataFrame.unionByName, (
        L.app_lines(spark, sf_dir), L.syslog_lines(spark, sf_dir), L.doc_lines(spark, sf_dir)))


def built_in(year=None) -> list[Strategy]:
    return [structuring.heuristic(), structuring.syslog(F.lit(2000) if year is None else year)]


def format_detection(spark, sf_dir):
    return detection.detect_formats(mixed_lines(spark, sf_dir), built_in()).select(
        "source", "score_heuristic", "score_syslog", "format", "detected")


def mixed_format_parse(spark, sf_dir):
    lines, strategies = mixed_lines(spark, sf_dir), built_in(F.lit(1997))
    formats = durable(detection.detect_formats(lines, strategies).select("path", "format"))
    return structuring.structure(lookup_join(lines, formats, ["path"]), strategies).select(
        "source", "line_id", "format", "ts", "level", "message")


def format_report(spark, sf_dir):
    return analyze(spark, AnalysisRequest(), mixed_lines(spark, sf_dir)).formats.drop("path")


def pipe_strategy() -> Strategy:
    return Strategy.from_columns("pipe", "Pipe separated", lambda text: (
        F.regexp_extract(text, r"^([^|]*)\|", 1).try_cast("timestamp_ntz"),
        F.regexp_extract(text, r"\|(\w+)\|", 1), F.regexp_extract(text, r"([^|]*)$", 1)))


def pipe_lines(spark, sf_dir) -> DataFrame:
    return table_lines(L.read(spark, sf_dir, "events"), F.expr(O.PIPE), F.lit("pipe.txt"), F.col("event_id"),
                       F.shiftright("event_id", 20))


def registered_strategy(spark, sf_dir):
    lines = L.app_lines(spark, sf_dir).unionByName(pipe_lines(spark, sf_dir))
    return detection.detect_formats(lines, [*built_in(), pipe_strategy()]).select(
        "source", "score_heuristic", "score_syslog", "score_pipe", "format", "detected")


def syslog_year_rollover(spark, sf_dir):
    lines = L.syslog_lines(spark, sf_dir)
    runs = years.syslog_runs(lines, structuring.syslog_month(F.col("value")), in_order=False)
    found = years.year_starts(runs)
    counted = years.count_year_starts(lines, found).withColumn("_year", F.col("rollovers") + L.FIRST_YEAR)
    entries = structuring.structure(counted, [structuring.syslog(F.col("_year"))])
    return entries.filter("is_valid").select(
        "source", "line_id", F.year("ts").alias("year"), F.month("ts").cast("bigint").alias("month"))


def syslog_year_anchor_vote(spark, sf_dir):
    lines = L.syslog_lines(spark, sf_dir)
    votes = durable(years.anchor_votes(years.syslog_runs(lines, structuring.syslog_month(F.col("value")), in_order=False)))
    # One row per file on the elected side: measured before it is broadcast.
    return lookup_join(votes.withColumn("line_id", F.col("year").cast("bigint")), durable(years.elect_year(votes)),
                       ["path"]).select(F.col("path").alias("source"), "year", "votes", "content_year")


def syslog_year_precedence(spark, sf_dir):
    run = analyze(spark, AnalysisRequest(format="syslog"), L.syslog_lines(spark, sf_dir))
    return run.formats.select("source", "start_year", "year_origin")


def syslog_year_explicit(spark, sf_dir):
    run = analyze(spark, AnalysisRequest(format="syslog", syslog_year=1989), L.syslog_lines(spark, sf_dir))
    return run.formats.select("source", "start_year", "year_origin")


def syslog_year_of_file_time(spark, sf_dir):
    """Files just written, whose names and lines tell no year."""
    lines = L.syslog_lines(spark, sf_dir).filter("source = 'plain.log'")
    run = analyze(spark, AnalysisRequest(written_logs(spark, lines, "line_id"), format="syslog"))
    return run.formats.select("format", "start_year", "year_origin").distinct()


# --- filters -------------------------------------------------------------------------

def relative_range(spark, sf_dir):
    as_of = datetime(2024, 1, 20, 13, 37, 42)
    entries = app_entries(spark, sf_dir)
    names = ("last_15_minutes", "last_hour", "today", "last_24_hours")
    counts = entries.agg(*[F.count_if(LogFilter(time_range=TimeRange.quick(name, as_of)).predicate()).alias(name)
                           for name in names])
    return counts.unpivot([], list(names), "quick_range", "n")


def search_fuzzy_documents(spark, sf_dir):
    from timberline.operators.filters import search_predicate
    return L.doc_lines(spark, sf_dir).filter(search_predicate(F.col("value"), O.DOC_SEARCH)).select(
        "source", "line_id", F.col("value").alias("line"))


def search_message_fallback(spark, sf_dir):
    """Entries of another origin, half of them without a raw line: the message is searched instead."""
    flt = LogFilter(search=O.FUZZY_SEARCH, exclude="kind=click")
    entries = app_entries(spark, sf_dir).withColumn(
        "raw_line", F.when(F.col("line_id") % 2 == 0, F.lit("")).otherwise(F.col("raw_line")))
    return entries.filter(flt.check(spark).predicate()).select(*ENTRY)


COMBINED = LogFilter(
    time_range=TimeRange.between("2024-01-03", "2024-01-25T12:00:00"), min_level="info",
    search="purchas", exclude="worker")


# --- highlighting --------------------------------------------------------------------

def exploded(lines: DataFrame, spans) -> DataFrame:
    return lines.select("line_id", F.posexplode(spans).alias("idx", "span")).select(
        "line_id", "idx", "span.start", "span.length")


def highlight_regex(spark, sf_dir):
    return exploded(L.doc_lines(spark, sf_dir), highlight.highlight_spans(spark, F.col("value"), O.DOC_REGEX))


def highlight_fuzzy(spark, sf_dir):
    return exploded(L.doc_lines(spark, sf_dir), highlight.highlight_spans(spark, F.col("value"), O.DOC_SEARCH))


def highlight_merge(spark, sf_dir):
    text = F.col("value")
    both = F.concat(highlight.regex_spans(text, O.DOC_REGEX), highlight.regex_spans(text, O.DOC_REGEX_2))
    return exploded(L.doc_lines(spark, sf_dir), highlight.merge_spans(both))


# --- order ---------------------------------------------------------------------------

def result_view(spark, sf_dir):
    return ordering.result_view(app_results(spark, sf_dir))


def sorted_by(by: str | None, descending: bool = False):
    def query(spark, sf_dir):
        entries = app_results(spark, sf_dir)
        # The table has one order for all sources; the default order goes file by file.
        keep = ["line_id", "block"] + (["path"] if by is None else [])
        entries = durable(entries.select(*keep, "ts", "level", "level_ord", "message", "source"))
        return ordering.with_position(ordering.sort_entries(entries, by, descending)).select(
            "position", "line_id", "ts", "level", "message", "source")
    return query


# --- files ---------------------------------------------------------------------------

def written(spark: SparkSession, lines: DataFrame) -> str:
    folder = scratch_dir(spark)
    lines.select("value").write.text(folder)
    return folder


def written_logs(spark: SparkSession, lines: DataFrame, order: str) -> str:
    """Lines in order over a few files ``log-<n>.log``: names that other folders have as well, and no year."""
    folder = scratch_dir(spark)
    lines.repartitionByRange(4, order).sortWithinPartitions(order).select("value").write.text(folder)
    place = spark._jvm.org.apache.hadoop.fs.Path
    system = place(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(f.getPath().getName() for f in system.listStatus(place(folder)) if f.getPath().getName().startswith("part-"))
    for n, name in enumerate(parts):
        system.rename(place(f"{folder}/{name}"), place(f"{folder}/log-{n}.log"))
    return folder


def request_order(spark, sf_dir):
    """Three folders with files of the same names, in an order that is not that of their paths."""
    lines = L.app_lines(spark, sf_dir)
    folders = [written_logs(spark, lines.filter(F.col("line_id") % 3 == k), "line_id") for k in range(3)]
    run = analyze(spark, AnalysisRequest([folders[2], folders[0], folders[1]], format="heuristic"))
    return ordering.with_position(run.sorted()).select("position", "ts", "level", "message")


def text_scan_roundtrip(spark, sf_dir):
    lines = L.app_lines(spark, sf_dir).unionByName(L.doc_lines(spark, sf_dir))
    return read_lines(spark, written(spark, lines)).groupBy("value").agg(F.count("*").alias("n"))


def file_analysis_levels(spark, sf_dir):
    return analyze(spark, AnalysisRequest(written(spark, L.app_lines(spark, sf_dir)))).by_level


def app_analysis(spark, sf_dir, **options):
    return analyze(spark, AnalysisRequest(format="heuristic", **options), L.app_lines(spark, sf_dir))


def export_csv(spark, sf_dir):
    folder = scratch_dir(spark)
    app_analysis(spark, sf_dir, export_format="csv", output_path=folder).export(by="timestamp")
    rows = exports.read_csv(spark, folder, place=True)
    return ordering.with_position(rows.orderBy("_file", "_block", "_line")).drop("_file", "_block", "_line")


def export_json(spark, sf_dir):
    folder = scratch_dir(spark)
    app_analysis(spark, sf_dir, export_format="json", output_path=folder).export()
    return spark.read.json(f"{folder}/entries", schema="timestamp string, level string, message string, source string")


def export_json_stats(spark, sf_dir):
    folder = scratch_dir(spark)
    cells = app_cells(spark, sf_dir)
    exports.stats_document(cells).write.json(folder)
    names = ("totalLines", "parsedLines", "unparsedLines", "filteredInCount")
    document = spark.read.json(folder, schema=", ".join(f"{n} bigint" for n in names)
                               + ", countsByLevel map<string,bigint>, countsByHourBucket map<string,bigint>")
    named = lambda column, prefix: F.transform_keys(column, lambda k, _: F.concat(F.lit(prefix), k))
    counters = F.create_map(*[c for n in names for c in (F.lit(n), F.col(n))])
    return document.select(F.explode(F.map_concat(
        counters, named("countsByLevel", "level "), named("countsByHourBucket", "hour "))).alias("name", "n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        level_counts, line_counters, hourly_counts, stats_grouping_sets, run_summary, level_series, parse_coverage,
        heuristic_parse_bracket, heuristic_parse_log4j, timestamp_validity, time_format_parse, syslog_parse,
        custom_regex_parse, default_preset_parse, format_detection, mixed_format_parse, format_report,
        registered_strategy, syslog_year_rollover, syslog_year_anchor_vote, syslog_year_precedence, relative_range,
        search_fuzzy_documents, highlight_regex, highlight_fuzzy, highlight_merge, result_view, text_scan_roundtrip,
        file_analysis_levels, request_order, syslog_year_explicit, syslog_year_of_file_time, search_message_fallback, export_csv, export_json, export_json_stats,
    ]
    found = {query.__name__: query for query in named}
    found |= {
        "time_range": passing(LogFilter(time_range=TimeRange.between("2024-01-05T06:00:00", "2024-01-11T18:30:00.250"))),
        "date_range": passing(LogFilter(time_range=TimeRange.days(date(2024, 1, 10), date(2024, 1, 12)))),
        "minute_range": passing(LogFilter(time_range=TimeRange.minutes(
            datetime(2024, 1, 10, 8, 15, 30), datetime(2024, 1, 12, 21, 40, 1)))),
        "level_threshold": passing(LogFilter(min_level="ERROR")),
        "search_regex": passing(LogFilter(search=r"user=1\d+ kind=(view|error)")),
        "search_posix_class": passing(LogFilter(search=r"kind=[[:word:]]{6}[[:space:]]")),
        "search_fuzzy": passing(LogFilter(search=O.FUZZY_SEARCH)),
        "exclude_regex": passing(LogFilter(exclude=r"worker-[0-3]|value=\d{4,}")),
        "exclude_terms": passing(LogFilter(exclude="KIND=view Corrupted")),
        "combined_filter": passing(COMBINED),
        "sort_by_time": sorted_by("timestamp"),
        "sort_by_level": sorted_by("level", descending=True),
        "sort_by_message": sorted_by("message"),
        "sort_by_source": sorted_by("source", descending=True),
        "input_order": sorted_by(None),
    }
    return found
