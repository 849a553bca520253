"""A whole run: request in, lazy result frames out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date
from functools import cached_property, reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from timberline.functions.timestamps import DEFAULT_FORMAT, TimeFormat
from timberline.operators import detection, highlight, ordering, stats, structuring, years
from timberline.operators.filters import LogFilter
from timberline.operators.structuring import HEURISTIC, SYSLOG, Strategy
from timberline.plans.durable import durable, lookup_join
from timberline.sinks import exports
from timberline.sources.text_lines import base_name, file_head_sample, file_order, input_files, read_lines, with_file_order


@dataclass(frozen=True)
class AnalysisRequest:
    """What to read and how. Everything that can be wrong is rejected here or by ``Analysis``,
    before any line is read."""

    paths: str | Sequence[str] = ()
    filter: LogFilter = field(default_factory=LogFilter)
    # None detects the format of each file, which costs one extra pass over the input.
    format: str | None = None
    line_pattern: str = ""
    timestamp_format: str = DEFAULT_FORMAT
    syslog_year: int | None = None
    local_zone: str = "UTC"
    lenient_timestamps: bool = False
    # Further strategies that take part in detection, after the built-in ones.
    strategies: Sequence[Strategy] = ()
    collation: str = ordering.DEFAULT_COLLATION
    export_format: str | None = None
    output_path: str | None = None
    current_year: int = field(default_factory=lambda: date.today().year)

    def __post_init__(self):
        if self.syslog_year is not None and not years.YEAR_MIN <= self.syslog_year <= years.YEAR_MAX:
            raise ValueError(f"the syslog year must lie in {years.YEAR_MIN}..{years.YEAR_MAX}")
        if (self.export_format is None) != (self.output_path is None):
            raise ValueError("an export needs both a format and an output path")
        if self.export_format is not None:
            exports.export_format(self.output_path, self.export_format)
        TimeFormat.of(self.timestamp_format)
        known = {HEURISTIC, SYSLOG, *(s.name for s in self.strategies)}
        if len(known) != 2 + len(self.strategies):
            raise ValueError("strategy names must differ from each other and from the built-in ones")
        if self.format is not None and self.format not in known:
            raise ValueError(f"unknown format '{self.format}', one of {', '.join(sorted(known))}")

    @property
    def path_list(self) -> list[str]:
        return [self.paths] if isinstance(self.paths, str) else list(self.paths)


class Analysis:
    """Lazy results of a request over text files, or over ``lines`` made from a table.

    Per-file decisions and the counter table are written once and shared by everything that
    needs them; entries are never collected or cached.
    """

    def __init__(self, spark: SparkSession, request: AnalysisRequest, lines: DataFrame | None = None):
        self.spark, self.request = spark, request
        self._from_files = lines is None
        request.filter.check(spark)
        self._custom = (structuring.custom(spark, request.line_pattern, request.timestamp_format)
                        if request.line_pattern else None)
        self._given = lines

    @cached_property
    def lines(self) -> DataFrame:
        return read_lines(self.spark, self.request.path_list) if self._from_files else self._given

    @cached_property
    def _strategies(self) -> list[Strategy]:
        if self._custom:
            return [self._custom]
        r = self.request
        found = [structuring.heuristic(r.lenient_timestamps), structuring.syslog(F.col("_year")),
                 *r.strategies]
        return [s for s in found if r.format in (None, s.name)]

    @cached_property
    def _files(self) -> DataFrame:
        """One row per input file. Only names and file status are read, not content."""
        if not self._from_files:
            return self.lines.groupBy("path", "source").agg(F.max("file_mtime").alias("file_mtime"))
        return input_files(self.spark, self.request.path_list).select(
            "path", "file_mtime", base_name(F.substring_index("path", "/", -1)).alias("source"))

    @cached_property
    def _detected(self) -> DataFrame:
        """Written: ``path, source, file_mtime, format, detected`` of each file."""
        r, strategies = self.request, self._strategies
        if len(strategies) == 1:
            only = F.lit(strategies[0].name)
            table = self._files.withColumns({"format": only, "detected": only})
        else:
            found = (detection.detect_from_sample(
                file_head_sample(self.spark, r.path_list, detection.SAMPLE_LINES), strategies)
                if self._from_files else detection.detect_formats(self.lines, strategies))
            if self._from_files:
                # A file without lines has no sample and is reported as unknown.
                found = self._files.join(found.select("path", "format", "detected"), "path", "left")
            table = found.withColumns({
                "format": F.coalesce("format", F.lit(detection.default_format(strategies))),
                "detected": F.coalesce("detected", F.lit(detection.UNKNOWN_FORMAT)),
            })
        return durable(table.select("path", "source", "file_mtime", "format", "detected"))

    @cached_property
    def formats(self) -> DataFrame:
        """One row per file: ``path, source, format, detected, label, start_year, year_origin``."""
        r, strategies, table = self.request, self._strategies, self._detected
        dated = years.start_years(table, r.syslog_year, r.local_zone, r.current_year, self._content_years)
        is_syslog = F.col("format") == SYSLOG
        return durable(dated.select(
            "path", "source", "format", "detected",
            detection.format_label(F.col("detected"), strategies).alias("label"),
            F.when(is_syslog, F.col("start_year")).alias("start_year"),
            F.when(is_syslog, F.col("year_origin")).alias("year_origin"),
        ))

    def _lines_of(self, files: DataFrame) -> DataFrame:
        """Lines of the files of a written table, with its other columns."""
        if self._from_files:
            return read_lines(self.spark, self.request.path_list, only=files)
        return lookup_join(self.lines, files, ["path"], how="inner")

    @cached_property
    def _runs(self) -> DataFrame | None:
        """The month runs of all syslog files, from the one pass that their years take; None without such files."""
        files = durable(self._detected.filter(F.col("format") == SYSLOG).select("path"))
        if files.isEmpty():
            return None
        return years.syslog_runs(self._lines_of(files), structuring.syslog_month(F.col("value")), self._from_files)

    @property
    def _content_years(self) -> DataFrame | None:
        """Start years voted for by the content, for the syslog files nothing else decides."""
        if self.request.syslog_year is not None or SYSLOG not in {s.name for s in self._strategies}:
            return None
        unnamed = self._detected.filter((F.col("format") == SYSLOG) & years.file_name_year(F.col("source")).isNull())
        if unnamed.isEmpty():
            return None
        return years.elect_year(years.anchor_votes(self._runs))

    @cached_property
    def _groups(self) -> list[tuple[DataFrame, list[Strategy]]]:
        """Lines with the strategies they need, and with format and year where those need it.

        Files make one group per format, each a scan of its own files, so that a strategy touches no
        others. Lines from a table make one group in which each line looks up its format.
        """
        strategies = self._strategies
        if len(strategies) == 1 and strategies[0].name != SYSLOG:
            return [(self.lines, strategies)]
        files = self.formats.select("path", "format", "start_year")
        used = {r.format for r in files.select("format").distinct().collect()}
        if self._from_files:
            groups = []
            for s in strategies:
                if s.name in used:
                    lines = self._lines_of(durable(files.filter(F.col("format") == s.name)))
                    groups.append((self._with_years(lines) if s.name == SYSLOG else lines, [s]))
            # Without any file there is still a frame of the right columns.
            return groups or [(self.lines, strategies[:1])]
        default = detection.default_format(strategies)
        # Most files have the default format: only the others are looked up.
        others = files.filter((F.col("format") != default) | (F.col("format") == SYSLOG))
        lines = lookup_join(self.lines, others, ["path"]).withColumn("format", F.coalesce("format", F.lit(default)))
        strategies = [s for s in strategies if s.name in used] or strategies[:1]
        return [(self._with_years(lines) if SYSLOG in used else lines, strategies)]

    def _structured(self, keep: LogFilter | None, counts: Sequence[Observation | None] | None = None) -> DataFrame:
        parts = [structuring.structure(lines, strategies, keep=keep, count=count)
                 .drop("_year", "start_year", "rollovers", "value")
                 for (lines, strategies), count in zip(self._groups, counts or [None] * len(self._groups))]
        entries = reduce(DataFrame.unionByName, parts)
        if self._from_files:
            entries = with_file_order(entries, self._file_order)
        return entries

    @cached_property
    def _file_order(self) -> DataFrame | None:
        return file_order(self.spark, self.request.path_list)

    @cached_property
    def entries(self) -> DataFrame:
        """Every line with its structure and ``passed``; unparsed lines have ``is_valid = false``."""
        return self._structured(None).withColumn("passed", self.request.filter.predicate(message=None))

    def _with_years(self, tagged: DataFrame) -> DataFrame:
        if self._runs is None:
            return tagged.withColumn("_year", F.col("start_year"))
        counted = years.count_year_starts(tagged, years.year_starts(self._runs))
        return counted.withColumn("_year", F.col("start_year") + F.col("rollovers"))

    @property
    def results(self) -> DataFrame:
        """Entries that pass the filter; conditions are applied while lines are structured."""
        return self._structured(self.request.filter)

    @cached_property
    def _kept(self) -> DataFrame:
        """Results written once, as input of sorts.

        A range sort reads its input twice, first to find the ranges; lines would be
        structured twice.
        """
        return durable(self.results)

    def _export_input(self, by: str | None) -> tuple[DataFrame, DataFrame]:
        """What an export needs of the results, written in one pass, and the counters of that pass.

        All lines are counted on the way, before any condition; level and hour are counted from
        the written rows.
        """
        counts = [Observation() for _ in self._groups]
        results = self._structured(self.request.filter, counts)
        keys = {"ts", "level", "level_ord", "message", "source", *ordering.INPUT_ORDER}
        rows = durable(results.select(*[c for c in results.columns if c in keys]))
        total = sum(c.get["total"] for c in counts)
        parsed = sum(c.get["parsed"] for c in counts)
        passed = rows.withColumns({"is_valid": F.lit(True), "passed": F.lit(True)})
        cells = durable(stats.count_cells(passed))
        kept = cells.agg(F.sum("n")).first()[0] or 0
        others = self.spark.createDataFrame(
            [(False, False, total - parsed), (True, False, parsed - kept)], "is_valid boolean, passed boolean, n bigint")
        return rows, cells.unionByName(others.filter("n > 0"), allowMissingColumns=True)

    @cached_property
    def cells(self) -> DataFrame:
        """The counter table, from one pass over the entries."""
        return durable(stats.count_cells(self.entries, keys=("path", "source", "format")))

    @property
    def counters(self) -> DataFrame:
        return stats.line_counters(self.cells)

    @property
    def by_level(self) -> DataFrame:
        return stats.counts_by_level(self.cells)

    @property
    def by_hour(self) -> DataFrame:
        return stats.counts_by_hour(self.cells)

    @property
    def level_series(self) -> DataFrame:
        return stats.level_series(self.cells)

    @property
    def coverage(self) -> DataFrame:
        return stats.parse_coverage(self.cells)

    @property
    def summary(self) -> DataFrame:
        time_range = self.request.filter.time_range
        names = dict.fromkeys(["heuristic", "syslog", "custom", *(s.name for s in self._strategies)])
        return stats.run_summary(self.cells, self.formats, time_range is not None, tuple(names))

    def sorted(self, by: str | None = None, descending: bool = False) -> DataFrame:
        """Results in input order, or stably sorted by a column of the view."""
        return ordering.sort_entries(self._kept, by, descending, self.request.collation)

    def view(self, by: str | None = None, descending: bool = False) -> DataFrame:
        return ordering.result_view(self.sorted(by, descending))

    def highlighted(self) -> DataFrame:
        """Results with the spans of the search text in the message."""
        spans = highlight.highlight_spans(self.spark, F.col("message"), self.request.filter.search)
        return self.results.withColumn("spans", spans)

    def export(self, by: str | None = None, descending: bool = False,
               path: str | None = None, name: str | None = None, ordered: bool = True) -> str:
        """Write the results in the given order, to the path of the request unless another is given.

        With ``ordered=False`` they are written as the scan brings them, without moving any.
        """
        path, name = path or self.request.output_path, name or self.request.export_format
        if path is None:
            raise ValueError("an export needs an output path")
        name = exports.export_format(path, name)
        rows, cells = self._export_input(by)
        if ordered:
            rows = ordering.sort_entries(rows, by, descending, self.request.collation)
        return exports.export(rows, cells, path, name)


def analyze(spark: SparkSession, request: AnalysisRequest, lines: DataFrame | None = None) -> Analysis:
    """Check a request and plan its results; no line is read until a result is used."""
    return Analysis(spark, request, lines)
