"""CSV and JSON exports of a result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.timestamps import iso_text
from timberline.operators import stats

EXPORT_FORMATS = ("csv", "json")

# The header line, with its byte order mark and blanks, cut at the separators.
_CSV_HEADER = ("\ufefftimestamp", " level", " message", " source ")


def export_rows(entries: DataFrame) -> DataFrame:
    """``timestamp, level, message, source``; times without milliseconds."""
    return entries.select(iso_text(F.col("ts")).alias("timestamp"), "level", "message", "source")


def export_format(path: str, name: str | None = None) -> str:
    """The format asked for, or the one the file extension tells, CSV unless it is .json."""
    if name is None:
        return "json" if path.lower().endswith(".json") else "csv"
    if name.lower() not in EXPORT_FORMATS:
        raise ValueError(f"unknown export format '{name}', one of {', '.join(EXPORT_FORMATS)}")
    return name.lower()


def write_csv(entries: DataFrame, path: str) -> None:
    """Semicolon-separated parts under ``path``, each with the header, in the order of the rows."""
    export_rows(entries).toDF(*_CSV_HEADER).write.mode("overwrite").csv(
        path, sep=";", header=True, quote='"', escape='"', emptyValue="", nullValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, encoding="UTF-8")


def read_csv(spark, path: str, place: bool = False) -> DataFrame:
    """An export read back; ``place`` adds the columns ``_file, _block, _line`` that order the rows as written."""
    rows = spark.read.csv(
        path, schema="timestamp string, level string, message string, source string", sep=";",
        header=True, quote='"', escape='"', multiLine=False, enforceSchema=True,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    if place:
        rows = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                           F.monotonically_increasing_id().alias("_line"))
    return rows.na.fill("")


def stats_document(cells: DataFrame) -> DataFrame:
    """The counters as one nested row, levels and hours as maps."""
    by_level = stats.counts_by_level(cells)
    by_hour = stats.counts_by_hour(cells)
    # Seven levels and the hours of the time span: the maps are small by nature.
    as_map = lambda df, key: df.agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(F.col(key), F.col("n"))))).alias("m"))
    one = F.lit(1).alias("_one")
    counters = stats.line_counters(cells).select(
        F.col("total_lines").alias("totalLines"), F.col("parsed_lines").alias("parsedLines"),
        F.col("unparsed_lines").alias("unparsedLines"), F.col("filtered_in").alias("filteredInCount"), one)
    levels = as_map(by_level, "level").select(F.col("m").alias("countsByLevel"), one)
    hours = as_map(by_hour, "hour_bucket").select(F.col("m").alias("countsByHourBucket"), one)
    return counters.join(levels, "_one").join(hours, "_one").drop("_one")


def counter_rows(cells: DataFrame) -> DataFrame:
    """The counters as rows ``kind, key, n``: however many hours there are, no row grows."""
    total = stats.line_counters(cells).unpivot(
        [], ["total_lines", "parsed_lines", "unparsed_lines", "filtered_in"], "key", "n")
    return (total.select(F.lit("lines").alias("kind"), "key", "n")
            .unionByName(stats.counts_by_level(cells).select(F.lit("level").alias("kind"), F.col("level").alias("key"), "n"))
            .unionByName(stats.counts_by_hour(cells).select(F.lit("hour").alias("kind"), F.col("hour_bucket").alias("key"), "n")))


def write_json(entries: DataFrame, cells: DataFrame, path: str) -> None:
    """``entries/`` as JSON lines in the order of the rows, ``counters/`` as rows of counters.

    ``stats/`` has the counters as one JSON object, a view for readers that expect it: its map of
    hours is as long as the time span of the result.
    """
    export_rows(entries).write.mode("overwrite").json(f"{path}/entries", ignoreNullFields=False)
    counter_rows(cells).write.mode("overwrite").json(f"{path}/counters")
    stats_document(cells).coalesce(1).write.mode("overwrite").json(f"{path}/stats")


def export(entries: DataFrame, cells: DataFrame, path: str, name: str | None = None) -> str:
    """Write a result; an earlier export under ``path`` is replaced. Returns the format."""
    chosen = export_format(path, name)
    if chosen == "json":
        write_json(entries, cells, path)
    else:
        write_csv(entries, path)
    return chosen
