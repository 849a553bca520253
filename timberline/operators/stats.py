"""Counters of a run, all derived from one small table.

``count_cells`` reads the entries once and leaves one row per validity, pass, level and
hour. Every report is a sum over those rows, so the data is not expanded per grouping set
and not read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions import levels


def count_cells(entries: DataFrame, passed: Column | str = "passed", keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, is_valid, passed, level_ord, hour_bucket, n``; level and hour only where passed."""
    ok = F.col(passed) if isinstance(passed, str) else passed
    entries = entries.withColumn("_passed", ok)
    ok = F.col("_passed")
    # Day and hour group faster than text; the text is built once per cell.
    cells = entries.groupBy(
        *keys, "is_valid", ok.alias("passed"),
        F.when(ok, F.col("level_ord")).alias("level_ord"),
        F.when(ok, F.to_date("ts")).alias("_day"), F.when(ok, F.hour("ts")).alias("_hour"),
    ).agg(F.count("*").alias("n"))
    bucket = F.concat(F.col("_day").cast("string"), F.lit(" "),
                      F.lpad(F.col("_hour").cast("string"), 2, "0"), F.lit(":00"))
    return cells.withColumn("hour_bucket", bucket).drop("_day", "_hour")


def line_counters(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    n = F.col("n")
    part = lambda test: F.coalesce(F.sum(F.when(test, n)), F.lit(0))
    return cells.groupBy(*keys).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total_lines"),
        part(F.col("is_valid")).alias("parsed_lines"),
        part(~F.col("is_valid")).alias("unparsed_lines"),
        part(F.col("passed")).alias("filtered_in"),
    )


def counts_by_level(cells: DataFrame) -> DataFrame:
    """Levels present among the entries that passed, least severe first."""
    return (
        cells.filter("passed").groupBy("level_ord").agg(F.sum("n").alias("n"))
        .select(levels.level_name(F.col("level_ord")).alias("level"), "level_ord", "n")
        .orderBy("level_ord")
    )


def counts_by_hour(cells: DataFrame) -> DataFrame:
    """Hours present among the entries that passed, in order."""
    return cells.filter("passed").groupBy("hour_bucket").agg(F.sum("n").alias("n")).orderBy("hour_bucket")


def level_series(cells: DataFrame) -> DataFrame:
    """Category and value of a bar per level."""
    return counts_by_level(cells).select(F.col("level").alias("category"), F.col("n").alias("value"))


def all_groupings(cells: DataFrame) -> DataFrame:
    """Counters, levels and hours in one frame: ``grouping, key, n``."""
    name = levels.level_name(F.col("level_ord"))
    passed = F.col("passed")
    sets = (
        cells.groupingSets(
            [[F.col("is_valid")], [passed, F.col("level_ord")], [passed, F.col("hour_bucket")], []],
            F.col("is_valid"), passed, F.col("level_ord"), F.col("hour_bucket"))
        .agg(F.sum("n").alias("n"), F.grouping_id().alias("_set"))
    )
    # Bits of the grouping id: is_valid 8, passed 4, level 2, hour 1; a set bit is grouped away.
    kind = F.col("_set")
    return sets.filter((kind.isin(7, 15)) | passed).select(
        F.when(kind == 15, "total").when(kind == 7, "validity").when(kind == 9, "level")
        .otherwise("hour").alias("grouping"),
        F.when(kind == 7, F.when(F.col("is_valid"), "parsed").otherwise("unparsed"))
        .when(kind == 9, name).when(kind == 10, F.col("hour_bucket")).otherwise("").alias("key"),
        "n",
    )


def run_summary(cells: DataFrame, formats: DataFrame, range_on: bool,
                names: Sequence[str] = ("heuristic", "syslog", "custom")) -> DataFrame:
    """One row: results, files, lines, unparsed lines, files per format, and whether the time
    range left nothing. ``names`` are the formats that take part, registered ones too; each has
    a column, and so has unknown."""
    counters = line_counters(cells)
    files = formats.groupBy().agg(
        F.count("*").alias("file_count"),
        *[F.count_if(F.col("detected") == d).alias(f"{d}_files") for d in (*names, "unknown")],
    )
    # Both sides are a global aggregate: exactly one row each.
    return counters.select(
        F.col("filtered_in").alias("result_count"), "total_lines", "unparsed_lines",
        ((F.col("filtered_in") == 0) & F.lit(range_on) & (F.col("total_lines") > 0)).alias("range_is_empty"),
    ).withColumn("_one", F.lit(1)).join(F.broadcast(files.withColumn("_one", F.lit(1))), "_one").drop("_one")


def parse_coverage(cells: DataFrame, keys: tuple[str, ...] = ("source", "format")) -> DataFrame:
    """Lines and parsed lines per file."""
    return line_counters(cells, keys).select(*keys, "total_lines", "parsed_lines")
