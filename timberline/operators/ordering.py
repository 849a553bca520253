"""Order of a result, and its projection for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.timestamps import display_text
from timberline.plans.durable import durable

SORT_COLUMNS = ("timestamp", "level", "message", "source")
# Locale-aware text order; UTF8_BINARY compares bytes.
DEFAULT_COLLATION = "UNICODE"

INPUT_ORDER = ("file_idx", "path", "block", "line_id")


def input_order(df: DataFrame) -> list[Column]:
    """Files as requested, lines as they stand in them."""
    return [F.col(c) for c in INPUT_ORDER if c in df.columns]


def sort_keys(df: DataFrame, by: str | None = None, descending: bool = False,
              collation: str = DEFAULT_COLLATION) -> list[Column]:
    """Keys of a stable sort: ties keep the input order, in both directions.

    The input order also splits a key that many rows share over several sort tasks.
    """
    if by is None:
        return input_order(df)
    if by not in SORT_COLUMNS:
        raise ValueError(f"cannot sort by '{by}', one of {', '.join(SORT_COLUMNS)}")
    key = {
        "timestamp": lambda: F.col("ts"),
        "level": lambda: F.col("level_ord"),
        "message": lambda: F.collate(F.col("message"), collation),
        "source": lambda: F.collate(F.col("source"), collation),
    }[by]()
    return [key.desc() if descending else key.asc(), *input_order(df)]


def sort_entries(df: DataFrame, by: str | None = None, descending: bool = False,
                 collation: str = DEFAULT_COLLATION) -> DataFrame:
    """A range-partitioned global sort."""
    return df.orderBy(*sort_keys(df, by, descending, collation))


def with_position(sorted_df: DataFrame, name: str = "position") -> DataFrame:
    """A sorted frame with row numbers from 1, without a window over all rows.

    The rows are written as sorted, each with its partition and its place in it. What is then
    added up is one count per partition.
    """
    rows = durable(sorted_df.withColumns({
        "_part": F.spark_partition_id(),
        "_place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1),
    }))
    ahead = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(ahead, F.lit(0)).alias("_offset"))
    # One row per sort partition: bounded by the number of shuffle partitions.
    return rows.join(F.broadcast(offsets), "_part").withColumn(
        name, F.col("_offset") + F.col("_place") + 1).drop("_part", "_place", "_offset")


def result_view(entries: DataFrame) -> DataFrame:
    """What a result table shows: time with milliseconds, level, message, source, raw line."""
    return entries.select(
        display_text(F.col("ts")).alias("timestamp"), "level", "message", "source",
        F.col("raw_line").alias("detail"))
