"""Years for syslog lines, which carry none.

Inside a file the year goes up by one wherever the month falls back by six or more from
one syslog line to the next. Finding those places needs the order of the lines, but not a
task per file, and one pass: a run of lines is summed up by its first month, its last month and the falls
inside it, and two runs that follow each other join to one, with one more fall where the last month of the
first lies six or more behind the first month of the second. Scan tasks sum up the blocks that they read;
what is left is one short row for each block and batch. The pass does so for both kinds of month a line can
have at once, as a whole syslog line and by its head alone, and keeps the rare lines with a full date.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from timberline.functions.text import MONTH_PATTERN, month_number
from timberline.plans import durable as tables

ROLLOVER_MONTHS = 6
# Lines of a chunk, as a power of two, where lines have to be joined with the year starts before them.
CHUNK_BITS = 10

YEAR_MIN, YEAR_MAX = 1000, 9999

# The head of a syslog line, and a full date inside one.
_CLOCK = r"\d{2}:\d{2}:\d{2}"
_PREFIX = rf"^({MONTH_PATTERN})\s+(\d{{1,2}})\s+({_CLOCK})\s+"
_ANCHOR = (
    rf"(?:Sun|Mon|Tue|Wed|Thu|Fri|Sat)\s+({MONTH_PATTERN})\s+(\d{{1,2}})\s+({_CLOCK})"
    r"(?:\s+[A-Z]{2,5})?\s+((?:19|20)\d{2})(?![A-Za-z0-9_])"
)
_CHUNK = ["path", "block", "chunk"]


# What a run of lines comes to, for each kind of month: ``_first`` and ``_last`` months, the id of the line of
# the first, and the ids of the lines at which a year starts inside it.
KINDS = ("line", "head")
_RUN = pa.schema([
    ("path", pa.string()), *[(n, pa.int64()) for n in ("block", "part", "first_id", "last_id", "lines")],
    *[f for k in KINDS for f in ((f"{k}_first", pa.int32()), (f"{k}_last", pa.int32()), (f"{k}_id", pa.int64()), (f"{k}_starts", pa.list_(pa.int64())))],
    ("dated", pa.list_(pa.struct([("line_id", pa.int64()), ("value", pa.string())]))),
])


class YearStarts(NamedTuple):
    """Written tables: ``starts`` (path, block, line_id), and ``blocks`` (path, block, first_id, last_id, lines)."""

    starts: DataFrame
    blocks: DataFrame


def prefix_month(text: Column) -> Column:
    """Month of a line that starts like syslog, host and process not required, else NULL."""
    return F.when(text.rlike(_PREFIX), month_number(F.left(text, F.lit(3))))


def file_name_year(source: Column) -> Column:
    """First 19xx or 20xx in a base name that is no part of a longer number, else NULL."""
    stem = F.regexp_replace(source, r"\.[^.]*$", "")
    year = F.regexp_extract(stem, r"(?:^|\D)((?:19|20)\d{2})(?:\D|$)", 1)
    return F.nullif(year, F.lit("")).cast("int")


def local_year(moment: Column, zone: str) -> Column:
    return F.year(F.convert_timezone(None, F.lit(zone), moment))


class _Side:
    """The months of one kind in the run that is being read."""

    def __init__(self, before: int):
        self.first, self.last, self.id, self.starts = 0, before, None, []

    def add(self, months: np.ndarray, ids: np.ndarray) -> None:
        counted = np.flatnonzero(months)
        if not len(counted):
            return
        months, ids = months[counted], ids[counted]
        if not self.first:
            self.first, self.id = int(months[0]), int(ids[0])
        falls = np.concatenate([[self.last], months[:-1]]) - months >= ROLLOVER_MONTHS
        self.starts += ids[falls].tolist()
        self.last = int(months[-1])


def _summed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ``path, block, line_id, line, head, dated``, whose rows come block by block in order.

    A block has one row for each batch that it reaches into; only the first one's first month counts as such.
    """
    place, part = None, 0
    before = [0, 0]
    for batch in batches:
        if not batch.num_rows:
            continue
        path, block = batch.column(0), batch.column(1)
        changed = np.ones(batch.num_rows, bool)
        if batch.num_rows > 1:
            same = pc.and_(pc.equal(path[1:], path[:-1]), pc.equal(block[1:], block[:-1]))
            changed[1:] = ~np.asarray(same.to_numpy(zero_copy_only=False), bool)
        ids = np.asarray(batch.column(2))
        months = [np.asarray(pc.fill_null(batch.column(3 + k), 0)) for k in range(2)]
        dated = np.flatnonzero(np.asarray(batch.column(5).is_valid().to_numpy(zero_copy_only=False)))
        begins = np.flatnonzero(changed)
        rows = []
        for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), batch.num_rows]):
            here = (path[begin].as_py(), block[begin].as_py())
            if here != place:
                place, part, before = here, 0, [0, 0]
            row = {"path": here[0], "block": here[1], "part": part, "first_id": int(ids[begin]), "last_id": int(ids[end - 1]), "lines": end - begin}
            for k, name in enumerate(KINDS):
                side = _Side(before[k])
                side.add(months[k][begin:end], ids[begin:end])
                row |= {f"{name}_first": side.first or None, f"{name}_last": side.last if side.first else None,
                        f"{name}_id": side.id, f"{name}_starts": side.starts}
                before[k] = side.last
            mine = dated[np.searchsorted(dated, begin):np.searchsorted(dated, end)]
            row["dated"] = [{"line_id": int(ids[i]), "value": batch.column(5)[int(i)].as_py()} for i in mine]
            rows.append(row)
            part += 1
        yield pa.RecordBatch.from_pylist(rows, _RUN)


def month_runs(lines: DataFrame, line: Column, head: Column, dated: Column, in_order: bool) -> DataFrame:
    """The written runs of ``lines``, from one pass over them.

    ``line`` and ``head`` are the months by the two kinds, NULL on lines that do not count, and ``dated`` is the
    text of a line with a full date. ``in_order`` says that every block lies in one split, in the order of
    its lines, as files do; the months of others are put in order first, without their texts.
    """
    narrow = lines.select("path", "block", "line_id", line.cast("int").alias("line"), head.cast("int").alias("head"), dated.alias("dated"))
    narrow = narrow.filter(F.coalesce("line", "head").isNotNull())
    if not in_order:
        narrow = narrow.repartition("path", "block").sortWithinPartitions("path", "block", "line_id")
    tables.importable(lines.sparkSession)
    return tables.durable(narrow.mapInArrow(_summed_up, from_arrow_schema(_RUN)))


def syslog_runs(lines: DataFrame, line: Column, in_order: bool) -> DataFrame:
    """The same for lines with a text: by the whole line, and by its head, with the lines that hold a full date."""
    value = F.col("value")
    return month_runs(lines, line, prefix_month(value), F.when(value.rlike(_PREFIX) & value.rlike(_ANCHOR), value), in_order)


def year_starts(runs: DataFrame, kind: str = "line") -> YearStarts:
    """The lines at which a new year begins, by one kind of month."""
    first, last, at = (F.col(f"{kind}_{x}") for x in ("first", "last", "id"))
    counted = F.when(first.isNotNull(), F.col("part"))
    blocks = runs.groupBy("path", "block").agg(
        F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sum("lines").alias("lines"),
        F.min_by(first, counted).alias("first"), F.min_by(at, counted).alias("id"), F.max_by(last, counted).alias("last"))
    inside = runs.select("path", "block", F.explode(f"{kind}_starts").alias("line_id"))
    # Blocks without months do not count.
    before = F.lag("last").over(Window.partitionBy("path").orderBy("block"))
    ends = blocks.filter(F.col("first").isNotNull()).withColumn("_before", before).filter(F.col("_before") - F.col("first") >= ROLLOVER_MONTHS)
    starts = inside.unionByName(ends.select("path", "block", F.col("id").alias("line_id")))
    return YearStarts(tables.durable(starts), tables.durable(blocks.select("path", "block", "first_id", "last_id", "lines")))


def _chunks(blocks: DataFrame) -> tuple[DataFrame, int]:
    """``path, block, chunk``: chunks of 2^bits ids, which hold about 1024 lines as the ids are spread, and the bits."""
    total = blocks.agg(F.sum("lines").alias("n"), F.sum((F.col("last_id") - F.col("first_id") + 1).cast("double")).alias("width")).first()
    bits = min(62, CHUNK_BITS + max(0, round(math.log2(total.width / total.n)))) if total.n else CHUNK_BITS
    chunk = F.explode(F.sequence(F.shiftright("first_id", bits), F.shiftright("last_id", bits)))
    return blocks.select("path", "block", chunk.alias("chunk")), bits


def count_year_starts(lines: DataFrame, found: YearStarts, limit: int | None = None) -> DataFrame:
    """``lines`` with ``rollovers``, the number of year starts of the file up to that line.

    Real files have few year starts, so their measured lists are broadcast, no line is moved, and
    each line is placed in its file's list by halving. Where they do not fit, each chunk gets the
    count before it and the starts inside it, and lines meet their chunk in a shuffle join.
    """
    starts, blocks = found
    place = F.struct(F.col("block"), F.col("line_id"))
    limit = tables.BROADCAST_BYTES if limit is None else limit
    if tables.measured_bytes(starts) <= limit:
        # The lists hold the measured rows, grouped: no larger than what was just checked.
        lists = starts.groupBy("path").agg(F.array_sort(F.collect_list(place)).alias("_starts"))
        halves = F.transform(F.sequence(F.floor(F.log2(F.size("_starts"))).cast("int"), F.lit(0), F.lit(-1)),
                             lambda k: F.call_function("shiftleft", F.lit(1), k))
        joined = lines.join(F.broadcast(lists.withColumn("_halves", halves)), "path", "left")

        def step(at: Column, width: Column) -> Column:
            further = at + width
            reached = (further <= F.size("_starts")) & (F.get("_starts", further - 1) <= place)
            return F.when(reached, further).otherwise(at)

        return joined.withColumn("rollovers", F.coalesce(
            F.aggregate("_halves", F.lit(0), step), F.lit(0))).drop("_starts", "_halves")

    chunks, bits = _chunks(blocks)
    inside = starts.withColumn("chunk", F.shiftright("line_id", bits)).groupBy(_CHUNK).agg(
        F.array_sort(F.collect_list("line_id")).alias("_starts"))
    own = chunks.join(inside, _CHUNK, "left").withColumn("_n", F.coalesce(F.size("_starts"), F.lit(0)))
    sums = own.groupBy("path", "block").agg(F.sum("_n").alias("_n"))
    ahead = lambda *group, by: F.coalesce(F.sum("_n").over(
        Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carry = sums.withColumn("_carry", ahead("path", by="block")).drop("_n")
    base = (
        own.withColumn("_inner", ahead("path", "block", by="chunk"))
        .join(carry, ["path", "block"])
        .select(*_CHUNK, (F.col("_carry") + F.col("_inner")).cast("int").alias("_base"), "_starts")
    )
    # Lines before the first month of a block or behind its last are not in the table: they do not get a year either.
    joined = lines.withColumn("chunk", F.shiftright("line_id", bits)).join(base, _CHUNK, "left")
    own_starts = F.coalesce(F.size(F.filter("_starts", lambda s: s <= F.col("line_id"))), F.lit(0))
    return joined.withColumn("rollovers", F.coalesce("_base", F.lit(0)) + own_starts).drop(
        "chunk", "_base", "_starts")


def anchor_votes(runs: DataFrame) -> DataFrame:
    """``path, year, votes``: first years suggested by full dates inside the lines.

    A date counts if its month, day and time repeat the head of its own line; what it
    suggests is its year less the year starts of the file up to that line.
    """
    dated = count_year_starts(runs.select("path", "block", F.explode("dated").alias("_d")).select("path", "block", "_d.*"), year_starts(runs, "head"))
    head = lambda n: F.regexp_extract("value", _PREFIX, n)
    found = lambda n: F.regexp_extract_all("value", F.lit(_ANCHOR), F.lit(n))
    dates = dated.select(
        "path", "rollovers", head(1).alias("_m"), head(2).cast("int").alias("_d"), head(3).alias("_t"),
        F.explode(F.arrays_zip(found(1).alias("m"), found(2).alias("d"), found(3).alias("t"),
                               found(4).alias("y"))).alias("a"),
    )
    year = F.col("a.y").cast("int") - F.col("rollovers")
    return (
        dates.filter((F.col("a.m") == F.col("_m")) & (F.col("a.d").cast("int") == F.col("_d"))
                     & (F.col("a.t") == F.col("_t")))
        .select("path", year.alias("year"))
        .filter(F.col("year").between(YEAR_MIN, YEAR_MAX))
        .groupBy("path", "year").agg(F.count("*").alias("votes"))
    )


def elect_year(votes: DataFrame) -> DataFrame:
    """``path, content_year``: most votes wins, on a tie the smallest year."""
    return votes.groupBy("path").agg(
        F.max_by("year", F.struct(F.col("votes"), -F.col("year"))).alias("content_year"))


def start_years(formats: DataFrame, explicit: int | None, zone: str, current_year: int,
                content: DataFrame | None = None) -> DataFrame:
    """``formats`` with ``start_year`` and ``year_origin``, in the order of trust:
    given by the caller, in the file name, found in the content, year of the file."""
    if content is None:
        formats = formats.withColumn("content_year", F.lit(None).cast("int"))
    else:
        formats = formats.join(content, "path", "left")
    named, found = file_name_year(F.col("source")), F.col("content_year")
    given = F.lit(explicit).cast("int")
    return formats.withColumns({
        "start_year": F.coalesce(given, named, found, local_year(F.col("file_mtime"), zone),
                                 F.lit(current_year)),
        "year_origin": F.when(given.isNotNull(), "explicit")
        .when(F.coalesce(named, found).isNotNull(), "auto").otherwise("mtime_estimate"),
    }).drop("content_year")
