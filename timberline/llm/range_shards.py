"""Shards of near equal bytes by sampled splitters.

Records get a sampled order of their keys: a size-weighted sample of the keys gives quantile boundaries,
records are range-partitioned by them, and ranges that turn out overfull get boundaries of their own
sample, until none is left. Exact byte sums of the ranges, then running sums within each, cut the order
into shards. Built-in functions only.

Null sizes count as zero. Null keys come first. Rows with equal keys are ordered by size; equal rows are
interchangeable. An empty table gives an empty result. The input is read several times and must give the
same rows each time, as a table does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.llm.common import whole_row

# Boundaries and draws are a fixed number, whatever the input: ranges per shard, and sampled keys per range.
RANGES_PER_SHARD = 8
SAMPLES_PER_RANGE = 64
# A range above so many times its share is divided again.
OVERFULL = 4
ROUNDS = 3


def _sampled_keys(rows: DataFrame, count: int) -> list:
    """About ``count`` keys, drawn with chances in proportion to size.

    A key is drawn if the hash of it, as a number between 0 and 1, is below its share of the draws.
    Equal keys are drawn together and count once, so tasks hand on no more than is drawn.
    """
    total = rows.agg(F.sum(F.greatest(F.col("_size"), F.lit(1)))).first()[0] or 1
    uniform = F.pmod(F.xxhash64("_key", F.lit(7)), F.lit(1 << 52)).cast("double") / float(1 << 52)
    chance = F.greatest(F.col("_size"), F.lit(1)) * (count / total)
    return [r[0] for r in rows.where(uniform < chance).select("_key").distinct().collect()]


def _order(key) -> tuple:
    return tuple((v is not None, v) for v in key)  # nulls first, as Spark sorts


def _quantiles(keys: list, count: int) -> list:
    """``count`` - 1 boundaries at equal steps of the sorted sample, each once."""
    order = sorted(keys, key=_order)
    return list(dict.fromkeys(order[len(order) * i // count] for i in range(1, count))) if order else []


def _place(boundaries: list, key: Column, key_type: T.StructType) -> Column:
    """Number of boundaries at or below the key, by binary search in a constant array."""
    if not boundaries:
        return F.lit(0)
    count = F.lit(len(boundaries))
    known = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, key_type.fields)])
                      for b in boundaries])

    def step(at: Column, width: Column) -> Column:
        further = at + width
        reached = (further <= count) & (F.get(known, F.least(further, count) - 1) <= key)
        return F.when(reached, further).otherwise(at)

    widths = F.array(*[F.lit(1 << s) for s in reversed(range(len(boundaries).bit_length()))])
    return F.aggregate(widths, F.lit(0), step)


def assign_shards(df: DataFrame, size: Column, key: Sequence[Column], shards: int,
                  ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (0, 1, ... within the shard).

    Shards are runs of the key order; shard s takes the records whose bytes begin within the s-th part of
    all bytes, so sizes differ by no more than a record at either end. The last key column should tell
    records apart: then a hot value of the others is divided like any range. Columns of ``df`` called
    shard or slot are replaced.
    """
    rows = df.select(
        whole_row(df.drop("shard", "slot")).alias("_row"),
        F.coalesce(size, F.lit(0)).cast("long").alias("_size"),
        F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)]).alias("_key"),
    )
    key_type = rows.schema["_key"].dataType
    n_ranges = shards * ranges_per_shard
    boundaries = _quantiles(_sampled_keys(rows, n_ranges * SAMPLES_PER_RANGE), n_ranges)
    for left in reversed(range(ROUNDS)):
        ranged = rows.withColumn("_range", _place(boundaries, F.col("_key"), key_type))
        sums = ranged.groupBy("_range").agg(
            F.sum("_size").alias("b"), F.count("*").alias("n"), F.min("_key").alias("lo"), F.max("_key").alias("hi"),
        ).orderBy("_range").collect()
        total = sum(r.b for r in sums)
        # Equal keys can't be told apart by any boundary: such a range stays as it is.
        full = {r._range: r.b for r in sums if r.b > OVERFULL * total / n_ranges and r.lo != r.hi}
        if not full or not left:
            break
        parts = sum(-(-b * n_ranges // total) for b in full.values())
        again = ranged.where(F.col("_range").isin(list(full)))
        more = _quantiles(_sampled_keys(again, parts * SAMPLES_PER_RANGE), 2 * parts)
        boundaries = sorted({*boundaries, *more}, key=_order)
    if not sums:
        return _bare(rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}))
    starts, ranks, at, count = [], [], 0, 0
    for r in sums:
        starts += [F.lit(r._range), F.lit(at).cast("long")]
        ranks += [F.lit(r._range), F.lit(count).cast("long")]
        at, count = at + r.b, count + r.n
    within = Window.partitionBy("_range").orderBy("_key", "_size")
    before = F.coalesce(F.sum("_size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumns({
        "_begin": before + F.element_at(F.create_map(*starts), F.col("_range")),
        "_rank": F.row_number().over(within) - 1 + F.element_at(F.create_map(*ranks), F.col("_range")),
    }).withColumn("shard", F.least(F.expr(f"_begin * {shards} div {max(total, 1)}"), F.lit(shards - 1)).cast("int"))
    # One row per shard: the place of its first record in the whole order.
    firsts = placed.groupBy("shard").agg(F.min("_rank").alias("first")).collect()
    first = F.create_map(*[F.lit(v) for r in firsts for v in (r.shard, r.first)])
    return _bare(placed.withColumn("slot", (F.col("_rank") - F.element_at(first, F.col("shard"))).cast("long")))


def _bare(rows: DataFrame) -> DataFrame:
    return rows.select("_row.*", "shard", "slot")
