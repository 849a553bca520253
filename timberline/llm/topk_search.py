"""Exact top-k inner products of whole-number vectors, by length and rotated partial sums.

Vectors are cut to whole numbers, floor(scale * x). Candidates are sorted by descending length into lanes of
bounded size, queries are put into blocks, and a job unit is one query block against one lane. A unit walks
its lane from the longest vector on and stops where |q| |c| falls below the query's k-th best score. Before
that, queries and candidates are compared in a basis rotated by the singular vectors of all candidates: the
inner product of the leading coordinates plus the product of the remaining lengths bounds the whole one
(Cauchy and Schwarz), and only pairs whose bound reaches the k-th best score are multiplied out, exactly. The
k-th best score starts from a fixed number of longest candidates, so that most lanes that can't matter
are never met.

Lanes and blocks are bounded, so is every unit; pairs of numbers of lanes and blocks are joined, never rows. The units of
a block are dealt to chains, and a chain hands its bounds on from lane to lane.
Equal vectors: k + 1 of the smallest ids stand for all as candidates, since no more can be in a result,
and as queries they are searched once.

Rows with a null key take no part, nor do vectors that are null or hold null or non-finite components, nor
those whose length squared reaches 2^62, whose scores would not fit. A key that occurs more than once counts
once, with the smallest of its vectors. Shorter vectors count as followed by zeros; empty ones score zero.
Columns other than key and vector are not used, whatever their names. No rows give no results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import join_counted, written

# Most bytes of vectors, as eight-byte numbers, in a lane or a block. Small tables are cut finer, into
# about SPLIT lanes of at least LEAST_ROWS vectors, so that all tasks have work.
LANE_BYTES = 4 << 20
LEAST_ROWS = 512
SPLIT = 32
# A block meets the lanes in chains, each of which goes on from the bounds of its last lane: at least so many
# chains, and more of them from so many lanes a chain on.
CHAINS = 16
LANES_A_CHAIN = 64
# Candidates looked at in one step of a lane, and longest ones that give the first bounds.
STEP = 512
HEAD = 1024
# Share of the squared length that the leading coordinates hold.
LEADING_SHARE = 0.8
# Relative slack of bounds in floating point; products are exact.
SLACK = 1e-9
_EXACT = 2.0**53
_TOO_LONG = 2.0**62
_KINDS = [("tinyint", 2**7, np.int8), ("smallint", 2**15, np.int16), ("int", 2**31, np.int32), ("bigint", 2**63, np.int64)]


def whole_vectors(df: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(id, v, norm2): one row per key, its whole-number vector and the square of its length."""
    x = F.col("v")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = (df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & x.isNotNull()).where(usable))
    # Cut as doubles, which hold whole numbers of any size; longs only once the length is known to be small enough.
    rows = rows.withColumn("v", F.transform(x, lambda c: F.floor(F.when(F.abs(c * scale) < 2.0**40, c * scale).otherwise(2.0**40))))
    rows = rows.withColumn("norm2", F.aggregate(x, F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    return rows.where(F.col("norm2") < _TOO_LONG).groupBy("id").agg(F.min(F.struct("v", "norm2")).alias("r")).select("id", "r.v", "r.norm2")


def matrix(column: pa.Array, dims: int, kind) -> np.ndarray:
    """Lists of numbers as rows of a matrix, shorter ones filled with zeros."""
    lengths = np.asarray(column.value_lengths())
    values = np.asarray(column.flatten())
    if len(lengths) and (lengths == dims).all():
        return values.reshape(len(lengths), dims).astype(kind)
    out = np.zeros((len(lengths), dims), kind)
    starts = np.cumsum(lengths) - lengths
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(values)) - np.repeat(starts, lengths)] = values
    return out


def leading_basis(candidates: DataFrame, dims: int) -> tuple[np.ndarray, int]:
    """The right singular vectors of all candidates, largest first, and how many of them lead.

    Tasks sum products of coordinates; what reaches the driver is one matrix of dims x dims.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            part = matrix(batch.column(0), dims, np.float64)
            total += part.T @ part
        i, j = np.triu_indices(dims)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "s"])

    sums = candidates.select("v").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    gram = np.zeros((dims, dims))
    i, j, s = (np.asarray(sums.column(c)) for c in ("i", "j", "s"))
    gram[i, j] = gram[j, i] = s
    values, vectors = np.linalg.eigh(gram)
    values, vectors = np.maximum(values[::-1], 0), np.ascontiguousarray(vectors[:, ::-1])
    share = np.cumsum(values) / max(values.sum(), 1e-300)
    return vectors, min(dims, int(np.searchsorted(share, LEADING_SHARE)) + 1)


class Best:
    """The k best (score, id) of each query so far: larger scores first, then smaller ids."""

    def __init__(self, k: int, bounds: np.ndarray):
        self.k, self.bounds = k, bounds.copy()
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        place = np.arange(len(query)) - np.repeat(first, np.diff(first, append=len(query)))
        full = place == self.k - 1
        self.bounds[query[full]] = np.maximum(self.bounds[query[full]], score[full])
        kept = place < self.k
        self.query, self.score, self.id = query[kept], score[kept], ids[kept]


def _products(q: np.ndarray, c: np.ndarray, rows: np.ndarray, columns: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of the pairs (rows, columns); whole numbers, exact."""
    if exact and 4 * len(rows) >= len(q) * len(c):
        return (q @ c.T)[rows, columns].astype(np.int64)
    out = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), 65536):
        part = slice(at, at + 65536)
        a, b = q[rows[part]], c[columns[part]]
        if not exact:  # beyond what doubles hold
            a, b = a.astype(np.int64), b.astype(np.int64)
        out[part] = np.einsum("ij,ij->i", a, b)
    return out


def search(q: np.ndarray, c: np.ndarray, ids: np.ndarray, best: Best, basis: np.ndarray, lead: int) -> Best:
    """``best`` with the candidates ``c``, sorted by descending length, that are no worse than a query's bound."""
    real_q, real_c = q.astype(np.float64), c.astype(np.float64)
    norm_q, norm_c = np.sqrt((real_q**2).sum(1)), np.sqrt((real_c**2).sum(1))
    exact = max(norm_q.max(initial=0), norm_c.max(initial=0)) ** 2 < _EXACT
    head_q, head_c = real_q @ basis[:, :lead], real_c @ basis[:, :lead]
    rest_q = np.sqrt(np.maximum(norm_q**2 - (head_q**2).sum(1), 0) + SLACK * norm_q**2)
    rest_c = np.sqrt(np.maximum(norm_c**2 - (head_c**2).sum(1), 0) + SLACK * norm_c**2)
    for at in range(0, len(c), STEP):
        part = slice(at, at + STEP)
        live = np.flatnonzero(norm_q * norm_c[at] * (1 + SLACK) >= best.bounds)
        if not len(live):
            break  # and so are all shorter candidates
        most = head_q[live] @ head_c[part].T + rest_q[live, None] * rest_c[None, part]
        most += SLACK * norm_q[live, None] * norm_c[None, part]
        rows, columns = np.nonzero(most >= best.bounds[live, None])
        if not len(rows):
            continue
        given = (real_q[live], real_c[part]) if exact else (q[live], c[part])
        score = _products(*given, rows, columns, exact)
        good = score >= best.bounds[live[rows]]
        best.add(live[rows[good]], score[good], ids[part][columns[good]])
    return best


def _packed(rows: int, dims: int, kind, make: Callable) -> Callable:
    """A function that cuts the vectors (id, v, norm2) of a task into runs of ``rows`` and emits ``make`` of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []
        count = 0

        def parts(last: bool):
            nonlocal held, count, number
            ids, data, norm2 = (np.concatenate(x) for x in zip(*held))
            at = 0
            while count - at >= rows or (last and at < count):
                part = slice(at, at + rows)
                yield make(first + number, ids[part], data[part], norm2[part])
                number, at = number + 1, at + rows
            held, count = [(ids[at:], data[at:], norm2[at:])], max(0, count - at)

        for batch in batches:
            if batch.num_rows:
                held.append((np.asarray(batch.column(0)), matrix(batch.column(1), dims, kind), np.asarray(batch.column(2))))
                count += batch.num_rows
            if count >= rows:
                yield from parts(False)
        if count:
            yield from parts(True)

    return run


def top_k(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each key that ``is_query`` holds for, its k best other keys.

    ``is_query`` is a condition on the column ``id``, the key as a long. Rank 1 has the largest inner
    product; ties go to the smaller key.
    """
    spark = df.sparkSession
    vectors = written(whole_vectors(df, key, vector, scale), "topk-vectors")
    largest = F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))
    told = vectors.agg(F.max(F.size("v")).alias("dims"), largest.alias("largest"), F.count("*").alias("rows")).first()
    dims = max(1, told.dims or 1)
    name, _, kind = next(x for x in _KINDS if (told.largest or 0) < x[1])
    vectors = vectors.withColumn("v", F.col("v").cast(f"array<{name}>"))
    rows = lambda count: max(64, min(LANE_BYTES // (8 * dims), max(LEAST_ROWS, -(-count // SPLIT))))

    copies = Window.partitionBy("v").orderBy("id")
    candidates = vectors.withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k + 1).drop("_n")
    candidates = written(candidates, "topk-candidates")
    queries = written(vectors.where(is_query).groupBy("v").agg(F.min("id").alias("id"), F.first("norm2").alias("norm2"), F.count("*").alias("n")),
                      "topk-queries")
    basis, lead = leading_basis(candidates, dims)
    longest = candidates.orderBy(F.desc("norm2"), "id").limit(HEAD).toArrow()
    head_ids = np.asarray(longest.column("id"))
    head = matrix(longest.column("v").combine_chunks(), dims, kind) if longest.num_rows else np.zeros((0, dims), kind)

    def lane(number, ids, data, norm2):
        return pa.RecordBatch.from_pylist([{
            "lane": number, "top": float(np.sqrt(norm2[0])), "c_ids": ids.astype(np.int64).tobytes(), "c": data.tobytes()}])

    def block(number, ids, data, norm2):
        # One vector more than k: the query itself may be among the best.
        bounds = np.full(len(ids), -np.inf)
        if len(head):
            bounds = search(data, head, head_ids, Best(k + 1, bounds), basis, lead).bounds
        # Candidates shorter than this can't reach the k-th best score of any query of the block.
        reach = np.where(bounds > 0, bounds / np.sqrt(np.maximum(norm2, 1.0)), 0.0).min()
        return pa.RecordBatch.from_pylist([{
            "block": number, "reach": float(reach), "q_ids": ids.astype(np.int64).tobytes(), "q": data.tobytes(), "bounds": bounds.tobytes()}])

    count_c, count_q = candidates.count(), queries.count()
    rows_c, rows_q = rows(count_c), rows(count_q)
    lanes = written(
        candidates.repartitionByRange(max(1, -(-count_c // rows_c)), F.desc("norm2"), F.col("id")).sortWithinPartitions(F.desc("norm2"), "id")
        .select("id", "v", "norm2").mapInArrow(_packed(rows_c, dims, kind, lane), "lane long, top double, c_ids binary, c binary"), "topk-lanes")
    blocks = written(
        queries.repartition(max(1, -(-count_q // rows_q)), "id").select("id", "v", "norm2")
        .mapInArrow(_packed(rows_q, dims, kind, block), "block long, reach double, q_ids binary, q binary, bounds binary"), "topk-blocks")

    def units_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, best, q, q_ids = None, None, None, None

        def rows_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(q_ids[best.query]), pa.array(best.id), pa.array(best.score)], names=["q_id", "id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if chain != (row["block"], row["chain"]):
                    if chain:
                        yield rows_of()
                    chain, best = (row["block"], row["chain"]), Best(k + 1, np.frombuffer(row["bounds"]))
                    q, q_ids = np.frombuffer(row["q"], kind).reshape(-1, dims), np.frombuffer(row["q_ids"], np.int64)
                search(q, np.frombuffer(row["c"], kind).reshape(-1, dims), np.frombuffer(row["c_ids"], np.int64), best, basis, lead)
        if chain:
            yield rows_of()

    # The numbers of the blocks and lanes that must meet are joined first, their bytes afterwards.
    part = F.shiftright("lane", 32)
    ranges = lanes.agg(F.max(part)).first()[0] or 0
    chains = max(CHAINS, -(-lanes.count() // LANES_A_CHAIN))
    units = written(blocks.select("block", "reach", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ranges).cast("long"))).alias("part"))
                    .join(lanes.select("lane", "top", part.cast("long").alias("part")), "part")
                    .where(F.col("top") * (1 + SLACK) >= F.col("reach"))
                    .select("block", "lane", F.pmod(F.xxhash64("lane"), F.lit(chains)).alias("chain")), "topk-units")
    tasks = max(1, min(blocks.count() * chains, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))), units.count() // LANES_A_CHAIN)
    found = (units.join(blocks.drop("reach"), "block").join(lanes.drop("top"), "lane").repartition(tasks, "block", "chain")
             .sortWithinPartitions("block", "chain", "lane").select("block", "chain", "q", "c", "q_ids", "c_ids", "bounds")
             .mapInArrow(units_of, "q_id long, id long, score long"))
    by_query = Window.partitionBy("q_id").orderBy(F.desc("score"), "id")
    merged = found.withColumn("_n", F.row_number().over(by_query)).where(F.col("_n") <= k + 1)
    hits = merged.groupBy("q_id").agg(F.sort_array(F.collect_list(F.struct("_n", "id", "score"))).alias("hits"))
    answers = queries.select("v", F.col("id").alias("q_id"), "n").join(hits, "q_id").drop("q_id")
    asked = vectors.where(is_query).select(F.col("id").alias("query_id"), "v")
    joined = join_counted(asked, written(answers, "topk-answers"), "v", "n", told.rows)
    others = F.slice(F.filter("hits", lambda h: h["id"] != F.col("query_id")), 1, k)
    spread = joined.select("query_id", F.posexplode(others).alias("_at", "_hit"))
    return spread.select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_hit.id").alias("vec_id"), F.col("_hit.score").alias("score"))
