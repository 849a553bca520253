"""What the operators of this subpackage share: folds, words, per-text columns, written tables."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.plans.durable import scratch_dir, use_local_folder

# Texts handed to one vectorised step: as many as reach this many characters.
CHUNK_CHARS = 2_000_000

# A step gets a list of texts and returns one Arrow array per new column.
Step = Callable[[list[str]], Sequence[pa.Array]]


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver did.

    A cluster installs the package on its executors or ships it with --py-files.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([root, known]) if known else root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """The name, or a longer one, that no column of ``df`` has in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def whole_row(df: DataFrame) -> Column:
    """All columns as one, so that no name of theirs meets one of an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def fold(key: Column, count: int) -> Column:
    """crc32 of the key as text, modulo ``count``; null keys are in no fold."""
    return F.crc32(key.cast("string").cast("binary")) % count


def in_fold(key: Column, count: int, index: int) -> Column:
    return F.coalesce(fold(key, count) == index, F.lit(False))


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Runs of consecutive texts of about ``limit`` characters; a longer text is a run of its own."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > limit:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def with_text_columns(df: DataFrame, text: str, fields: Sequence[tuple[str, str]],
                      make: Callable[[], Step], extra: Sequence[str] = ()) -> DataFrame:
    """``df`` with columns computed from each whole text, in Arrow batches without a shuffle.

    ``make`` runs once per task and returns the step. A null text counts as empty. A column
    of ``df`` that has the name of a new one is replaced. Rows keep their order. The columns
    named in ``extra`` are handed to the step as further lists.
    """
    names = [name for name, _ in fields]
    clash = {name.lower() for name in names} - {text.lower()}
    kept = [c for c in df.columns if c.lower() not in clash]
    kept_frame = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([f for f in kept_frame.schema.fields])
    for name, kind in fields:
        schema = schema.add(name, T.DataType.fromDDL(kind))
    place = kept.index(text)
    places = [kept.index(c) for c in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            done = 0
            texts = [t or "" for t in batch.column(place).to_pylist()]
            for part in chunks(texts):
                rows = batch.slice(done, len(part))
                more = [rows.column(p).to_pylist() for p in places]
                columns = [*rows.columns, *step(part, *more)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])
                done += len(part)

    return kept_frame.mapInArrow(run, schema)


# Rows of a file of a written table whose number of rows is known: small tables are not spread over many files.
ROWS_A_FILE = 20_000


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that the cluster shares, named by ``spark.checkpoint.dir``; ``release`` deletes it.

    Only a session on one machine, where nothing is named, gets a folder of its own.
    """
    use_local_folder(spark)
    return scratch_dir(spark, what)


def written(df: DataFrame, what: str, codec: str | None = None, rows: int | None = None, a_file: int = ROWS_A_FILE) -> DataFrame:
    """``df`` as a table in the shared folder, read back: lost executors cost a read, not a rerun.

    With ``rows``, a bound of its rows, it is written by no more tasks than such a table needs.
    """
    path = shared_path(df.sparkSession, what)
    few = df if rows is None else df.coalesce(max(1, -(-rows // a_file)))
    few.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, bound: int,
                    key: str = "doc_id", text: str = "text", extra: Sequence[str] = ()) -> DataFrame:
    """Texts of at most ``bound`` labelled ids, chosen by a hash of the id; columns key, text, label.

    Ids with several labels take the largest. The ids are at most ``bound`` rows, so they are
    broadcast and the documents stay where they are.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & usable)
    # Far more labels than the bound are thinned by the hash first, so that tasks hand on a bounded part.
    thin = min(1.0, 2.0 * bound / max(1, known.count()))
    if thin < 1:
        known = known.where(F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit(11)), F.lit(1 << 30)) < int(thin * (1 << 30)))
    ids = (known.groupBy(F.col(key).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
           .orderBy(F.xxhash64("_id"), "_id").limit(bound))
    narrow = docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("_text"),
                         *[F.col(f"`{c}`").alias(f"_x_{c}") for c in extra])
    return narrow.join(F.broadcast(ids), "_id")


# Keys that a broadcast of hot keys holds at most; with it a key's rows may be any part of the input.
HOT_KEYS = 10_000


def join_counted(big: DataFrame, small: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``big`` with ``small``, which has one row per key and the key's rows in ``big``.

    Keys with more than ``total`` / HOT_KEYS rows number fewer than HOT_KEYS: they are broadcast, so
    their rows stay where they are, and the shuffle only meets keys that are small.
    """
    hot = small.where(F.col(count) > max(1000, total // HOT_KEYS))
    names = [c for c in small.columns if c != key]
    marked = big.join(F.broadcast(hot), key, "left")
    there = marked.where(F.col(count).isNotNull())
    rest = marked.where(F.col(count).isNull()).drop(*names).join(small, key)
    return there.unionByName(rest)
