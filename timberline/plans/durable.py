"""Written intermediate tables, and joins whose broadcast side has a checked size."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"

# A side is broadcast only below this many bytes of text and rows, measured on the data.
BROADCAST_BYTES = 64 << 20
# Least number of ways a hot key is spread over when a lookup side is too large to broadcast.
SALTS = 64


_written: list[str] = []


def use_local_folder(spark: SparkSession) -> None:
    """For sessions on one machine, as in tests: names a temporary folder where none is set.

    A cluster must name a folder that all executors share.
    """
    master = spark.conf.get("spark.master", "")
    if spark.conf.get(CHECKPOINT_DIR, None) or not (master == "local" or master.startswith("local[")):
        return
    spark.conf.set(CHECKPOINT_DIR, _local_folder())


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="timberline-")


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver did.

    A cluster installs the package on its executors or ships it with --py-files.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([root, known]) if known else root


def scratch_dir(spark: SparkSession, what: str = "timberline") -> str:
    """A new folder, named after its content, below the shared folder the cluster names in ``spark.checkpoint.dir``."""
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
    path = f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Deletes the scratch tables this process has written so far; call it when no result of them is in use."""
    while _written:
        place = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once and read back.

    Later plans start from the files, so a lost executor costs a re-read and not a re-run of
    the whole lineage, and the size of the table is known.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured_bytes(table: DataFrame) -> int:
    """Size of a table as a join side: a fixed cost per row plus the text and array bytes."""
    size = F.lit(96)
    for field in table.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("string", "varchar"):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif kind == "array":
            size = size + F.coalesce(F.size(field.name), F.lit(0)) * 24
    return table.agg(F.sum(size.cast("bigint"))).first()[0] or 0


def lookup_join(lines: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left",
                limit: int | None = None) -> DataFrame:
    """Join a big frame with a (usually tiny) written lookup table.

    Below the size limit the table is broadcast and ``lines`` is not moved. Above it the
    join shuffles, with the lookup rows repeated under as many salts as there are shuffle
    partitions, so that one key that holds a large part of ``lines`` is spread over all tasks.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    if measured_bytes(table) <= limit:
        return lines.join(F.broadcast(table), list(keys), how)
    count = max(SALTS, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salt = F.pmod(F.xxhash64("line_id"), F.lit(count)).cast("int")
    salts = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    joined = lines.withColumn("_salt", salt).join(
        table.withColumn("_salt", salts), [*keys, "_salt"], how)
    return joined.drop("_salt")
