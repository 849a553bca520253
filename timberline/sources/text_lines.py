"""Text files, and any table with a text column, as DataFrames of lines.

A row of ``lines`` is one physical line: ``path, source, block, line_id, file_mtime,
value``. ``(path, block, line_id)`` orders the lines of a file as they stand in it, also
when the file was read as many blocks.
"""

from __future__ import annotations

import posixpath
import re
import warnings
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as from_jvm

from timberline.plans.durable import durable, importable, lookup_join

LINE_COLUMNS = ("path", "source", "block", "line_id", "file_mtime", "value")
_MIN_PARTITIONS = "spark.sql.files.minPartitionNum"


def check_paths(spark: SparkSession, paths: Sequence[str]) -> None:
    """Refuses request paths that name a file Spark's scans pass over in silence.

    Names that begin with ``_`` or ``.`` count as hidden. One that is asked for by name is an
    error; hidden files that a folder or a pattern would take in are reported in a warning. This
    looks at each path of the request, not at each file.
    """
    hidden = lambda name: name.startswith(("_", "."))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(conf)
        found = list(system.globStatus(place) or [])
        skipped = [f.getPath().getName() for f in found if f.isFile() and hidden(f.getPath().getName())]
        if skipped and (len(found) == 1 or not re.search(r"[*?\[{]", path)):
            raise ValueError(f"files whose names begin with '_' or '.' can't be scanned; rename or copy: {path}")
        for folder in (f.getPath() for f in found if f.isDirectory()):
            skipped += [f.getPath().getName() for f in system.listStatus(folder)
                        if f.isFile() and hidden(f.getPath().getName()) and f.getPath().getName() != "_SUCCESS"]
        if skipped:
            warnings.warn(f"hidden files below {path} are not read: {', '.join(sorted(skipped)[:20])}", stacklevel=3)


def _scan_session(spark: SparkSession) -> SparkSession:
    """A session of its own for scans, in which the number of splits is pinned.

    Several passes over the lines must see the same splits. These depend on the number of
    cores, which can change while a run lasts, unless the least number of splits is set. The
    caller's session is left as it is.
    """
    if spark.conf.get(_MIN_PARTITIONS, None):
        return spark
    known = _SCAN_SESSIONS.get(id(spark))
    if known is None or known[0] is not spark:
        own = spark.newSession()
        _SCAN_SESSIONS[id(spark)] = known = (spark, own, str(spark.sparkContext.defaultParallelism))
    own = known[1]
    for key in _SPLIT_SETTINGS:
        value = spark.conf.get(key, None)
        if value is not None:
            own.conf.set(key, value)
    own.conf.set(_MIN_PARTITIONS, known[2])
    return own


# Place of a file that is not in the table of the request's files.
LAST_FILE = 2**31 - 1
# What a scan's splits depend on.
_SPLIT_SETTINGS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionNum")
_SCAN_SESSIONS: dict[int, tuple[SparkSession, SparkSession, str]] = {}


def _in_session(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` as a frame of the given session: united with no rows of that session, which plans away."""
    nothing = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in df.schema.fields)
    return spark.sql(f"SELECT {nothing} WHERE false").union(df)


def read_lines(spark: SparkSession, paths: str | Sequence[str], only: DataFrame | None = None) -> DataFrame:
    """Lines of UTF-8 text files; a missing, unreadable or hidden path fails the run.

    ``only`` is a written table of the files to read, with a column ``path``. Nearly all others are dropped from
    the file list while planning and not opened; a join drops the rest. Other columns of ``only`` come along.

    The text source splits large files and packs small ones, so work follows bytes, not files.
    """
    paths = [paths] if isinstance(paths, str) else list(dict.fromkeys(paths))
    if not paths:
        raise ValueError("no input file is given")
    check_paths(spark, paths)
    text = _scan_session(spark).read.option("lineSep", "\n").text(paths)
    meta = lambda name: F.col(f"_metadata.{name}")
    if only is not None:
        marks = file_marks(only)
        text = text.filter(F.substr(F.lit(marks), _mark(meta("file_path"), len(marks)) + 1, F.lit(1)) == "1")
    # The id must be taken in the select on the scan: here it follows the file order.
    columns = {
        "path": meta("file_path"),
        "source": base_name(meta("file_name")),
        "block": meta("file_block_start"),
        "line_id": F.monotonically_increasing_id(),
        "file_mtime": meta("file_modification_time"),
        "value": F.col("value"),
    }
    lines = _in_session(spark, text.select(*[c.alias(n) for n, c in columns.items()]))
    if only is not None:
        lines = lookup_join(lines, only, ["path"], how="inner")
    return lines.withColumn("value", F.when(
        F.endswith("value", F.lit("\r")), F.expr("left(value, length(value) - 1)")
    ).otherwise(F.col("value")))


def base_name(file_name: Column) -> Column:
    """A file name without the escapes of the path it comes from."""
    decoded = F.url_decode(F.replace(file_name, F.lit("+"), F.lit("%2B")))
    return F.when(file_name.contains("%"), decoded).otherwise(file_name)


def table_lines(table: DataFrame, value: Column, source: Column, line_id: Column,
                block: Column, file_mtime: Column | None = None) -> DataFrame:
    """Lines from a table: ``line_id`` is its order column, ``block`` a range bucket of it.

    Work in line order is done block by block, so a block should hold what a task can sort.
    """
    return table.select(
        source.alias("path"),
        source.alias("source"),
        block.cast("bigint").alias("block"),
        line_id.cast("bigint").alias("line_id"),
        (F.lit(None) if file_mtime is None else file_mtime).cast("timestamp").alias("file_mtime"),
        value.alias("value"),
    )


def _first(lines: DataFrame, count: int) -> DataFrame:
    """The window keeps ``count`` rows per file inside each task before anything is shuffled."""
    order = Window.partitionBy("path").orderBy("block", "line_id")
    return lines.withColumn("_rank", F.row_number().over(order)).filter(
        F.col("_rank") <= count).drop("_rank")


def head_sample(lines: DataFrame, count: int = 20) -> DataFrame:
    """The first ``count`` lines of each file of a table of lines.

    Places are ranked without the texts; the few texts are then looked up.
    """
    keys = ["path", "block", "line_id"]
    return lookup_join(lines, durable(_first(lines.select(*keys), count)), keys, how="left_semi")


# Bytes that one read of a head takes, and files that one task opens one after the other.
HEAD_BYTES = 64 << 10
FILES_A_TASK = 256
_BOM = b"\xef\xbb\xbf"


def _head_of(path: str, count: int) -> tuple[list[str], int]:
    """The first lines of a file, and the bytes read for them. Text after the last line break is a line too."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    got, taken = b"", 0
    with system.open_input_stream(place, compression="detect") as stream:
        while got.count(b"\n") < count and (more := stream.read(HEAD_BYTES)):
            got, taken = got + more, taken + len(more)
    lines = got.removeprefix(_BOM).split(b"\n")
    if not lines[-1] or len(lines) > count:
        lines = lines[:min(count, len(lines) - 1)]
    return [line.removesuffix(b"\r").decode(errors="replace") for line in lines], taken


def read_heads(files: DataFrame, count: int) -> DataFrame:
    """``path, line_id, value, head_bytes``: the first lines of each file of a column ``path``.

    Only as much of a file is read as holds these lines, by Arrow's file systems. A file that these can't
    open, for its store or its compression, has one row without ``line_id``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    if re.search(r"\.(snappy|deflate)$", path):
                        raise OSError("not a compression that Arrow finds by name")
                    lines, taken = _head_of(path, count)
                    ids = list(range(len(lines)))
                except (OSError, ImportError, ValueError, NotImplementedError):
                    lines, ids, taken = [None], [None], 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(lines), pa.string()), pa.array(ids, pa.int64()), pa.array(lines, pa.string()),
                     pa.array([taken] * len(lines), pa.int64())], names=["path", "line_id", "value", "head_bytes"])

    return files.select("path").mapInArrow(run, "path string, line_id long, value string, head_bytes long")


def file_head_sample(spark: SparkSession, paths: Sequence[str], count: int = 20) -> DataFrame:
    """The first ``count`` lines of each text file, without reading more than these.

    Files that can't be opened outside a scan are scanned whole, and only those.
    """
    importable(spark)
    files = durable(input_files(spark, paths).filter(F.col("file_size") > 0))
    tasks = max(1, -(-files.count() // FILES_A_TASK))
    heads = durable(read_heads(files.repartition(tasks), count))
    status = files.select("path", base_name(F.substring_index("path", "/", -1)).alias("source"), "file_mtime")
    found = lookup_join(heads.filter(F.col("line_id").isNotNull()), status, ["path"], how="inner").select(
        "path", "source", F.lit(0).cast("bigint").alias("block"), "line_id", "file_mtime", "value")
    closed = durable(heads.filter(F.col("line_id").isNull()).select("path"))
    if closed.isEmpty():
        return found
    return found.unionByName(_first(read_lines(spark, paths, only=closed), count))


# --- files of a request ----------------------------------------------------------------

# Marks of files in the text that a scan is pruned with: so many for each file, and at most so many.
MARKS_A_FILE = 16
MOST_MARKS = 1 << 20


def _mark(path: Column, marks: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(marks)).cast("int")


def file_marks(files: DataFrame) -> str:
    """A text of zeros and ones that tells which files a scan need not open.

    A file whose place holds a zero is not in the table. The text has a bounded length whatever the
    number of files; with too many of them it prunes less, and the join that follows decides.
    """
    count = files.count()
    marks = min(MOST_MARKS, 1 << max(8, (MARKS_A_FILE * count - 1).bit_length()))
    text = bytearray(b"0" * marks)
    places = files.select(_mark(F.col("path"), marks).alias("place")).distinct().toArrow().column("place")
    for place in places.to_pylist():
        text[place] = ord("1")
    return text.decode()


def _plain(path: str) -> str:
    """A path without scheme, authority and escapes, for comparing two spellings of it."""
    return re.sub(r"^[a-zA-Z][\w+.-]*:(//[^/]*)?", "", path).rstrip("/") or "/"


def _plain_column(path: Column) -> Column:
    """The same for a column of paths as Spark writes them, which are escaped."""
    bare = F.regexp_replace(path, r"^[a-zA-Z][\w+.-]*:(//[^/]*)?", "")
    return base_name(bare)


def _glob_pattern(glob: str) -> str:
    """A regular expression for a glob of whole paths: ``*`` and ``?`` stay inside a name, ``{a,b}`` and ``[ab]`` work."""
    out, depth, at = "", 0, 0
    while at < len(glob):
        c = glob[at]
        if c == "[" and (end := glob.find("]", at + 2)) > 0:
            inner = glob[at + 1:end]
            negated = inner[0] in "!^"
            body = re.sub(r"([\\\[&])", r"\\\1", inner[negated:])
            out, at = out + f"[{'^' * negated}{body}]", end
        elif c == "\\" and at + 1 < len(glob):
            at += 1
            out += re.escape(glob[at])
        else:
            depth += (c == "{") - (c == "}")
            out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}.get(c) or ("|" if c == "," and depth else re.escape(c))
        at += 1
    return f"^{out}$"


def input_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``path, file_mtime, file_size``: every file a request reads, spelled as in the ``path`` of its lines.

    The rows come from a scan that reads no content. It passes over empty files, so these are added from the list
    that Spark has made to plan it, which stays in the JVM; their time is unknown.
    """
    paths = list(dict.fromkeys(paths))
    check_paths(spark, paths)
    meta = lambda name: F.col(f"_metadata.{name}")
    status = spark.read.format("binaryFile").load(paths).select(
        meta("file_path").alias("path"), meta("file_modification_time").alias("file_mtime"), meta("file_size").alias("file_size"))
    return status.unionByName(_empty_files(spark, paths, status))


def _empty_files(spark: SparkSession, paths: Sequence[str], status: DataFrame) -> DataFrame:
    names = from_jvm(spark._jvm.org.apache.spark.sql.functions.lit(spark.read.text(list(paths))._jdf.inputFiles()))
    # Local files are listed as file:///x, but each line says file:/x.
    listed = spark.range(1).select(F.explode(names).alias("path")).select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"))
    return listed.join(status.select("path"), "path", "left_anti").select(
        "path", F.lit(None).cast("timestamp").alias("file_mtime"), F.lit(0).cast("bigint").alias("file_size"))


def file_order(spark: SparkSession, paths: Sequence[str]) -> DataFrame | None:
    """``path, file_idx``: the positions of each file in the request; None if it has only one.

    A folder or glob takes one position; its files then follow by path. A path given twice
    counts twice, as two entries of the request. Every folder above a file is looked up among the paths of the
    request, and the longest that is there decides; patterns decide for files that no path names.
    """
    if len(paths) == 1:
        return None
    wanted, patterns = [], []
    for index, path in enumerate(paths):
        plain = _plain(path)
        if not plain.startswith("/"):
            tail = re.sub(r"^(\.\./)+", "", posixpath.normpath(plain))
            patterns.append((f"(?:.*/){_glob_pattern(tail)[1:]}", index))
        elif re.search(r"[*?\[{]", plain):
            patterns.append((_glob_pattern(plain), index))
        else:
            wanted.append((plain, index))
    steps = F.split(_plain_column(F.col("path")), "/")
    above = F.transform(F.sequence(F.size(steps), F.lit(2), F.lit(-1)), lambda n: F.concat_ws("/", F.slice(steps, 1, n)))
    files = input_files(spark, paths).select("path", above.alias("spellings"))
    named = spark.createDataFrame(wanted, "spelling string, file_idx int")
    spelled = files.select("path", F.posexplode("spellings").alias("up", "spelling")).join(F.broadcast(named), "spelling")
    nearest = spelled.withColumn("_n", F.rank().over(Window.partitionBy("path").orderBy("up"))).filter("_n = 1").select("path", "file_idx")
    places = nearest
    if patterns:
        matches = lambda regex: F.exists("spellings", lambda s: s.rlike(regex))
        hits = F.array_compact(F.array(*[F.when(matches(regex), F.lit(index)) for regex, index in patterns]))
        matched = files.join(nearest.select("path").distinct(), "path", "left_anti").select("path", F.explode(hits).alias("file_idx"))
        places = nearest.unionByName(matched)
    # A spelling not understood here costs the file its place in the order, never its lines.
    every = files.select("path").join(places, "path", "left")
    return durable(every.select("path", F.coalesce("file_idx", F.lit(len(paths))).cast("int").alias("file_idx")))


def with_file_order(lines: DataFrame, order: DataFrame | None) -> DataFrame:
    """``lines`` with ``file_idx``, by which results of several files are ordered."""
    if order is None:
        return lines.withColumn("file_idx", F.lit(0))
    # A file that the order table spells in another way comes last; its lines are never lost.
    return lookup_join(lines, order, ["path"], how="left").withColumn(
        "file_idx", F.coalesce("file_idx", F.lit(LAST_FILE)))
