"""The corpus pipeline: toxic documents go, near copies go, leaked benchmark passages go, secrets are masked, texts are encoded.

Each stage takes the documents that the one before kept, and its decisions take effect. All stages but the
last return the columns of ``documents``; ``run`` writes each stage as Parquet in the shared folder and
reads it back, so a lost executor costs a read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import bpe_codec, qgram_leaks, secret_scan, shingle_copies, toxic_segments
from timberline.llm.common import importable, in_fold, table, written
from timberline.llm.queries import TOXIC_FROM, WORD_BPE, vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold; labels teach as in the scoring query."""
    docs = _documents(docs)
    learn_from = ~in_fold(F.col("doc_id"), 3, 1)
    model = toxic_segments.fit(docs, table(spark, sf_dir, "labels"), learn_from)
    scored = toxic_segments.score(docs, model, name="_score", passages="_passages")
    return scored.where(F.col("_score") < TOXIC_FROM).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id: SimHash balls and bands propose, Jaccard 0.8 or more of five-word shingles decides."""
    return shingle_copies.keep_one(_documents(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    found = qgram_leaks.with_leaks(_documents(docs), table(spark, sf_dir, "benchmark"), leaks="_leaks")
    return found.where(~qgram_leaks.has_leak("_leaks")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; ``n_chars`` follows where a text changed."""
    docs = _documents(docs)
    masked = secret_scan.redact(docs.withColumn("_before", F.char_length("text")), vocabulary=vocabulary_path(WORD_BPE))
    after = F.char_length("text")
    changed = F.when(after != F.col("_before"), after.cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", changed).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number, and the text that they decode to."""
    coded = bpe_codec.encode_decode(_documents(docs), vocabulary_path(WORD_BPE))
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded")


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_copies", near_copies),
    ("benchmark_decontamination", decontamination),
    ("secrets", secrets),
    ("bpe", encoding),
]

# No stage can be written in SQL; tests hold the run against a plain version of each.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    importable(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
