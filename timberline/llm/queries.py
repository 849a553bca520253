"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import (
    bpe_codec,
    chat_format,
    lattice_lm,
    oracles,
    phrase_mining,
    qgram_leaks,
    quality_fm,
    range_shards,
    rule_ledger,
    secret_scan,
    simhash_ball,
    token_alignment,
    topk_search,
    toxic_segments,
)
from timberline.llm.common import in_fold, table, written

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
SHARDS = 24
TOXIC_FROM = 0.7


def vocabulary_path(name: str) -> str:
    """Place of a public tokenizer file; every executor has it in the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    held_out = in_fold(F.col("doc_id"), 5, 0)
    machine = quality_fm.fit(docs, table(spark, sf_dir, "labels"), ~held_out, metadata=["n_chars"])
    scored = quality_fm.score(docs, machine, metadata=["n_chars"])
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = in_fold(F.col("doc_id"), 3, 1)
    model = toxic_segments.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxic_segments.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
                         F.size("passages").alias("n_passages"))


def op3_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash_ball.near_copies(docs)
    return found.select("doc_id", simhash_ball.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op4_qgram_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item found in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = qgram_leaks.with_leaks(docs, table(spark, sf_dir, "benchmark")).where(qgram_leaks.has_leak())
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op5_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = rule_ledger.ledger(docs)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rule_ledger.rejects(rule_ledger.BASE).alias("base_failed"),
        (~rule_ledger.rejects(rule_ledger.STRICT)).alias("kept"),
        "failed_bits",
    )


def op7_range_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    narrow = written(table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    ), "shard-keys")
    # Equal texts are neighbours in this order, and the id divides them where they are too many.
    placed = range_shards.assign_shards(narrow, F.col("size"), [F.col("text_crc32"), F.col("doc_id")], SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, vocabulary=vocabulary_path(WORD_BPE)).drop("text")
    base = F.filter("spans", lambda s: s["kind"] != "guess")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.array_max(F.transform("spans", lambda s: s["log10_guesses"])).alias("most_log10_guesses"),
    )


def op8_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = in_fold(F.col("doc_id"), 5, 1)
    scored = lattice_lm.score(docs, ~held_out, vocabulary_path(PIECES))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)],
                                  "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_turns(rows.unionByName(extra)))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_codec.encode_decode(docs, vocabulary_path(WORD_BPE)).drop("text")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.aligned(table(spark, sf_dir, "documents"), vocabulary_path(BYTE_BPE), vocabulary_path(PIECES))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, sf_dir, "documents"))


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def queries() -> dict:
    return {
        "op1_quality_fm": op1_quality_fm,
        "op2_toxic_segments": op2_toxic_segments,
        "op3_simhash_ball": op3_simhash_ball,
        "op4_qgram_leaks": op4_qgram_leaks,
        "op5_rule_ledger": op5_rule_ledger,
        "op6_secret_scan": op6_secret_scan,
        "op7_range_shards": op7_range_shards,
        "op8_lattice_lm": op8_lattice_lm,
        "op9_bpe_codec": op9_bpe_codec,
        "op10_chat_format": op10_chat_format,
        "op11_token_alignment": op11_token_alignment,
        "op12_phrase_mining": op12_phrase_mining,
        "op13_topk_search": op13_topk_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_rule_ledger": oracles.RULE_LEDGER, "op10_chat_format": oracles.CHAT_FORMAT,
            "op12_phrase_mining": oracles.PHRASE_MINING, "op13_topk_search": oracles.TOPK_SEARCH}
