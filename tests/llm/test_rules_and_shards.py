"""Rule ledger and range shards."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from timberline.llm import queries, range_shards, rule_ledger

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    often = Counter(windows)
    covered = {p for k, w in enumerate(windows) if often[w] > 1 for p in range(k, k + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def measured(rows):
    return sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)


def test_measurements_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = queries.op5_rule_ledger(spark, SF).collect()
    assert measured(rows) == sorted((str(d.doc_id), *plain(d.text)) for d in docs)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in rows)
    assert not any(r.base_failed and r.kept for r in rows)


def test_clean_documents_are_kept(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    rows = queries.op5_rule_ledger(spark, SF).join(labels, "doc_id").where("not base_failed")
    assert rows.where("kept").count() > 0.98 * rows.count()


@pytest.mark.parametrize("name", ["odd", "odd_wide", "none"])
def test_ledger_of_odd_rows(request, name):
    docs = request.getfixturevalue(name)
    rows = rule_ledger.ledger(docs).collect()
    assert measured(rows) == sorted((str(d.doc_id), *plain(d.text)) for d in docs.collect())
    assert all(r.failed_bits & 1 for r in rows if r.n_words < 20)


def test_ablations_count_what_policies_do(spark):
    rows = rule_ledger.ledger(spark.read.parquet(f"{SF}/documents.parquet")).cache()
    bits = [r.failed_bits for r in rows.collect()]
    for r in rule_ledger.ablations(rows, [rule_ledger.BASE, rule_ledger.STRICT]).collect():
        policy = {p.version: p for p in (rule_ledger.BASE, rule_ledger.STRICT)}[r.policy]
        bit, mask = 1 << [x.name for x in rule_ledger.RULES].index(r.rule), policy.mask()
        assert (r.fails, r.kept) == (sum(b & bit > 0 for b in bits), sum(b & mask == 0 for b in bits))
        assert r.kept_without_it == sum(b & mask & ~bit == 0 for b in bits) == r.kept + r.rejected_by_it_alone


def test_shards_of_all_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op7_range_shards(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    sizes, slots = Counter(), {}
    for r in rows:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in rows)
    # Shards are runs of the key order.
    order = sorted(rows, key=lambda r: (r.text_crc32, r.doc_id))
    assert [(r.shard, r.slot) for r in order] == sorted((r.shard, r.slot) for r in rows)


def test_a_hot_key_is_divided(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    got = range_shards.assign_shards(rows, F.lit(100), [F.col("k"), F.col("id")], 8).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [500] * 8


@pytest.mark.parametrize("name", ["odd", "odd_wide", "none"])
def test_shards_of_odd_rows(request, name):
    docs = request.getfixturevalue(name)
    rows = range_shards.assign_shards(docs, F.octet_length("text"), [F.col("source"), F.col("doc_id")], 3).collect()
    assert len(rows) == docs.count()
    for shard in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))
