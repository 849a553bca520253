"""The pipeline against a plain version of each stage, run on what the stage got."""

import re

import corpus_pipeline
import __spark_entry__ as entry
from timberline.llm import bpe_codec, qgram_leaks, queries, secret_scan

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.01"


def jaccard_roots(texts):
    """The first text of each component of texts with a Jaccard similarity of 0.8 of five-word shingles, all pairs compared."""
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    roots = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j]) if 4 * max(len(a), len(sets[j])) <= 5 * min(len(a), len(sets[j])) else 0
            if a == sets[j] or 5 * both >= 4 * (len(a) + len(sets[j]) - both) > 0:
                low, high = sorted((roots[i], roots[j]))
                roots = [low if r == high else r for r in roots]
    return roots


def test_each_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [qgram_leaks.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    coder = bpe_codec.Codec(queries.vocabulary_path(queries.WORD_BPE))
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        after = stage(spark, docs, SF).cache()
        rows = {r.doc_id: r for r in after.collect()}
        assert len(rows) == after.count()
        if name != "bpe":
            assert after.columns == docs.columns
        if name == "toxicity":
            gone = set(before) - set(rows)
            labelled = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
            assert len(gone & toxic) >= 0.5 * len(toxic) and len(gone & labelled) <= 0.03 * len(labelled)
        elif name == "simhash_near_copies":
            ids = sorted(before)
            assert sorted(rows) == [ids[k] for k in sorted(set(jaccard_roots([before[i].text for i in ids])))]
        elif name == "benchmark_decontamination":
            hit = {i for i, r in before.items() if any(t in qgram_leaks.normal(r.text) for t in items)}
            assert hit and hit.isdisjoint(rows) and len(set(before) - set(rows) - hit) <= 1
        elif name == "secrets":
            assert set(rows) == set(before)
            for i, r in rows.items():
                assert not any(k != "guess" for k, *_ in secret_scan.find_spans(r.text))
                assert r.text == before[i].text or "[SECRET]" in r.text
                assert r.text == before[i].text or r.n_chars == len(r.text)
        else:
            assert {i: list(r.ids) for i, r in rows.items()} == {i: coder.encode([r.text])[0] for i, r in before.items()}
        docs = after


def test_run_is_registered(spark):
    df = entry.queries()["pipeline"](spark, SF)
    assert 0 < df.count() < spark.read.parquet(f"{SF}/documents.parquet").count()


def test_stages_take_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()
