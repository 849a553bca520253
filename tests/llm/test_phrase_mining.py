"""Phrase mining against plain counting of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm import phrase_mining
from timberline.llm.common import importable

SCHEMA = "doc_id long, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=30, best=2000):
    counts, sizes = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            sizes[lang] += len(words)
            counts.update((lang, *words[i:i + m]) for m in range(1, 5) for i in range(len(words) - m + 1))
    frequent = {p: c for p, c in counts.items() if c >= least}
    covered = Counter()
    for (lang, *w), c in frequent.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                sub = (lang, *w[i:i + m])
                covered[sub] = max(covered[sub], c)
    scored = {}
    for (lang, *w), a in frequent.items():
        if len(w) > 1 and 100 * covered[(lang, *w)] < 80 * a:
            cuts = [(2000000 * a // (counts[(lang, *w[:k])] + counts[(lang, *w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            scored.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[(lang, *w[:k])], counts[(lang, *w[k:])]))
    return {(lang, rank, p.decode(), -a, left, rest, sizes[lang], -s)
            for lang, found in scored.items() for rank, (s, a, p, left, rest) in enumerate(sorted(found)[:best], 1)}


def found(spark, rows, extra=(), **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in extra})
    return {tuple(r) for r in phrase_mining.collocations(df, **kw).collect()}


def invented(seed, texts, words=60):
    draw = random.Random(seed)
    names = [f"{draw.choice('AbcDé日')}{i}" for i in range(words)]
    ends = ["", "", "", "", ".", ",", "\n", " \t", ";:", "\x0b", "\x85"]
    rows = []
    for i in range(texts):
        out, length = [], draw.randint(0, 90)
        while len(out) < length:
            start = int(draw.paretovariate(0.7)) % words
            out += [names[(start + j) % words] + draw.choice(ends) for j in range(draw.randint(1, 5))]
        rows.append((i, " ".join(out), draw.choice(["en", "en", "de", None, "und", ""])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_counting(spark, seed):
    importable(spark)
    rows = invented(seed, 600)
    want = plain(rows)
    assert len(want) > 60 and found(spark, rows) == want


def test_result_does_not_depend_on_the_sample(spark, monkeypatch):
    """Nothing or little proposed: border failures bring in everything."""
    importable(spark)
    rows = invented(3, 300)
    want = plain(rows)
    for share in (0.0, 0.02):
        monkeypatch.setattr(phrase_mining, "SAMPLE_SHARE", share)
        assert found(spark, rows) == want


def test_full_table_of_bits_and_short_slices(spark, monkeypatch):
    importable(spark)
    rows = invented(4, 300)
    monkeypatch.setattr(phrase_mining, "MOST_BITS", 64)
    monkeypatch.setattr(phrase_mining, "SLICE_BYTES", 50)
    monkeypatch.setattr(phrase_mining, "VOCABULARY", 20)
    runs = phrase_mining._counted(phrase_mining.Bits(np.full(1, 2**64 - 1, np.uint64)), None)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([(t or "").encode() for _, t, _ in rows]), pa.array([g or "und" for *_, g in rows])], names=["text", "grp"])
    got = Counter()
    for out in runs([batch]):
        for r in out.to_pylist():
            got[(r["grp"], r["phrase"])] += r["f"]
    want = Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            want[(lang or "und", "")] += len(words)
            want.update((lang or "und", " ".join(words[i:i + m])) for m in range(1, 5) for i in range(len(words) - m + 1))
    assert +got == +want
    assert found(spark, rows) == plain(rows)


def test_equal_hashes_of_different_phrases():
    ids = np.array([1, 2, 1, 3, 1, 2, 1, 3, 1, 3])
    places = np.array([1, 3, 5, 7, 9])
    shown, counts = phrase_mining.distinct_windows(ids, np.zeros(10, np.uint64), places, 2)
    assert {(ids[p - 1], ids[p]): c for p, c in zip(shown, counts)} == {(1, 2): 2, (1, 3): 3}


def test_odd_rows(spark, odd, odd_wide, none):
    importable(spark)
    rows = [tuple(r) for r in odd.select("doc_id", "text", "lang").collect()]
    want = plain(rows, 3)
    assert {tuple(r) for r in phrase_mining.collocations(odd, least=3).collect()} == want and want
    assert {tuple(r) for r in phrase_mining.collocations(odd_wide, least=3).collect()} == want
    assert phrase_mining.collocations(none).collect() == []


def test_best_of_a_large_group(spark):
    importable(spark)
    rows = [(i, f"a{i % 300} b{i % 300}. a{i % 300}" if i % 7 else f"a{i % 300} b{i % 300}", "en") for i in range(9000)]
    assert found(spark, rows, best=50) == plain(rows, best=50)
