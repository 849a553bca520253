"""The pipeline's near copies against exact Jaccard similarities of five-word shingles."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import DOC_SCHEMA
from timberline.llm import shingle_copies, simhash_ball

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def kept(docs):
    """Smallest id of each component of pairs at 0.8 or more; texts without words are copies of each other."""
    sets = {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for at, i in enumerate(ids):
        for j in ids[:at]:
            a, b = sets[i], sets[j]
            if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)) or find(i) == find(j):
                continue
            both = len(a & b)
            if a == b or 5 * both >= 4 * (len(a) + len(b) - both):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return sorted({find(i) for i in ids})


def rows_of(docs):
    return [(i, t, "en", "a", len(t)) for i, t in docs.items()]


def test_stage_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SF).collect())
    assert got == kept({r.doc_id: r.text for r in docs.collect()})


def test_edits_scattered_over_a_long_text(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(250)]
    docs = {1: " ".join(words)}
    for i in range(2, 60):  # three words each: 0.87 like the first, less like each other
        own = list(words)
        for at in rng.sample(range(6, 244), 3):
            own[at] = f"x{i}"
        docs[i] = " ".join(own)
    docs[99] = " ".join(words[:150] + [f"z{k}" for k in range(100)])
    frame = spark.createDataFrame(rows_of(docs), DOC_SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, frame, SF).collect()) == kept(docs) == [1, 99]


def letters(seed, pairs, strangers=0.784, alike=0.828, form=200):
    """Texts that fill in one form, in pairs: those of a pair share more of what is filled in than the form."""
    rng, docs = random.Random(seed), {}
    words = [f"w{k}" for k in range(form)]
    # One word filled in changes five shingles; strangers share only what none has filled in.
    own, common = round(form * (1 - strangers) / (1 + strangers) / 5), round(form * (1 - alike) / (1 + alike) / 5)
    places = [5 + k * (form - 10) // own for k in range(own)]
    for p in range(pairs):
        base = list(words)
        for at in places:
            base[at] = f"p{p}at{at}"
        for half in range(2):
            text = list(base)
            for at in rng.sample(places, common):
                text[at] = f"p{p}h{half}at{at}"
            docs[2 * p + half] = " ".join(text)
    return docs


@pytest.mark.parametrize("pairs, alike", [(150, 0.828), (300, 0.843)])
def test_letters_that_share_a_form(spark, pairs, alike):
    docs = letters(pairs, pairs, alike=alike)
    frame = spark.createDataFrame(rows_of(docs), DOC_SCHEMA)
    got = sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, frame, SF).collect())
    assert got == kept(docs) and len(got) < 1.9 * pairs


def test_a_template_and_its_copies_among_strangers(spark):
    """A hot group of near copies, a chain that leaves it, and letters of the same form that are no copies."""
    rng = random.Random(9)
    words = [f"t{k}" for k in range(120)]
    docs = {}
    for i in range(300):
        own = list(words)
        for at in rng.sample(range(120), 1 if i < 240 else 8):
            own[at] = f"c{i}x{at}"
        docs[i] = " ".join(own)
    frame = spark.createDataFrame(rows_of(docs), DOC_SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, frame, SF).collect()) == kept(docs)


def test_odd_rows(odd, odd_wide, none):
    for docs in (odd, odd_wide, none):
        found = shingle_copies.keep_one(docs)
        assert found.columns == docs.columns
        rows = found.collect()
        assert len(rows) == len({(r.doc_id, r.text) for r in rows}) <= docs.count()
        assert len([r for r in rows if not (r.text or "").strip()]) <= 1


def test_set_of_a_node_in_many_pairs_is_dealt_to_several_tasks(spark):
    pairs = shingle_copies.written(spark.range(1, 4001).selectExpr("0L a", "id b"), "test-pairs")
    sets = spark.range(0, 4001).selectExpr("id node", "IF(id % 3 = 0, array(1L, 2L, 3L, 4L, 5L), array(1L, 2L, 3L, id + 9)) shingles")
    found = shingle_copies.verified(pairs, sets)
    assert sorted((r.a, r.b) for r in found.collect()) == [(0, k) for k in range(3, 4001, 3)]


def test_balls_alone_link_all_pairs_within_their_distance(spark, monkeypatch):
    """Without bands, texts of one component of five-word fingerprints are compared, in small groups and large ones, and no others are."""
    rng = random.Random(12)
    docs = {}
    for base in range(40):
        words = [f"b{base}w{k}" for k in range(600)]
        for copy in range(60 if base == 0 else 3):
            own = list(words)
            for _ in range(copy % 3):
                own[rng.randrange(600)] = f"c{copy}"
            docs[len(docs)] = " ".join(own)
    docs |= {900: "a b a b a b a b", 901: "A b a b a b", 902: "", 903: " "}
    prints = {i: simhash_ball.fingerprint(simhash_ball.shingle_hashes(t, 5)) for i, t in docs.items()}
    sets = {i: shingles(t) for i, t in docs.items()}
    comp = {i: i for i in docs}
    for i in docs:
        for j in range(i):
            if j in docs and sets[i] and sets[j] and (prints[i] ^ prints[j]).bit_count() <= 4 and comp[i] != comp[j]:
                low, high = sorted((comp[i], comp[j]))
                comp = {k: low if c == high else c for k, c in comp.items()}
    root = {i: i for i in docs}
    for i in docs:
        for j in docs:
            both = len(sets[i] & sets[j])
            if j < i and root[i] != root[j] and (sets[i] == sets[j] or comp[i] == comp[j] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)):
                low, high = sorted((root[i], root[j]))
                root = {k: low if c == high else c for k, c in root.items()}
    with_bands = shingle_copies.with_bands
    monkeypatch.setattr(shingle_copies, "with_bands", lambda df, text: with_bands(df, text).withColumn("bands", F.array().cast("array<bigint>")))
    found = shingle_copies.near_copies(spark.createDataFrame(rows_of(docs), DOC_SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in found} == root
    assert len(set(root.values())) < 80 and len({i for i in range(60) if root[i] == 0}) > shingle_copies.SMALL_GROUP
