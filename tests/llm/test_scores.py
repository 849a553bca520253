"""Quality, toxicity and language-model scores."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm import lattice_lm, quality_fm, queries, toxic_segments

SF = "/root/testdata/sf0.01"
ALL = None  # a condition needs a session; set by the fixture below


@pytest.fixture(autouse=True, scope="module")
def everything(spark):
    global ALL
    ALL = F.lit(True)


def held_out_auc(spark, df, label, count, index):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [r for r in df.join(labels, "doc_id").collect() if r[label] is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % count == index) for r in rows)
    good = np.array([r.score for r in rows if r.held_out and r[label] == 1])
    bad = np.array([r.score for r in rows if r.held_out and r[label] == 0])
    return float(np.mean((good[:, None] > bad) + 0.5 * (good[:, None] == bad)))


def test_quality_of_held_out_labels(spark):
    df = queries.op1_quality_fm(spark, SF)
    assert held_out_auc(spark, df, "quality", 5, 0) > 0.97
    assert df.where("score < 0 or score > 1 or score is null or predicted <> cast(score >= 0.3 as int)").count() == 0


def test_toxicity_of_held_out_labels(spark):
    df = queries.op2_toxic_segments(spark, SF)
    assert held_out_auc(spark, df, "toxic", 3, 1) > 0.85
    assert df.where("score < 0 or score > 1 or score is null or predicted <> cast(score >= 0.7 as int)").count() == 0


def test_linear_time_interactions_equal_all_pairs():
    rng = np.random.default_rng(1)
    machine = quality_fm.Machine(0.3, rng.normal(size=quality_fm.WORD_SLOTS + 2), rng.normal(size=(quality_fm.WORD_SLOTS + 2, 3)),
                                 np.zeros(2), np.ones(2))
    slots, values = [np.array([5, 9, 700], np.int32)], [np.array([0.2, 0.5, 0.1], np.float32)]
    dense = np.array([[0.4, -1.0]], np.float32)
    index = [5, 9, 700, quality_fm.WORD_SLOTS, quality_fm.WORD_SLOTS + 1]
    x = [0.2, 0.5, 0.1, 0.4, -1.0]
    want = 0.3 + sum(machine.weight[i] * v for i, v in zip(index, x))
    want += sum(machine.factor[index[a]] @ machine.factor[index[b]] * x[a] * x[b] for a in range(5) for b in range(a))
    assert machine.raw(slots, values, dense)[0][0] == pytest.approx(want, rel=1e-5)


def _all_maximal(scores):
    """Maximal segments by their definition: highest in every way, divided left and right."""
    best, at = 0.0, None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            s = sum(scores[a:b])
            if s > best + 1e-9 or (at and abs(s - best) < 1e-9 and b - a < at[1] - at[0]):
                best, at = s, (a, b)
    if not at:
        return []
    left, right = _all_maximal(scores[:at[0]]), _all_maximal(scores[at[1]:])
    return left + [at] + [(a + at[1], b + at[1]) for a, b in right]


def test_maximal_segments_equal_the_definition():
    rng = random.Random(5)
    for _ in range(200):
        scores = [rng.choice([-3.1, -1.07, -0.53, 0.71, 2.03, 4.11]) + rng.random() / 100 for _ in range(rng.randint(0, 14))]
        got = [(a, b) for _, a, b in toxic_segments.maximal_segments(np.array(scores))]
        assert got == _all_maximal(scores)


@pytest.mark.parametrize("name", ["odd", "odd_wide", "none"])
def test_scores_of_odd_rows(request, small_labels, name):
    docs = request.getfixturevalue(name)
    n = docs.count()
    machine = quality_fm.fit(docs, small_labels, ALL, metadata=["n_chars"])
    rows = quality_fm.score(docs, machine, metadata=["n_chars"]).collect()
    assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
    model = toxic_segments.fit(docs, small_labels, ALL)
    rows = toxic_segments.score(docs, model).collect()
    assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
    rows = lattice_lm.score(docs, ALL, queries.vocabulary_path(queries.PIECES)).collect()
    assert len(rows) == n and all(r.score < 0 and math.isfinite(r.base_score) for r in rows)
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.collect())


def test_passages_point_at_their_words(spark):
    model = toxic_segments.Model({"scum$": 6.0}, 1.0, 0.0, [0.0, 1.0], 0.0, 0.1)
    docs = spark.createDataFrame([(1, "Then scum, scum of all")], "doc_id long, text string")
    row = toxic_segments.score(docs, model).first()
    assert [(p.start, p.end) for p in row.passages] == [(5, 15)]


def test_base_counts_and_likelihoods(spark):
    texts = [(0, "b a a"), (1, "a c"), (2, "A\tq"), (3, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = {r.doc_id: r for r in lattice_lm.score(docs, F.col("doc_id") != 1, queries.vocabulary_path(queries.PIECES)).collect()}
    # Training tokens: b a a end, a q end, end; distinct: a b q end.
    n, v = 8, 4
    estimate = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    assert rows[1].train_tokens == n and rows[1].n_tokens == 3 and rows[1].n_known == 2
    assert rows[1].base_score == pytest.approx(estimate(3) + estimate(0) + estimate(3))
    assert rows[3].n_tokens == 1 and rows[3].base_score == pytest.approx(estimate(3))


def test_lattice_sums_over_all_segmentations():
    pieces = lattice_lm.load_pieces(queries.vocabulary_path(queries.PIECES))
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary_path(queries.PIECES))
    known = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}

    def plain(rest):
        if not rest:
            return 1.0
        total = math.exp(sum(pieces.log_p[pieces.byte_ids[b]] for b in rest[0].encode())) * plain(rest[1:])
        return total + sum(math.exp(pieces.log_p[known[rest[:k]]]) * plain(rest[k:]) for k in range(1, len(rest) + 1) if rest[:k] in known)

    words = ["the", "ernting", "ñandú", "日本", "x", "aaaa"]
    got = lattice_lm.word_log_probabilities(words, pieces)
    assert got == pytest.approx([math.log(plain(lattice_lm.MARK + w)) for w in words])
    # The expected characters of a word are its characters, whatever the segmentation.
    out = lattice_lm.expected_counts(["ernting"], np.array([3.0]), pieces)
    sizes = {i: len(t) for t, i in known.items()}
    assert sum(n * sizes.get(i, 0) for i, n in enumerate(out)) == pytest.approx(3 * 8, rel=1e-2)


def test_hot_words_and_shuffled_words_agree(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("doc_id", "text").cache()
    path = queries.vocabulary_path(queries.PIECES)
    one = {r.doc_id: r for r in lattice_lm.score(docs, ALL, path).collect()}
    monkeypatch.setattr(lattice_lm, "HOT_WORDS", 20)
    for r in lattice_lm.score(docs, ALL, path).collect():
        assert r.n_known == one[r.doc_id].n_known
        assert r.score == pytest.approx(one[r.doc_id].score) and r.base_score == pytest.approx(one[r.doc_id].base_score)
