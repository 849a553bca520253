"""Exact top-k search against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm import topk_search
from timberline.llm.common import importable

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, asked, k, scale=64.0):
    """All pairs, in whole numbers of any size."""
    vectors = {}
    for key, x in rows:
        if key is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = [math.floor(scale * float(c)) for c in x]
        if sum(c * c for c in v) < 2**62:
            vectors[key] = min(v, vectors.get(key, v))
    out = set()
    for q in filter(asked, vectors):
        scored = sorted((-sum(a * b for a, b in zip(vectors[q], v)), key) for key, v in vectors.items() if key != q)
        out |= {(q, rank, key, -s) for rank, (s, key) in enumerate(scored[:k], 1)}
    return out


def found(spark, rows, k=20, extra=()):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({name: F.lit("x") for name in extra})
    return {tuple(r) for r in topk_search.top_k(df, F.col("id") % 5 == 0, k).collect()}


@pytest.mark.parametrize("shape", ["even", "long tail", "flat", "few values"])
def test_equals_all_pairs(spark, shape):
    importable(spark)
    draw = np.random.default_rng(7)
    x = draw.normal(size=(1500, 12)).astype(np.float32)
    if shape == "even":
        x /= np.linalg.norm(x, axis=1)[:, None]
    elif shape == "long tail":
        x *= draw.pareto(1.0, size=(1500, 1)).astype(np.float32)
    elif shape == "flat":
        x[:, 4:] *= 0.01
    else:
        x = np.sign(x) / 64
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert found(spark, rows, 7) == plain(rows, lambda i: i % 5 == 0, 7)


def test_copies_and_odd_rows(spark):
    importable(spark)
    draw = np.random.default_rng(3)
    hot = draw.normal(size=4).tolist()
    hot = [float(np.float32(c)) for c in hot]
    rows = [(i, hot) for i in range(400)] + [(i, draw.normal(size=4).astype(np.float32).tolist()) for i in range(400, 700)]
    big = float(np.float32(3e5))
    rows += [(700, None), (705, [1.0, None]), (710, [float("nan")]), (715, [float("inf")]), (720, []), (725, [1.0]), (730, [1.0] * 6),
             (None, [1.0]), (735, [1e30]), (740, [big] * 4), (745, [-big] * 4), (5, hot), (10, [0.0] * 4), (750, [3.4e7, 0.0]), (755, [3.3e7, 2e7])]
    assert found(spark, rows, extra=("id", "v", "score", "n", "lane", "query_id")) == plain(rows, lambda i: i % 5 == 0, 20)


def test_few_and_no_rows(spark):
    importable(spark)
    assert found(spark, []) == set()
    assert found(spark, [(0, [1.0])]) == set()
    assert found(spark, [(0, [1.0]), (1, [2.0])]) == {(0, 1, 1, 64 * 128)}
    assert found(spark, [(1, [1.0]), (2, [2.0])]) == set()


def test_search_prunes_without_losing_any():
    draw = np.random.default_rng(1)
    c = np.rint(draw.normal(size=(3000, 16)) * draw.pareto(2.0, size=(3000, 1)) * 50).astype(np.int64)
    c = c[np.argsort(-(c**2).sum(1), kind="stable")]
    q = np.rint(draw.normal(size=(40, 16)) * 30).astype(np.int64)
    ids = draw.permutation(3000).astype(np.int64)
    basis = np.linalg.svd(c.astype(float), full_matrices=False)[2].T
    best = topk_search.search(q, c, ids, topk_search.Best(5, np.full(40, -np.inf)), basis, 8)
    for i in range(40):
        want = sorted((-int(s), int(k)) for s, k in zip(c @ q[i], ids))[:5]
        mine = best.query == i
        assert list(zip((-best.score[mine]).tolist(), best.id[mine].tolist())) == want
