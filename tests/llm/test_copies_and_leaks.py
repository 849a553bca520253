"""SimHash near copies and benchmark leaks."""

import random

import numpy as np
import pytest
import xxhash

from timberline.llm import qgram_leaks, queries, simhash_ball
from timberline.llm.common import importable

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(prints, distance):
    """Smallest place linked with each, by looking at all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance and find(i) != find(j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_query_against_all_pairs(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op3_simhash_ball(spark, SF).collect()
    ids = sorted(docs)
    prints = [plain_fingerprint(docs[i]) for i in ids]
    roots = plain_roots(prints, 4)
    assert len(rows) == len(ids)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{p:016x}", ids[r]) for i, p, r in zip(ids, prints, roots)}


@pytest.mark.parametrize("at_once", [4_000_000, 3000])
def test_balls_link_what_pairs_link(spark, monkeypatch, at_once):
    monkeypatch.setattr(simhash_ball, "WORDS_AT_ONCE", at_once)
    rng = random.Random(at_once)
    prints = [rng.getrandbits(64) for _ in range(10)]
    for _ in range(60):  # chains and clusters at distances up to six
        p = rng.choice(prints)
        for bit in rng.sample(range(64), rng.randint(1, 6)):
            p ^= 1 << bit
        prints.append(p)
    prints = np.unique(np.array(prints, np.uint64))
    label = np.arange(len(prints))
    simhash_ball.linked(prints, np.full(len(prints), 2), 0, label)
    assert label.tolist() == plain_roots([int(p) for p in prints], 4)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (7, 7)]
    got = {r.node: r.root for r in simhash_ball.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


@pytest.mark.parametrize("name", ["odd", "odd_wide", "none"])
def test_near_copies_of_odd_rows(request, name):
    docs = request.getfixturevalue(name)
    rows = simhash_ball.near_copies(docs).collect()
    assert len(rows) == docs.count()
    empty = {r.component_id for r in rows if r.fingerprint == 0}
    assert empty <= {2}  # the smallest id among texts without words
    kept = simhash_ball.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r.component for r in rows})
    if rows:
        assert kept.where("doc_id = 1").count() == 1 and kept.where("doc_id = 3").count() == 0


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def test_leaks_with_edits_are_found_with_their_distance(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = qgram_leaks.build_index(items)
    rng = random.Random(3)
    for _ in range(40):
        place = rng.randrange(len(items))
        item, text = items[place]
        chars = list(text)
        for _ in range(rng.randint(0, int(index.edits[place]))):
            at = rng.randrange(len(chars))
            rng.choice([lambda: chars.__setitem__(at, "q"), lambda: chars.__delitem__(at), lambda: chars.insert(at, "w")])()
        whole = "xx " * rng.randint(0, 30) + "".join(chars) + " zz\n\nyy" * rng.randint(0, 30)
        distance = plain_distance(qgram_leaks.normal(text), qgram_leaks.normal(whole))
        found = [x for x in qgram_leaks.find(index, ["before", whole, "after"])[1] if x["item_id"] == item]
        assert found and found[0]["edits"] == distance
        span = whole[found[0]["start"]:found[0]["end"]]
        assert plain_distance(qgram_leaks.normal(span), qgram_leaks.normal(text)) <= distance


def test_leak_query_against_plain_search(spark):
    items = [(r.item_id, qgram_leaks.normal(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {(d.doc_id, i) for d in docs for i, t in items if t in qgram_leaks.normal(d.text or "")}
    rows = queries.op4_qgram_leaks(spark, SF).collect()
    assert {(r.doc_id, r.item_id) for r in rows if not r.edits} == want and want
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows})


@pytest.mark.parametrize("name", ["odd", "odd_wide", "none"])
def test_leaks_of_odd_rows(spark, request, name, monkeypatch):
    docs = request.getfixturevalue(name)
    bench = spark.createDataFrame([(1, "reed of  ERNT thanon the reed"), (2, "short"), (3, None), (4, "")], "item_id long, text string")
    rows = qgram_leaks.with_leaks(docs, bench).collect()
    assert len(rows) == docs.count()
    assert {r.doc_id for r in rows if r.leaks} == ({5} if rows else set())
    monkeypatch.setattr(qgram_leaks, "BLOCK_CHARS", 10)
    again = qgram_leaks.with_leaks(docs, bench).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert qgram_leaks.with_leaks(docs, bench.limit(0)).where(qgram_leaks.has_leak()).count() == 0


def test_blocks_of_the_benchmark_keep_the_columns(spark, monkeypatch):
    importable(spark)
    items = [(i, " ".join(f"{w}{i}x" for w in ("reed", "thanon", "ernt", "wherer", "ouedti", "blere"))) for i in range(6)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, f"so {t} it is", "mine") for i, t in items], "doc_id long, text string, leaks_0 string")
    monkeypatch.setattr(qgram_leaks, "BLOCK_CHARS", 60)
    found = qgram_leaks.with_leaks(docs, benchmark)
    assert found.columns == ["doc_id", "text", "leaks_0", "leaks"]
    assert {(r.doc_id, r.leaks_0, tuple(x.item_id for x in r.leaks)) for r in found.collect()} == {(i, "mine", (i,)) for i, _ in items}
