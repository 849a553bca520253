"""Cross-tokenizer alignment and the perfect hash against plain versions."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from timberline.llm import perfect_hash, queries, token_alignment
from timberline.llm.common import importable
from tests.llm.conftest import DOC_SCHEMA

A_PATH, B_PATH = queries.vocabulary_path(queries.BYTE_BPE), queries.vocabulary_path(queries.PIECES)


def plain_tokens():
    """A function from a text to [(id, bytes)] by A and B, encoded whole."""
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    letters = token_alignment.byte_of_letter()
    names = {i: t for t, i in a.get_vocab().items()}

    def tokens(text):
        if not text:
            return [], []
        first = [(i, bytes(letters[c] for c in names[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        second = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (first, second) if all(b"".join(x for _, x in side) == whole for side in (first, second)) else ([], [])

    return tokens


def plain(rows):
    """The contract, pair by pair."""
    tokens, docs = plain_tokens(), []
    counts, most = Counter(), Counter()
    for key, text in rows:
        sides = tokens(text)
        spans = []
        for side in sides:
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = [(x, y) for x, s, e in spans[0] for y, u, v in spans[1] if s < v and u < e] if len(spans[0]) < 400 else _links(spans)
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, low = [], 0
        for high in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= high) for side in spans) if len(cuts) < 400 else "")
            low = high
        if len(cuts) >= 400:
            groups = _groups(spans, cuts)
        docs.append((key, spans, len(cuts), links, ";".join(groups)))
        counts.update(set(links))
    for (x, _), c in counts.items():
        most[x] = max(most[x], c)
    return sorted((str((key, len(s[0]), len(s[1]), n, len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links),
                        hashlib.sha256(text.encode()).hexdigest() if s[0] else "")) for key, s, n, links, text in docs))


def _links(spans):
    out, j = [], 0
    for x, s, e in spans[0]:
        while spans[1][j][2] <= s:
            j += 1
        k = j
        while k < len(spans[1]) and spans[1][k][1] < e:
            out.append((x, spans[1][k][0]))
            k += 1
    return out


def _groups(spans, cuts):
    out, at = [], [0, 0]
    for high in cuts:
        sides = []
        for n, side in enumerate(spans):
            ids = []
            while at[n] < len(side) and side[at[n]][2] <= high:
                ids.append(str(side[at[n]][0]))
                at[n] += 1
            sides.append(",".join(ids))
        out.append("|".join(sides))
    return out


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = ["  two  blanks ", " a", "a ", " ", "\n", "a\n b\n\n c \t d", "a   b　 c", "x\x1c y \x85 z", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ under ▁x",
       "日本語 テキスト 🙂🙂 é é", "don't we'll I'M  's", "a" * 3000, "ab " * 2000, "﻿bom ​ zero‍", "1234567 12 3,4.5", "\x00 nul", "  \n  x", "İ ﬁ ½"]


def found(df):
    return sorted(str(tuple(r)) for r in token_alignment.aligned(df, A_PATH, B_PATH).select(*COLUMNS).collect())


def test_query_equals_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(str(tuple(r)) for r in queries.op11_token_alignment(spark, sf).select(*COLUMNS).collect())
    assert got == plain(rows)


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_odd_texts(spark, odd, odd_wide, none, monkeypatch, most):
    importable(spark)
    monkeypatch.setattr(token_alignment, "MOST_PAIRS", most)
    rows = [(100 + i, t) for i, t in enumerate(ODD)]
    more = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], DOC_SCHEMA)
    rows += [tuple(r) for r in odd.select("doc_id", "text").collect()]
    want = plain(rows)
    assert found(odd.unionByName(more)) == want
    assert found(odd_wide.withColumns({"key": F.lit(1), "a": F.lit(2), "pair": F.lit(3)}).unionByName(more, allowMissingColumns=True)) == want
    assert found(none) == []


def test_parts_do_not_change_tokens():
    two, tokens = token_alignment.TwoTokenizers(A_PATH, B_PATH), plain_tokens()
    assert two.by_parts
    for text, (a, b) in zip(ODD, two.encode(ODD)):
        assert ([i for i, _ in tokens(text)[0]], [i for i, _ in tokens(text)[1]]) == (a.tolist(), b.tolist()), text


@pytest.mark.parametrize("count", [0, 1, 2, 50, 20000])
def test_perfect_hash(spark, count):
    importable(spark)
    keys = np.unique(np.random.default_rng(5).integers(-2**62, 2**62, count)) if count > 2 else np.arange(count) - 1
    index = perfect_hash.build(spark.createDataFrame([(int(k),) for k in keys], "pair long"), "pair", len(keys))
    assert sorted(index.index(keys).tolist()) == list(range(len(keys)))
    others = index.index(np.arange(1000, dtype=np.int64))
    assert not len(keys) or (0 <= others.min() and others.max() < len(keys))


def test_vectors_are_summed_in_rounds(spark):
    importable(spark)
    rows = [(block, lane, 2, np.array([lane, 300, block], "u2").tobytes()) for block in range(3) for lane in range(16) for _ in range(5)]
    df = spark.createDataFrame(rows, "block int, lane int, width int, counts binary")
    twice = token_alignment._summed(token_alignment._summed(df, "block", "lane"), "block").collect()
    got = {r.block: np.frombuffer(r.counts, f"u{r.width}").tolist() for r in twice}
    assert got == {b: [5 * 120, 80 * 300, 80 * b] for b in range(3)}
