"""Benchmark passages in texts, with edits: q-gram lemma, diagonal bands, banded alignment.

A passage of m characters that occurs with at most k edits shares at least m - q + 1 - kq q-grams with its
occurrence, on diagonals no further than k apart. Shared q-grams are counted in bands of diagonals that
overlap by half, so some band holds all of an occurrence's; bands that reach the bound are aligned.

Texts are compared lower-cased with runs of white space as one blank; spans refer to the text as it is.
Null and empty texts contain nothing. Items below ``LEAST_CHARS`` such characters are no evidence and are
never found. Equal items are all reported. The benchmark is taken in blocks of bounded size, each of which
is broadcast and meets every text; the texts are not shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import unused, with_text_columns

Q = 10
EDIT_RATE = 0.08
LEAST_CHARS = 2 * Q
# Characters of the benchmark in a block; its index takes about 30 bytes a character.
BLOCK_CHARS = 2_000_000
LEAKS_TYPE = "array<struct<item_id:bigint,start:int,end:int,edits:int>>"
_ARROW_LEAKS = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
_TABLE_BITS = 22
_MULTIPLIER = 0x9E3779B97F4A7C15


def normal(text: str) -> str:
    return " ".join(text.replace("Σ", "σ").lower().split())


def origins(text: str) -> list[int]:
    """For each character of the normal text its place in the text."""
    out: list[int] = []
    for word in re.finditer(r"\S+", text):
        if out:
            out.append(word.start() - 1)
        for i, c in enumerate(word[0], word.start()):
            out += [i] * len(c.replace("Σ", "σ").lower())
    return out


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


def gram_hashes(values: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every run of q values, by joining hashes of half the length."""
    if len(values) < q:
        return np.empty(0, np.uint64)
    out, width, factor, done = None, 1, _MULTIPLIER, 0
    piece = values * np.uint64(_MULTIPLIER | 1)
    while True:
        if q & width:  # this width is part of q: append it to what there is
            if out is None:
                out = piece[:len(values) - q + 1 + (q - width)].copy()
            else:
                n = len(values) - q + 1 + (q - done - width)
                out = out[:n] * np.uint64(factor) + piece[done:done + n]
            done += width
        if done == q:
            return out[:len(values) - q + 1]
        n = len(values) - 2 * width + 1
        piece = piece[:n] * np.uint64(factor) + piece[width:width + n]
        piece ^= piece >> np.uint64(29)
        factor = factor * factor % (1 << 64) | 1
        width *= 2


@dataclass
class Index:
    """The q-grams of a block of items, sorted by hash."""

    ids: list[int]
    texts: list[str]
    edits: np.ndarray  # most edits allowed, by item
    least: np.ndarray  # least shared q-grams, by item
    hashes: np.ndarray  # distinct
    first: np.ndarray  # start of each hash's postings; one more at the end
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray
    q: int


def build_index(items: list[tuple[int, str]], q: int = Q, rate: float = EDIT_RATE) -> Index:
    items = [(i, t) for i, t in ((i, normal(t or "")) for i, t in items) if len(t) >= LEAST_CHARS]
    lengths = np.array([len(t) for _, t in items], np.int64)
    # With more edits the bound would fall below one q-gram and the filter could lose occurrences.
    edits = np.minimum((lengths * rate).astype(np.int64), (lengths - q) // q)
    grams = [gram_hashes(codes(t), q) for _, t in items]
    hashes = np.concatenate([*grams, np.empty(0, np.uint64)])
    item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
    place = np.concatenate([*[np.arange(len(g)) for g in grams], np.empty(0, np.int64)])
    order = np.argsort(hashes, kind="stable")
    distinct, first = np.unique(hashes[order], return_index=True)
    table = np.zeros(1 << _TABLE_BITS, bool)
    table[_slot(distinct)] = True
    return Index([i for i, _ in items], [t for _, t in items], edits, lengths - q + 1 - edits * q, distinct,
                 np.append(first, len(hashes)), item[order].astype(np.int32), place[order].astype(np.int32), table, q)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes * np.uint64(_MULTIPLIER)) >> np.uint64(64 - _TABLE_BITS)


def bands(index: Index, texts: list[str]) -> Iterator[tuple[int, int, int]]:
    """(text, item, first diagonal) of every band that reaches its item's bound."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    hashes = gram_hashes(codes("\0".join(texts)), index.q)
    at = np.flatnonzero(index.table[_slot(hashes)])
    if not len(at) or not len(index.hashes):
        return
    found = hashes[at]
    which = np.minimum(np.searchsorted(index.hashes, found), len(index.hashes) - 1)
    hit = index.hashes[which] == found
    at, which = at[hit], which[hit]
    many = index.first[which + 1] - index.first[which]
    posting = np.repeat(index.first[which] - np.cumsum(many) + many, many) + np.arange(many.sum())
    at = np.repeat(at, many)
    item = index.item[posting].astype(np.int64)
    text = np.searchsorted(starts, at, "right") - 1
    # Diagonals of different texts are kept apart by the length of the longest item and its slack.
    gap = 2 * max(map(len, index.texts)) + 2
    diagonal = at + text * gap - index.place[posting] + gap
    step = index.edits[item] + 1
    band = diagonal // step
    span = int(band.max(initial=0)) + 2
    keys = np.concatenate([item * span + band + 1, item * span + band])  # each diagonal lies in two bands
    key, count = np.unique(keys, return_counts=True)
    item = key // span
    enough = count >= index.least[item]
    key, item = key[enough], item[enough]
    first = (key % span - 1) * (index.edits[item] + 1)  # band b holds diagonals from (b - 1) steps, two steps wide
    # The text is found from the middle of the band: its diagonals lie within a gap around the text.
    shifted = starts + np.arange(len(texts)) * gap + gap
    middle = first + index.edits[item] + 1
    text = np.clip(np.searchsorted(shifted - gap // 2, middle, "right") - 1, 0, len(texts) - 1)
    yield from zip(text.tolist(), item.tolist(), (first - shifted[text]).tolist())


@lru_cache(maxsize=2000)
def align(pattern: str, region: str, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of the pattern in the region, or None beyond ``most``.

    Dynamic programming over the pattern's characters, for all diagonals of the band at once.
    """
    at = region.find(pattern)
    if at >= 0:
        return 0, at, at + len(pattern)
    found = _best_end(pattern, region, most, free_start=True)
    if found is None:
        return None
    edits, end = found
    back = _best_end(pattern[::-1], region[:end][::-1], most, free_start=False)
    return edits, end - (back[1] if back else len(pattern)), end


def _best_end(pattern: str, region: str, most: int, free_start: bool) -> tuple[int, int] | None:
    p, r = codes(pattern).astype(np.int64), codes(region).astype(np.int64)
    m, n = len(p), len(r)
    low = -most  # diagonals: place in region minus place in pattern
    width = (n - m if free_start else 0) + 2 * most + 1
    if width <= 0:
        return None
    padded = np.concatenate([np.full(most, -1), r, np.full(m + width, -1)])
    column = np.arange(width)
    inside = column + low
    far = m + n + 1
    row = np.where((inside >= 0) & (inside <= n), 0 if free_start else inside, far)
    for i in range(m):
        other = padded[i:i + width]  # region character that diagonal ``column`` reads at row i
        new = row + (other != p[i])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        ends = column + low + i + 1
        new[(ends < 0) | (ends > n)] = far
        row = np.minimum.accumulate(new - column) + column
        if row.min() > most:
            return None
    ends = column + low + m
    row = np.where((ends < 0) | (ends > n), far, row)
    best = int(row.argmin())
    return (int(row[best]), int(ends[best])) if row[best] <= most else None


def find(index: Index, texts: list[str]) -> list[list[dict]]:
    """For each text its leaks: the best occurrence of every item that occurs, by item id."""
    plain = [normal(t) for t in texts]
    best: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
    for text, item, first in bands(index, plain):
        edits = int(index.edits[item])
        begin = max(0, first - edits)
        region = plain[text][begin:first + 2 * (edits + 1) + len(index.texts[item]) + edits]
        if got := align(index.texts[item], region, edits):
            got = (got[0], got[1] + begin, got[2] + begin)
            best[text][item] = min(got, best[text].get(item, got))
    out = []
    for text, hits in zip(texts, best):
        if not hits:
            out.append([])
            continue
        where = origins(text)
        out.append(sorted(({"item_id": index.ids[i], "start": where[s], "end": where[e - 1] + 1, "edits": d}
                           for i, (d, s, e) in hits.items()), key=lambda x: (x["item_id"], x["start"])))
    return out


def with_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", leaks: str = "leaks",
               item: str = "item_id", item_text: str = "text", q: int = Q, rate: float = EDIT_RATE) -> DataFrame:
    """``df`` with an array column of the benchmark items that each whole text contains."""
    spark = df.sparkSession
    items = benchmark.select(F.col(f"`{item}`").cast("bigint").alias("i"), F.col(f"`{item_text}`").alias("t"))
    chars = items.agg(F.sum(F.char_length("t"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS) or 1
    out, parts = df.drop(leaks), []
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast(build_index([tuple(r) for r in own.collect()], q, rate))
        name = leaks if blocks == 1 else unused(out, f"{leaks}_{b}")

        def make(shared=shared):
            def step(texts):
                return [pa.array(find(shared.value, texts), _ARROW_LEAKS)]

            return step

        out = with_text_columns(out, text, [(name, LEAKS_TYPE)], make)
        parts.append(name)
    if blocks > 1:
        out = out.withColumn(leaks, F.flatten(F.array(*[F.col(p) for p in parts]))).drop(*parts)
    return out


def has_leak(leaks: str = "leaks") -> Column:
    return F.size(leaks) > 0
