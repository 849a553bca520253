"""Alignment of two tokenizers over the same texts, and how many documents link each pair of their tokens.

Both tokenizers cut the text with a space before it; A is a byte-level BPE of the tokenizers library, B a piece model
of sentencepiece, which adds that space itself. Two tokens are linked where their byte ranges overlap. Offsets at
which tokens of both end cut the tokens into groups. A pair's count is the number of documents that link it.

The distinct pairs get a minimal perfect hash. Every task counts documents in a dense vector by that index; the
vectors are summed in two rounds, in blocks, through the shuffle. A second pass aligns the documents again and looks the counts up, where the
pair stored at an index must be the one that was asked for. How many pairs there are depends on the
vocabularies more than on the corpus; it is measured, and beyond MOST_PAIRS counts are joined by a shuffle
instead, with the same result.

Texts are encoded once: the token ids are a written table. Neither tokenizer merges across a space that
stands after another character and before one that is no white space, so texts are cut there and the parts'
tokens are kept by the task. A vocabulary for which that does not hold is applied to whole texts. A part without
such a space goes to the tokenizers whole, however long it is.

Null and empty texts, and those whose tokens of A or B do not join to the space and the text (B can't tell U+2581
from a space), have no tokens: zeros, and the empty string as digest. Every row is a document, also repeated
ones. Columns other than key and text are not used. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import chunks, join_counted, with_text_columns, written
from timberline.llm.perfect_hash import PerfectHash, build

# Distinct pairs that vectors and the broadcast table hold; 16 bytes each.
MOST_PAIRS = 4_000_000
# Parts of texts that a task keeps, and pairs that it remembers to have sent.
CACHED_PARTS = 300_000
CACHED_IDS = 4_000_000
SENT_PAIRS = 2_000_000
# Parts handed to the tokenizers at once: what they return of each is large.
PARTS_AT_ONCE = 4_096
STEP_CHARS = 500_000
# Tokens aligned in one step, pairs in a block of a vector, and first-round sums of a block.
RUN_TOKENS = 500_000
BLOCK = 65_536
FIRST_SUMS = 16

_cuts = re.compile(r"(?<=[^ ]) (?=\S)").split
_odd = re.compile(r"^ | (?!\S)").search


def byte_of_letter() -> dict[str, int]:
    """The bytes that the letters of a byte-level vocabulary stand for.

    Printable bytes stand for themselves; the others follow each other from 256 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ragged:
    """Lists of token ids one after the other, to which more are added."""

    def __init__(self):
        self.data, self.used = np.zeros(1024, np.int32), 0
        self.starts, self.lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        end = self.used + len(ids)
        if end > len(self.data):
            self.data = np.concatenate([self.data[:self.used], np.zeros(end + len(self.data), np.int32)])
        self.data[self.used:end] = ids
        self.starts.append(self.used + np.cumsum(sizes) - sizes)
        self.lengths.append(sizes)
        self.used = end

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists ``which`` joined, and their lengths."""
        self.starts, self.lengths = [np.concatenate(self.starts)], [np.concatenate(self.lengths)]
        starts, lengths = self.starts[0][which], self.lengths[0][which]
        before = np.cumsum(lengths) - lengths
        return self.data[np.repeat(starts - before, lengths) + np.arange(lengths.sum())], lengths


class TwoTokenizers:
    """Token ids of texts by both tokenizers, with the tokens of parts kept."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_of_letter()
        a_bytes = {i: bytes(map(letters.__getitem__, t)) if set(t) <= letters.keys() else t.encode() for t, i in self.a.get_vocab().items()}
        self.a_bytes = [a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        self.a_sizes = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_sizes = np.array([len(t) for t in self.b_bytes], np.int64)
        before = self.a.pre_tokenizer
        self.by_parts = (self.a.normalizer is None and isinstance(before, ByteLevel) and before.use_regex
                         and not before.add_prefix_space and not any("▁" in p.lstrip("▁") for p in pieces))
        self.empty()

    def empty(self) -> None:
        self.known: dict[str, int] = {}
        self.a_lists, self.b_lists = Ragged(), Ragged()
        self.good: list[np.ndarray] = []

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text by A, with a space before it, and by B, which adds it; None if either's tokens do not join to that."""
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b = self.b.encode(text)
        bytes_ = (" " + text).encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != bytes_ or b"".join(map(self.b_bytes.__getitem__, b)) != bytes_:
            return None
        return np.array(a, np.int32), np.array(b, np.int32)

    def learn(self, parts: list[str]) -> None:
        """Keeps the ids of parts; of those that stand between single spaces many are encoded as one text."""
        single = [p for p in parts if not self.by_parts or not p or p[0].isspace() or p[-1] == " "]
        joined = list(set(parts).difference(single))
        for at in range(0, len(joined), PARTS_AT_ONCE):
            self._learn_joined(joined[at:at + PARTS_AT_ONCE])
        for p in single:
            self._learn_joined([p])

    def _learn_joined(self, parts: list[str]) -> None:
        ids = self.whole(" ".join(parts))
        if ids is None and len(parts) > 1:
            half = len(parts) // 2
            self._learn_joined(parts[:half])
            self._learn_joined(parts[half:])
            return
        ends = np.cumsum([1 + len(p.encode()) for p in parts])
        for side, sizes, lists in zip(ids or [np.zeros(0, np.int32)] * 2, (self.a_sizes, self.b_sizes), (self.a_lists, self.b_lists)):
            # Every part ends where a token ends.
            last = np.searchsorted(np.cumsum(sizes[side]), ends) + 1 if ids else np.zeros(len(parts), np.int64)
            lists.add(side, np.diff(last, prepend=0))
        self.good.append(np.full(len(parts), ids is not None))
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts))))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and of B for each text, without any where the tokens do not join to it."""
        none = np.zeros(0, np.int32)
        parts_of = []
        for t in texts:
            if not t:
                parts_of.append([])
            elif not self.by_parts:
                parts_of.append([t])
            else:
                parts_of.append(_cuts(t) if _odd(t) else t.split(" "))
        new = list(set(chain.from_iterable(parts_of)).difference(self.known))
        if new:
            self.learn(new)
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts_of)), np.int64)
        out = []
        if len(which):
            good = np.concatenate(self.good)
            self.good = [good]
            a, a_sizes = self.a_lists.gather(which)
            b, b_sizes = self.b_lists.gather(which)
        at = a_at = b_at = 0
        for text, parts in zip(texts, parts_of):
            if not parts:
                out.append((none, none))
                continue
            mine = slice(at, at + len(parts))
            a_end, b_end = a_at + int(a_sizes[mine].sum()), b_at + int(b_sizes[mine].sum())
            if good[which[mine]].all():
                out.append((a[a_at:a_end], b[b_at:b_end]))
            else:  # parts that differ could still join to the whole
                out.append(self.whole(text) or (none, none))
            at, a_at, b_at = mine.stop, a_end, b_end
        if len(self.known) > CACHED_PARTS or self.a_lists.used > CACHED_IDS:
            self.empty()
        return out


def encoded(docs: DataFrame, key: str, text: str, a_path: str, b_path: str) -> DataFrame:
    """(key, a, b): the ids of each row's text as four-byte numbers, written once."""
    def make():
        two = TwoTokenizers(a_path, b_path)

        def step(texts: list[str]) -> list[pa.Array]:
            ids = [x for part in chunks(texts, STEP_CHARS) for x in two.encode(part)]
            return [pa.array([x[side].tobytes() for x in ids], pa.binary()) for side in (0, 1)]

        return step

    narrow = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return written(with_text_columns(narrow, "text", [("a", "binary"), ("b", "binary")], make).select("key", "a", "b"), "token-ids", codec="zstd")


class Forms:
    """Written ids: of A with a comma or ``|``, then from ``of_b`` on of B with a comma or ``;``; zeros fill up."""

    def __init__(self, a_count: int, b_count: int):
        self.of_b = 2 * a_count
        written = [str(i).encode() + end for count, mark in ((a_count, b"|"), (b_count, b";")) for i in range(count) for end in (b",", mark)]
        self.sizes = np.array([len(w) for w in written], np.int64)
        width = int(self.sizes.max())
        self.letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in written), np.uint8).reshape(-1, width)


class Links:
    """The alignment of a run of documents: links, and the documents' groups."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], a_lengths: np.ndarray, b_lengths: np.ndarray):
        self.docs = len(a)
        self.n_a, self.n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        self.a, self.b = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
        # Both sides of a document have the same bytes, so one count of bytes serves all documents.
        self.a_ends, self.b_ends = np.cumsum(a_lengths[self.a]), np.cumsum(b_lengths[self.b])
        size = int(self.a_ends[-1]) + 1 if len(self.a) else 1
        self.end_a, self.end_b = np.zeros(size, bool), np.zeros(size, bool)
        self.end_a[self.a_ends], self.end_b[self.b_ends] = True, True
        # Between two neighbouring ends lies the overlap of exactly one pair.
        ends = np.flatnonzero(self.end_a | self.end_b)
        i, j = (np.cumsum(e, dtype=np.int32)[ends] - e[ends] for e in (self.end_a, self.end_b))
        self.pairs = self.a[i] << 32 | self.b[j]
        self.doc = np.repeat(np.arange(self.docs), self.n_a)[i]
        self.n_groups = np.bincount(self.doc[(self.end_a & self.end_b)[ends]], minlength=self.docs)
        self.n_links = np.bincount(self.doc, minlength=self.docs)

    def per_document(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, times), each pair of a document once."""
        order = np.lexsort((self.pairs, self.doc))
        doc, pairs = self.doc[order], self.pairs[order]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pairs[1:] != pairs[:-1])])) if len(doc) else np.zeros(0, np.int64)
        return doc[first], pairs[first], np.diff(first, append=len(doc))

    def digests(self, forms: Forms) -> list[str]:
        """Digest of ``a1,a2|b1;a3|b2,b3``: ids by group, A's before B's."""
        if not len(self.a):
            return [""] * self.docs
        both = np.cumsum(self.end_a & self.end_b, dtype=np.int32)
        group_a, group_b = (both[e] - (self.end_a & self.end_b)[e] for e in (self.a_ends, self.b_ends))
        groups = int(both[-1])
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        before_b, through_a = np.cumsum(in_b) - in_b, np.cumsum(in_a)
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        # Written forms come in twos: with a comma, and with the mark that ends A's or B's ids of a group.
        last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
        codes[np.arange(len(self.a)) + before_b[group_a]] = 2 * self.a + last_a
        codes[np.arange(len(self.b)) + through_a[group_b]] = 2 * self.b + last_b + forms.of_b
        shown = forms.letters[codes]
        text = shown[shown > 0].tobytes()
        ends = np.concatenate([[0], np.cumsum(forms.sizes[codes])])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        # The mark after a document's last id is left out.
        return [hashlib.sha256(text[at:end - 1]).hexdigest() if end > at else "" for at, end in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _runs(batches: Iterator[pa.RecordBatch], lengths: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[pa.Array, Links]]:
    """Runs of documents (key, a, b) with their alignment; a longer document is a run of its own."""
    keys, a, b, held, kind = [], [], [], 0, None
    for batch in batches:
        kind = batch.schema.field(0).type
        for key, *ids in zip(*(c.to_pylist() for c in batch.columns)):
            x, y = (np.frombuffer(i, np.int32) for i in ids)
            if keys and held + len(x) + len(y) > RUN_TOKENS:
                yield pa.array(keys, kind), Links(a, b, *lengths)
                keys, a, b, held = [], [], [], 0
            keys.append(key)
            a.append(x)
            b.append(y)
            held += len(x) + len(y)
    if keys:
        yield pa.array(keys, kind), Links(a, b, *lengths)


def distinct_pairs(tokens: DataFrame, lengths: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    def run(batches):
        sent = np.zeros(0, np.int64)
        for _, links in _runs(batches, lengths):
            new = np.setdiff1d(links.pairs, sent)
            sent = np.union1d(sent, new) if len(sent) < SENT_PAIRS else new
            yield pa.RecordBatch.from_arrays([pa.array(new)], names=["pair"])

    return written(tokens.mapInArrow(run, "pair long").distinct(), "distinct-pairs")


def _summed(blocks: DataFrame, *keys: str) -> DataFrame:
    """(block, lane, counts): count vectors (block, lane, width, counts) summed by ``keys`` as they stream by."""
    def run(batches):
        current, total = None, None
        for batch in batches:
            for row in batch.to_pylist():
                place = tuple(row[k] for k in keys)
                counts = np.frombuffer(row["counts"], f"u{row['width']}")
                if place != current:
                    if current:
                        yield _block_row(current[0], lane, total)
                    current, total = place, np.zeros(len(counts), np.uint64)
                lane = row["lane"]
                total += counts
        if current:
            yield _block_row(current[0], lane, total)

    return blocks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, blocks.schema)


def _block_row(block: int, lane: int, counts: np.ndarray) -> pa.RecordBatch:
    most = int(counts.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int32()), pa.array([lane], pa.int32()), pa.array([width], pa.int32()), pa.array([counts.astype(f"u{width}").tobytes()])],
        names=["block", "lane", "width", "counts"])


def pair_counts(tokens: DataFrame, lengths: tuple[np.ndarray, np.ndarray], index: PerfectHash) -> np.ndarray:
    """The number of documents that link each pair, by the pair's index."""
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast(index)
    size = len(index)

    def run(batches):
        counts = np.zeros(size, np.uint32)
        lane = TaskContext.get().partitionId() % FIRST_SUMS
        for _, links in _runs(batches, lengths):
            _, pairs, _ = links.per_document()
            values, times = np.unique(pairs, return_counts=True)
            counts[shared.value.index(values)] += times.astype(np.uint32)
        for at in range(0, size, BLOCK):
            if (part := counts[at:at + BLOCK]).any():
                yield _block_row(at // BLOCK, lane, part)

    vectors = tokens.mapInArrow(run, "block int, lane int, width int, counts binary")
    rows = written(_summed(_summed(vectors, "block", "lane"), "block"), "pair-counts").collect()
    out = np.zeros(size, np.int64)
    for r in rows:
        part = np.frombuffer(r.counts, f"u{r.width}")
        out[r.block * BLOCK:r.block * BLOCK + len(part)] = part
    return out


def _by_table(tokens: DataFrame, lengths, pairs: DataFrame, count: int) -> Callable:
    """A function that gives a run's (best, sums), from a broadcast table of at most MOST_PAIRS pairs."""
    index = build(pairs, "pair", count)
    counts = pair_counts(tokens, lengths, index)
    keys = np.zeros(count, np.int64)
    members = np.asarray(pairs.toArrow().column("pair"))
    keys[index.index(members)] = members
    most = np.zeros(len(lengths[0]), np.int64)
    np.maximum.at(most, keys >> 32, counts)
    shared = tokens.sparkSession.sparkContext.broadcast((index, keys, counts, counts == most[keys >> 32]))

    def look_up(links: Links) -> tuple[np.ndarray, np.ndarray]:
        index, keys, counts, best = shared.value
        at = index.index(links.pairs)
        if len(at) and (keys[at] != links.pairs).any():
            raise RuntimeError("a pair has no index")
        n_best = np.bincount(links.doc, weights=best[at] if len(at) else None, minlength=links.docs)
        doc = np.flatnonzero(np.diff(links.doc, prepend=-1))
        sums = np.zeros(links.docs, np.int64)
        if len(at):
            sums[links.doc[doc]] = np.add.reduceat(counts[at], doc)
        return n_best.astype(np.int64), sums

    return look_up


_MEASURES = ("n_a", "n_b", "n_groups", "n_links")


def aligned(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    n_best: links whose pair has the highest count of all pairs of its token of A; count_sum: counts over all links.
    """
    two = TwoTokenizers(a_path, b_path)
    lengths = two.a_sizes, two.b_sizes
    sizes = len(two.a_bytes), len(two.b_bytes)
    tokens = encoded(docs, key, text, a_path, b_path)
    pairs = distinct_pairs(tokens, lengths)
    count = pairs.count()
    look_up = _by_table(tokens, lengths, pairs, count) if count <= MOST_PAIRS else None
    kind = tokens.schema["key"].dataType.simpleString()
    numbered = tokens if look_up else _numbered(tokens)

    def run(batches):
        forms = Forms(*sizes)
        for keys, links in _runs(batches, lengths):
            columns = [pa.array(getattr(links, m), pa.int64()) for m in _MEASURES]
            columns += [pa.array(x) for x in look_up(links)] if look_up else [pa.nulls(links.docs, pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([keys, *columns, pa.array(links.digests(forms), pa.string())],
                                             names=["key", *_MEASURES, "n_best", "count_sum", "groups_sha256"])

    fields = ", ".join(f"{m} long" for m in (*_MEASURES, "n_best", "count_sum"))
    if look_up:
        out = tokens.mapInArrow(run, f"key {kind}, {fields}, groups_sha256 string")
    else:
        rows = numbered.select("number", "a", "b").mapInArrow(run, f"key long, {fields}, groups_sha256 string").drop("n_best", "count_sum")
        sums = _by_shuffle(numbered, lengths)
        out = (numbered.select("number", "key").join(rows.withColumnRenamed("key", "number"), "number").join(sums, "number", "left")
               .select("key", *_MEASURES, F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256"))
    return out.withColumnRenamed("key", key)


def _numbered(tokens: DataFrame) -> DataFrame:
    return written(tokens.withColumn("number", F.monotonically_increasing_id()), "numbered-ids", codec="zstd")


def _by_shuffle(numbered: DataFrame, lengths) -> DataFrame:
    """(number, n_best, count_sum): any number of distinct pairs, with counts joined by the shuffle."""
    def run(batches):
        for keys, links in _runs(batches, lengths):
            doc, pairs, times = links.per_document()
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(keys)[doc]), pa.array(pairs), pa.array(times)], names=["number", "pair", "times"])

    links = written(numbered.select("number", "a", "b").mapInArrow(run, "number long, pair long, times long"), "links")
    counts = links.groupBy("pair").agg(F.count("*").alias("n"))
    most = counts.groupBy(F.shiftright("pair", 32).alias("x")).agg(F.max("n").alias("most"))
    counts = written(counts.join(most, F.shiftright("pair", 32) == F.col("x")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "link-counts")
    joined = join_counted(links, counts, "pair", "n", links.count())
    return joined.groupBy("number").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                        F.sum(F.col("times") * F.col("n")).alias("count_sum"))
