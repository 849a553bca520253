"""BPE by speculation: longest match proposes tokens, pair checks verify them, misses are merged exactly.

A token sequence is the BPE encoding of a word exactly if every two neighbours are compatible: if no
merge ever crosses the border between them. The proposal of most words passes; the others are merged
pair by pair in rank order. Rows without a text encode to no tokens. The vocabulary is the file of a
public tokenizer, given by path; it is of the kind with an end-of-word suffix, byte symbols and a
lower-casing normaliser. Every executor needs the file at that path.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from timberline.llm.common import with_text_columns

# Entries of the per-task caches; a full cache is emptied, which costs time only.
CACHED_WORDS = 400_000
CACHED_PAIRS = 500_000
NEVER = np.int64(1) << 40
# Stands for the end of a word where words are one long text of byte characters.
_END = "\u0100"
# Symbols up to which a plain list is quicker than a heap.
SHORT = 64
# Below this letter Python lower-cases as the vocabulary's normaliser does, but for a final sigma.
PLAIN_END = "\u0590"
# Unicode white space, as the vocabulary's splitting pattern counts it.
_SPACE = r"\t-\r \x85\xa0  -     　"


@lru_cache
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _class_of(kind: str) -> str:
    """The characters below PLAIN_END of a general category, for use inside a set."""
    return "".join(re.escape(chr(c)) for c in range(ord(PLAIN_END)) if unicodedata.category(chr(c))[0] == kind)


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max(chain(vocab.values(), self.special.values()))
        self.tokens = [""] * size
        for token, i in chain(vocab.items(), self.special.items()):
            self.tokens[i] = token
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.base = [vocab[s] for s in byte_symbols()]
        self.last = [vocab[s + suffix] for s in byte_symbols()]
        # Tokens over symbols; the last symbol of a word is another one than the same byte within it.
        self.rank = np.full(size, -1, np.int64)
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            new = vocab[a + b]
            self.merges[vocab[a], vocab[b]] = (rank, new)
            if self.rank[new] < 0:
                self.rank[new], self.left[new], self.right[new] = rank, vocab[a], vocab[b]
        self.rank_of = {a << 32 | b: rank for (a, b), (rank, _) in self.merges.items()}
        self.made_by = {rank: new for rank, new in self.merges.values()}
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array([r for r, _ in self.merges.values()], np.int64)[order]
        sound = self._sound()
        unsymbol = {s: bytes([b]) for b, s in enumerate(byte_symbols())}
        self.inner, self.final = {}, {}
        for token, i in vocab.items():
            if sound[i]:
                ends = token.endswith(suffix) and i not in self.base
                raw = b"".join(unsymbol[c] for c in (token[:-len(suffix)] if ends else token))
                (self.final if ends else self.inner)[raw] = i
        # Longest token by its first two bytes: no longer match is tried there.
        self.reach = {}
        for raw in chain(self.inner, self.final):
            self.reach[raw[:2]] = max(len(raw), self.reach.get(raw[:2], 1))
        self.matcher = ahocorasick.Automaton()
        for known, end in ((self.inner, ""), (self.final, _END)):
            for raw, i in known.items():
                self.matcher.add_word(raw.decode("latin-1") + end, (len(raw) + len(end)) << 32 | i)
        self.matcher.make_automaton()
        marks = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self.marks = re.compile(f"({marks})")
        self.split_ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+").findall
        letters, numbers = (_class_of(kind) for kind in "LN")
        self.split_plain = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{_SPACE}{letters}{numbers}]+").findall
        self.split = regex.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+").findall
        self.words: dict[str, bytes] = {}  # ids as packed numbers of four bytes
        self.known_pairs, self.known_fine = np.array([-1]), np.array([True])
        self.speculated = self.merged = 0

    def first_crossing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge that first joins the end of token a with the start of token b, or NEVER.

        Walks back through both tokens' merges at once: the later of the two pieces at the border is
        taken apart, and each pair of pieces that existed side by side is looked up. Equal ranks are
        merged from the left, so the right piece is the later one.
        """
        out = np.full(len(a), NEVER)
        row = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        x_until, y_until = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(row):
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)
            crossed = (rank < x_until) & (rank <= y_until) & (rank < NEVER)
            out[row[crossed]] = np.minimum(out[row[crossed]], rank[crossed])
            rank_x, rank_y = self.rank[x], self.rank[y]
            go = (rank_x >= 0) | (rank_y >= 0)
            row, x, y, x_until, y_until = row[go], x[go], y[go], x_until[go], y_until[go]
            rank_x, rank_y = rank_x[go], rank_y[go]
            back = rank_x > rank_y
            x_until, y_until = np.where(back, rank_x, x_until), np.where(back, y_until, rank_y)
            x, y = np.where(back, self.right[x], x), np.where(back, y, self.left[y])
        return out

    def _sound(self) -> np.ndarray:
        """Which tokens their own symbols merge into; only these may be proposed."""
        made = np.flatnonzero(self.rank >= 0)
        own = np.ones(len(self.rank), bool)
        own[made] = self.first_crossing(self.left[made], self.right[made]) == self.rank[made]
        for i in made[np.argsort(self.rank[made])]:  # parts come before what is made of them
            own[i] &= own[self.left[i]] and own[self.right[i]]
        return own

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        ids, start, n = [], 0, len(word)
        inner, final, reach = self.inner, self.final, self.reach
        while start < n:
            stop = start + reach.get(word[start:start + 2], 1)
            if n <= stop and (i := final.get(word[start:])) is not None:
                ids.append(i)
                break
            for end in range(n - 1 if stop >= n else stop, start, -1):
                if (piece := word[start:end]) in inner:
                    ids.append(inner[piece])
                    start = end
                    break
            else:  # the last byte, if its own token is not sound
                ids.append(self.last[word[start]])
                start += 1
        return ids

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, lowest rank first and leftmost among equals."""
        ids = [self.base[b] for b in word[:-1]] + [self.last[word[-1]]]
        if len(ids) > SHORT:
            return self._merge_long(ids)
        rank, never = self.rank_of.get, len(self.rank_of)
        ranks = [rank(a << 32 | b, never) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < never:
            i = ranks.index(least)
            ids[i] = new = self.made_by[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | new, never)
            if i < len(ranks):
                ranks[i] = rank(new << 32 | ids[i + 1], never)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, in O(n log n)."""
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(ids) and (found := self.merges.get((ids[i], ids[j]))):
                heapq.heappush(heap, (found[0], i, ids[i], ids[j]))

        for i in range(len(ids) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = self.merges[a, b][1], -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [i for i in ids if i >= 0]

    def propose_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of many words, in one scan: tokens, and where each word's tokens start."""
        text = _END.join([w.decode("latin-1") for w in words]) + _END
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        found = np.array(list(self.matcher.iter_long(text)), np.int64).reshape(-1, 2)
        word = np.searchsorted(stops, found[:, 0])
        tokens = found[:, 1] & 0xFFFFFFFF
        # A scan can take the last byte as one within a word and leave the end over: propose again, end in mind.
        covered = np.bincount(word, found[:, 1] >> 32, len(words)).astype(np.int64)
        missed = np.flatnonzero(covered != np.diff(stops, prepend=-1))
        counts = np.bincount(word, minlength=len(words))
        if len(missed):
            again = [self.propose(words[i]) for i in missed.tolist()]
            part = np.ones(len(words), bool)
            part[missed] = False
            kept = part[word]
            word = np.concatenate([word[kept], np.repeat(missed, [len(x) for x in again])])
            tokens = np.concatenate([tokens[kept], np.fromiter(chain.from_iterable(again), np.int64)])
            order = np.argsort(word, kind="stable")
            word, tokens = word[order], tokens[order]
            counts = np.bincount(word, minlength=len(words))
        return tokens, np.concatenate([[0], np.cumsum(counts)])

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """For each pair of tokens whether no merge crosses between them; known pairs are looked up."""
        unique, back = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known_pairs, unique), len(self.known_pairs) - 1)
        fine = self.known_fine[at]
        new = np.flatnonzero(self.known_pairs[at] != unique)
        if len(new):
            fine[new] = self.first_crossing(unique[new] >> 32, unique[new] & 0xFFFFFFFF) == NEVER
            if len(self.known_pairs) > CACHED_PAIRS:
                self.known_pairs, self.known_fine = np.array([-1]), np.array([True])
            pairs = np.concatenate([self.known_pairs, unique[new]])
            order = np.argsort(pairs)
            self.known_pairs, self.known_fine = pairs[order], np.concatenate([self.known_fine, fine[new]])[order]
        return fine[back]

    def learn(self, words: Iterable[str]) -> None:
        """Encodes words not cached: all are proposed, all pairs checked at once, failing words merged."""
        words = list(words)
        raw = [w.encode() for w in words]
        tokens, starts = self.propose_all(raw)
        inside = np.ones(max(len(tokens) - 1, 0), bool)
        inside[starts[1:-1] - 1] = False  # pairs within a word only
        first = np.flatnonzero(inside)
        bad = first[~self.compatible(tokens[first] << 32 | tokens[first + 1])]
        failing = np.zeros(len(words), bool)
        failing[np.searchsorted(starts, bad, "right") - 1] = True
        ids, begin = tokens.astype(np.int32).tobytes(), (4 * starts).tolist()
        self.words.update({w: ids[a:b] for w, a, b in zip(words, begin, begin[1:])})
        for k in np.flatnonzero(failing).tolist():
            self.words[words[k]] = array("i", self.merge(raw[k])).tobytes()
        self.speculated += len(words)
        self.merged += int(failing.sum())

    def pieces(self, text: str) -> list[str]:
        """Words as the vocabulary's splitter makes them, special tokens among them."""
        if "<|" in text:
            out = []
            for k, part in enumerate(self.marks.split(text)):
                out += [part] if k % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.split_ascii(text.lower())
        if max(text) < PLAIN_END and "Σ" not in text and unicodedata.is_normalized("NFC", text):
            return self.split_plain(text.lower())
        return self.split(self.normalizer.normalize_str(text))

    def encode_packed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids start; one more start at the end."""
        parts = [self.pieces(t) for t in texts]
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        if not self.words:
            self.words.update({t: array("i", [i]).tobytes() for t, i in self.special.items()})
        if new := set(chain.from_iterable(parts)).difference(self.words):
            self.learn(new)
        get = self.words.__getitem__
        packed = [b"".join(map(get, words)) for words in parts]
        starts = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int64)
        return np.frombuffer(b"".join(packed), np.int32), starts

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, starts = self.encode_packed(texts)
        return [x.tolist() for x in np.split(ids, starts[1:-1])]

    def decode(self, ids: Iterable[int]) -> str:
        """Token strings joined by spaces: the vocabulary names no other decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


def _lists(ids: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids, pa.int32()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per worker process and file: the tables take a second to build."""
    return Codec(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with an array column of token ids of each whole text."""

    def make():
        coder = codec(path)

        def step(texts):
            return [_lists(*coder.encode_packed(texts))]

        return step

    return with_text_columns(df, text, [(ids, "array<int>")], make)


def encode_decode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` and ``decoded``, the text that those ids stand for."""

    def make():
        coder = codec(path)

        def step(texts):
            ids, starts = coder.encode_packed(texts)
            decoded = [coder.decode(ids[a:b].tolist()) for a, b in zip(starts, starts[1:])]
            return [_lists(ids, starts), pa.array(decoded, pa.string())]

        return step

    return with_text_columns(df, text, [("ids", "array<int>"), ("decoded", "string")], make)
