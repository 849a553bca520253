"""Document likelihood over all segmentations into subwords.

A word's probability is the sum over all ways to cut it into pieces of a public vocabulary, by a forward
recursion in log space; a text's is the product over its words and one end. Pieces have weights: the
vocabulary's own scores (a rank each, taken as Zipf's law) say how training words are cut, and the expected
piece counts of all training words, with those scores as prior, give the probabilities that are used. Every
character can also be spelled in byte pieces, so no text is impossible.

The work is done once per distinct word. Frequent words (at most HOT_WORDS of them, whatever the input) are
looked up from a broadcast while a text is read; its other words meet the word table in one shuffle, where
no word is frequent. Null and empty texts have the end only. Rows without an id are not held out, and
train. An empty table gives no rows; without training rows the prior alone speaks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.llm.common import written

# Words with more than 1 / HOT_WORDS of all tokens: there are fewer than HOT_WORDS of them.
HOT_WORDS = 100_000
PRIOR_COUNT = 1000.0
FLUSH_WORDS = 300_000
WORDS_AT_ONCE = 20_000
MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 20
NEVER = -1e300


@dataclass
class Pieces:
    """A vocabulary with log probabilities; the byte pieces and the end have places of their own."""

    lengths: int  # longest piece
    hashes: np.ndarray  # sorted, of ordinary pieces
    ids: np.ndarray
    table: np.ndarray
    byte_ids: np.ndarray  # by byte
    end: int
    log_p: np.ndarray  # natural logarithms, by id


def _hash_codes(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
    return h


def load_pieces(path: str) -> Pieces:
    """Pieces and their prior: a score of minus rank stands for a probability in proportion to 1 / (rank + 3)."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    byte_ids, plain = np.zeros(256, np.int64), []
    for i in range(size):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i)):
            plain.append((_hash_codes(piece), i, len(piece)))
    plain.sort()
    p = np.zeros(size)
    for _, i, _ in plain:
        p[i] = 1 / (3 - min(0.0, sp.get_score(i)))
    # Bytes and the end have no rank of their own: together a thousandth, and one piece in 500.
    p[byte_ids] = p.sum() * 0.001 / 256
    p[sp.eos_id()] = p.sum() * 0.002
    hashes = np.array([h for h, _, _ in plain], np.uint64)
    table = np.zeros(1 << _TABLE_BITS, bool)
    table[_slot(hashes)] = True
    with np.errstate(divide="ignore"):
        return Pieces(max(n for _, _, n in plain), hashes, np.array([i for _, i, _ in plain], np.int64), table,
                      byte_ids, sp.eos_id(), np.maximum(np.log(p / p.sum()), NEVER))


def _slot(h: np.ndarray) -> np.ndarray:
    return (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _TABLE_BITS)


class _Lattice:
    """The lattices of words of one length: for every start and width a piece or none."""

    def __init__(self, words: list[str], pieces: Pieces):
        self.pieces, self.n = pieces, len(words[0])
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), self.n)
        self.edges: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # start, width, rows, piece ids
        codes = self.codes.astype(np.uint64) + np.uint64(1)
        for start in range(self.n):
            h = np.zeros(len(words), np.uint64)
            for width in range(1, min(pieces.lengths, self.n - start) + 1):
                h = h * _BASE + codes[:, start + width - 1]
                rows = np.flatnonzero(pieces.table[_slot(h)])
                if not len(rows):
                    continue
                at = np.minimum(np.searchsorted(pieces.hashes, h[rows]), len(pieces.hashes) - 1)
                hit = pieces.hashes[at] == h[rows]
                if hit.any():
                    self.edges.append((start, width, rows[hit], pieces.ids[at[hit]]))
        # Every character can be spelled in bytes.
        self.letters, self.which = np.unique(self.codes, return_inverse=True)
        self.which = self.which.reshape(self.codes.shape)
        self.spelled = [pieces.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))] for c in self.letters]

    def forward(self, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log sums over all ways to reach each place, and the weights of the spelled characters."""
        spell = np.array([log_p[s].sum() for s in self.spelled])[self.which]
        alpha = np.full((len(self.codes), self.n + 1), NEVER)
        alpha[:, 0] = 0
        by_end: dict[int, list] = {}
        for edge in self.edges:
            by_end.setdefault(edge[0] + edge[1], []).append(edge)
        for end in range(1, self.n + 1):
            total = alpha[:, end - 1] + spell[:, end - 1]
            for start, _, rows, ids in by_end.get(end, ()):
                total[rows] = np.logaddexp(total[rows], alpha[rows, start] + log_p[ids])
            alpha[:, end] = total
        return alpha, spell

    def expected(self, log_p: np.ndarray, counts: np.ndarray, out: np.ndarray) -> None:
        """Adds to ``out`` how often each piece is expected in these words, each seen ``counts`` times."""
        alpha, spell = self.forward(log_p)
        beta = np.full(alpha.shape, NEVER)
        beta[:, self.n] = 0
        by_start: dict[int, list] = {}
        for edge in self.edges:
            by_start.setdefault(edge[0], []).append(edge)
        for start in range(self.n - 1, -1, -1):
            total = beta[:, start + 1] + spell[:, start]
            for _, width, rows, ids in by_start.get(start, ()):
                total[rows] = np.logaddexp(total[rows], beta[rows, start + width] + log_p[ids])
            beta[:, start] = total
        whole = alpha[:, self.n]
        for start, width, rows, ids in self.edges:
            share = np.exp(alpha[rows, start] + log_p[ids] + beta[rows, start + width] - whole[rows])
            out += np.bincount(ids, share * counts[rows], len(out))
        share = np.exp(alpha[:, :-1] + spell + beta[:, 1:] - whole[:, None]) * counts[:, None]
        for ids, n in zip(self.spelled, np.bincount(self.which.ravel(), share.ravel(), len(self.letters))):
            np.add.at(out, ids, n)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Places and marked words, in groups of one length and bounded total length."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        step = max(1, WORDS_AT_ONCE * 8 // (len(words[part[0]]) + 1)) if len(part) else 1
        for i in range(0, len(part), step):
            rows = part[i:i + step]
            yield rows, [MARK + words[k] for k in rows]


def word_log_probabilities(words: list[str], pieces: Pieces) -> np.ndarray:
    """Natural logarithm of each word's probability over all segmentations."""
    out = np.empty(len(words))
    for rows, group in _by_length(words):
        alpha, _ = _Lattice(group, pieces).forward(pieces.log_p)
        out[rows] = alpha[:, -1]
    return out


def expected_counts(words: list[str], counts: np.ndarray, pieces: Pieces) -> np.ndarray:
    out = np.zeros(len(pieces.log_p))
    for rows, group in _by_length(words):
        _Lattice(group, pieces).expected(pieces.log_p, counts[rows], out)
    return out


# --- the corpus ---------------------------------------------------------------------------------


def count_words(docs: DataFrame, trains: Column, text: str = "text") -> DataFrame:
    """(word, c, n): occurrences in training rows and in all rows. Counts are combined in each task first."""

    def run(batches):
        train, rest = Counter(), Counter()

        def flush():
            words = list(train.keys() | rest.keys())
            batch = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()).cast(pa.string()), pa.array([train[w] for w in words], pa.int64()),
                 pa.array([train[w] + rest[w] for w in words], pa.int64())], names=["word", "c", "n"])
            train.clear()
            rest.clear()
            return batch

        for batch in batches:
            for t, trains in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (train if trains else rest).update((t or "").encode().lower().split())
                if len(train) + len(rest) > FLUSH_WORDS:
                    yield flush()
        if train or rest:
            yield flush()

    found = docs.select(F.col(f"`{text}`"), trains.alias("trains")).mapInArrow(run, "word string, c bigint, n bigint")
    return found.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


@dataclass
class Corpus:
    """Totals of the training tokens, ends included."""

    tokens: int
    distinct: int
    texts: int

    def base(self, count: Column) -> Column:
        """log10 of the add-half estimate."""
        return F.log10((count + 0.5) / F.lit(self.tokens + 0.5 * (self.distinct + 1)))


def learn(words: DataFrame, texts: int, pieces: Pieces, prior: float = PRIOR_COUNT) -> Pieces:
    """The pieces with probabilities from the expected counts of all training words, and the prior."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        known, total = shared.value, 0
        for batch in batches:
            total = total + expected_counts(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float), known)
        if not isinstance(total, int):
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "n"])

    rows = (words.where("c > 0").select("word", "c").mapInArrow(run, "piece bigint, n double")
            .groupBy("piece").agg(F.sum("n").alias("n")).collect())  # at most one row per piece
    counts = np.exp(pieces.log_p) * prior
    for r in rows:
        counts[r.piece] += r.n
    counts[pieces.end] += texts
    with np.errstate(divide="ignore"):
        log_p = np.maximum(np.log(counts / counts.sum()), NEVER)
    return Pieces(pieces.lengths, pieces.hashes, pieces.ids, pieces.table, pieces.byte_ids, pieces.end, log_p)


def score(docs: DataFrame, trains: Column, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    spark = docs.sparkSession
    words = written(count_words(docs, trains, text), "word-counts")
    totals = words.agg(F.sum("c").alias("c"), F.sum(F.when(F.col("c") > 0, 1).otherwise(0)).alias("v"), F.sum("n").alias("n")).first()
    texts = docs.where(trains).count()
    corpus = Corpus((totals.c or 0) + texts, (totals.v or 0) + (texts > 0), texts)
    pieces = learn(words, texts, load_pieces(path))
    shared = spark.sparkContext.broadcast(pieces)

    def run_words(batches):
        for batch in batches:
            lp = word_log_probabilities(batch.column(0).to_pylist(), shared.value) / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lp)], names=["word", "c", "n", "lp"])

    scored = written(words.mapInArrow(run_words, "word string, c bigint, n bigint, lp double").select(
        "word", "n", "lp", corpus.base(F.col("c")).alias("base"), (F.col("c") > 0).cast("int").alias("known")), "word-scores")
    least = (totals.n or 0) // HOT_WORDS
    # Fewer than HOT_WORDS words reach this count, as their counts add up to at most all tokens.
    hot = spark.sparkContext.broadcast({r.word.encode(): (r.known, r.base, r.lp)
                                        for r in scored.where(F.col("n") > least).select("word", "known", "base", "lp").collect()})
    end = (int(texts > 0), math.log10((texts + 0.5) / (corpus.tokens + 0.5 * (corpus.distinct + 1))), pieces.log_p[pieces.end] / math.log(10))
    key_type = docs.schema[key].dataType
    schema = T.StructType().add("row", "long").add("id", key_type)
    for name, kind in (("n_tokens", "long"), ("known", "long"), ("base", "double"), ("score", "double"), ("word", "string"), ("tf", "long")):
        schema = schema.add(name, kind)

    def run_docs(batches):
        row = TaskContext.get().partitionId() << 40
        table = hot.value
        for batch in batches:
            ids = batch.column(0)
            for begin in range(0, len(batch), 500):
                whole, cold_rows, cold_words, cold_tf = [], [], [], []
                for t in batch.column(1).slice(begin, 500).to_pylist():
                    counts = Counter((t or "").encode().lower().split())
                    row += 1
                    known, base, lp, n = *end, 1
                    for w, tf in counts.items():
                        n += tf
                        if (s := table.get(w)) is not None:
                            known, base, lp = known + tf * s[0], base + tf * s[1], lp + tf * s[2]
                        else:
                            cold_rows.append(row)
                            cold_words.append(w)
                            cold_tf.append(tf)
                    whole.append((row, n, known, base, lp))
                rows, n, known, base, lp = zip(*whole)
                # A blank starts no word, so this key meets nothing and spreads the rows.
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int64()), ids.slice(begin, 500), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                     pa.array(base, pa.float64()), pa.array(lp, pa.float64()), pa.array([f" {r}" for r in rows]),
                     pa.nulls(len(rows), pa.int64())], names=schema.names)
                m = len(cold_rows)
                if m:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cold_rows, pa.int64()), pa.nulls(m, ids.type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
                         pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), pa.array(cold_words, pa.binary()).cast(pa.string()),
                         pa.array(cold_tf, pa.int64())], names=schema.names)

    parts = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run_docs, schema)
    cold = scored.where(F.col("n") <= least).select("word", F.col("known").alias("w_known"), F.col("base").alias("w_base"), "lp")
    met = parts.join(cold, "word", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return met.groupBy("row").agg(
        F.max("id").alias(key), F.max("n_tokens").alias("n_tokens"),
        F.sum(zero(F.col("known")) + zero(F.col("tf") * F.col("w_known"))).alias("n_known"),
        F.sum(zero(F.col("base")) + zero(F.col("tf") * F.col("w_base"))).alias("base_score"),
        F.sum(zero(F.col("score")) + zero(F.col("tf") * F.col("lp"))).alias("score"),
    ).select(key, "n_tokens", "n_known", F.lit(corpus.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
