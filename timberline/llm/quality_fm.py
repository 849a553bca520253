"""Quality scores from a factorisation machine over hashed words, structure statistics and metadata.

The score of a text is a logistic function of a bias, a weight per feature and an interaction of low rank
between every two features. The sum over all pairs is half of (sum of vectors) squared minus the sum of
squared vectors, which takes time linear in the number of features.

The model is fitted on the driver from at most ``MAX_LABELLED`` labelled texts, of which only hashed counts
and statistics are fetched. Null and empty texts have statistics (all zero) and so a score. Missing
metadata counts as its mean. Without two classes in the labels every score is the share of label 1,
or 0.5 without labels.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import labelled_sample, with_text_columns

MAX_LABELLED = 12_000
WORD_SLOTS = 1 << 14
RANK = 8
EPOCHS = 12
BATCH = 256
STATISTICS = ("log_words", "mean_word", "distinct", "distinct_pairs", "capitals", "digits", "symbols", "marks", "bars",
              "exclamations", "commas_dots", "lines_per_word", "repeated_lines", "longest_word", "other_letters", "short_words")

_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&|<>"
_MARKS = b"\"'()[]{}:;-_/\\@^~`+="
_HIGH = bytes(range(128, 256))


def _share(raw: bytes, kinds: bytes) -> float:
    return (len(raw) - len(raw.translate(None, kinds))) / (len(raw) or 1)


def statistics(text: str, raw: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Structure of a whole text; all zero for a text without words."""
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    lengths = [len(w) for w in words]
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        float(np.log1p(n)), sum(lengths) / n, len(counts) / n, len(set(pairwise(words))) / max(n - 1, 1),
        _share(raw, _UPPER), _share(raw, _DIGITS), _share(raw, _SYMBOLS), _share(raw, _MARKS), _share(raw, b"|"),
        _share(raw, b"!"), _share(raw, b".,"), len(lines) / n, 1 - len(set(lines)) / max(len(lines), 1),
        float(np.log1p(max(lengths))), _share(raw, _HIGH), sum(x <= 2 for x in lengths) / n,
    ]


def features(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Hashed word slots, their damped and normalised counts, and statistics of each text."""
    slots, values, stats = [], [], []
    for text in texts:
        raw = text.encode()
        words = raw.split()
        counts = Counter(map(bytes.lower, words))
        stats.append(statistics(text, raw, words, counts))
        hashed: dict[int, int] = {}
        for word, n in counts.items():
            slot = zlib.crc32(word) % WORD_SLOTS
            hashed[slot] = hashed.get(slot, 0) + n
        x = np.log1p(np.fromiter(hashed.values(), np.float32, len(hashed)))
        slots.append(np.fromiter(hashed.keys(), np.int32, len(hashed)))
        values.append(x / (np.linalg.norm(x) or 1))
    return slots, values, np.array(stats, np.float32).reshape(len(texts), len(STATISTICS))


@dataclass
class Machine:
    """Weights and factors; the dense features follow the word slots."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def dense(self, stats: np.ndarray) -> np.ndarray:
        """Standardised statistics, within four deviations; missing ones count as the mean."""
        z = (stats - self.mean) / self.scale
        return np.clip(np.nan_to_num(z, nan=0.0), -4, 4).astype(np.float32) / 2

    def raw(self, slots: list[np.ndarray], values: list[np.ndarray], dense: np.ndarray):
        """Logits, with what the gradient needs."""
        n, d = dense.shape
        sizes = np.array([len(s) for s in slots]) + d
        columns = np.arange(WORD_SLOTS, WORD_SLOTS + d, dtype=np.int32)
        index = np.concatenate([part for s in slots for part in (s, columns)])
        value = np.concatenate([part for v, z in zip(values, dense) for part in (v, z)])
        starts = np.cumsum(sizes) - sizes
        scaled = self.factor[index] * value[:, None]
        total = np.add.reduceat(scaled, starts, axis=0)
        squares = np.add.reduceat(scaled * scaled, starts, axis=0)
        linear = np.add.reduceat(self.weight[index] * value, starts)
        logit = self.bias + linear + 0.5 * (total * total - squares).sum(axis=1)
        return logit, index, value, sizes, scaled, total

    def scores(self, slots, values, stats) -> np.ndarray:
        out = [_logistic(self.raw(slots[i:i + BATCH], values[i:i + BATCH], self.dense(stats[i:i + BATCH]))[0])
               for i in range(0, len(slots), BATCH)]
        return np.concatenate([*out, np.empty(0)])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_rows(slots, values, stats, labels, rank: int = RANK, epochs: int = EPOCHS, rate: float = 0.03,
             shrink: float = 1e-4, seed: int = 7) -> Machine:
    """Minimises log loss by Adam steps on shuffled batches; same rows, same model."""
    labels = np.asarray(labels, np.float32)
    d = stats.shape[1]
    size = WORD_SLOTS + d
    random = np.random.default_rng(seed)
    seen = ~np.isnan(stats)
    count = np.maximum(seen.sum(axis=0), 1)
    mean = np.where(seen, stats, 0).sum(axis=0) / count
    scale = np.sqrt(np.where(seen, (stats - mean) ** 2, 0).sum(axis=0) / count) + 1e-6
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(size, np.float32),
                      np.zeros((size, rank), np.float32), mean, scale)
    if not len(labels) or labels.min() == labels.max():
        return machine
    machine.factor = random.normal(0, 0.02, (size, rank)).astype(np.float32)
    parameters = [machine.weight[:, None], machine.factor]
    first = [np.zeros_like(p) for p in parameters]
    second = [np.zeros_like(p) for p in parameters]
    bias_first = bias_second = 0.0
    dense = machine.dense(stats)
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(labels))
        for begin in range(0, len(order), BATCH):
            rows = order[begin:begin + BATCH]
            logit, index, value, sizes, scaled, total = machine.raw([slots[i] for i in rows], [values[i] for i in rows], dense[rows])
            error = (_logistic(logit) - labels[rows]) / len(rows)
            each = np.repeat(error, sizes) * value
            pull = each[:, None] * (np.repeat(total, sizes, axis=0) - scaled)
            gradients = [np.bincount(index, each, size)[:, None],
                         np.stack([np.bincount(index, pull[:, k], size) for k in range(rank)], axis=1)]
            step += 1
            for p, g, a, b in zip(parameters, gradients, first, second):
                g = g + shrink * p
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            g = float(error.sum())
            bias_first += 0.1 * (g - bias_first)
            bias_second += 0.001 * (g * g - bias_second)
            machine.bias -= rate * (bias_first / (1 - 0.9**step)) / (bias_second / (1 - 0.999**step)) ** 0.5 if bias_second else 0.0
    return machine


def _with_metadata(stats: np.ndarray, columns: Sequence[list]) -> np.ndarray:
    """Metadata as further statistics, damped; a missing value is not a number."""
    if not columns:
        return stats
    more = np.array([[np.nan if v is None else float(v) for v in c] for c in columns], np.float64).T
    return np.concatenate([stats, (np.sign(more) * np.log1p(np.abs(more))).astype(np.float32)], axis=1)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", key: str = "doc_id",
        text: str = "text", metadata: Sequence[str] = (), bound: int = MAX_LABELLED) -> Machine:
    """A machine from the texts of at most ``bound`` labelled ids for which ``usable`` holds."""
    sample = labelled_sample(docs, labels, label, usable, bound, key, text, metadata)
    extra = [f"_x_{c}" for c in metadata]

    def make():
        def step(texts, *more):
            slots, values, stats = features(texts)
            return [pa.array([s.tobytes() for s in slots], pa.binary()), pa.array([v.tobytes() for v in values], pa.binary()),
                    pa.array([s.tobytes() for s in _with_metadata(stats, more)], pa.binary())]

        return step

    fields = [("_slots", "binary"), ("_values", "binary"), ("_stats", "binary")]
    # Repeated rows of an id could exceed the bound, so it is applied to the rows again.
    rows = (with_text_columns(sample, "_text", fields, make, extra).select("_id", "_label", "_slots", "_values", "_stats")
            .orderBy(F.xxhash64("_id"), "_id").limit(bound).collect())
    rows.sort(key=lambda r: (r._id, r._slots))
    d = len(STATISTICS) + len(metadata)
    return fit_rows([np.frombuffer(r._slots, np.int32) for r in rows], [np.frombuffer(r._values, np.float32) for r in rows],
                    np.array([np.frombuffer(r._stats, np.float32) for r in rows], np.float32).reshape(len(rows), d),
                    [r._label for r in rows])


def score(docs: DataFrame, machine: Machine, text: str = "text", metadata: Sequence[str] = (), name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, the likelihood of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        def step(texts, *more):
            slots, values, stats = features(texts)
            return [pa.array(shared.value.scores(slots, values, _with_metadata(stats, more)).astype(np.float64))]

        return step

    return with_text_columns(docs, text, [(name, "double")], make, metadata)
