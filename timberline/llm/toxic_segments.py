"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme-value theory.

Every token has a score: the log-odds of toxic against other texts, with a Dirichlet prior. Tokens are
words and the beginnings of words; a word has the score of its longest token with a significant one, and
costs a constant without. A linear scan over running sums finds
all maximal segments (Ruzzo and Tompa, 1999). A segment of score S in a text of n tokens is expected
K n exp(-lambda S) times by chance (Karlin and Altschul, 1990); the evidence of a text is the sum of the
negative logarithms of these numbers over its significant segments, and a logistic function makes it a
probability.

The model is fitted from at most ``MAX_LABELLED`` labelled texts, equal texts counted once. Null and empty
texts have no tokens and no evidence. Without labels of both classes every text gets the share of toxic
labels, or zero.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import labelled_sample, with_text_columns, written

MAX_LABELLED = 20_000
PREFIXES = (3, 4, 5, 6, 7)
# A token counts from so many toxic texts and such a share of toxic words on; MARGIN is in nats, on top
# of the logarithm of the number of tokens tested.
LEAST_TEXTS = 3
LEAST_SHARE = 0.85
MARGIN = 1.0
PRIOR = 0.5
DRIFT = -0.25
MOST_SCORE = 8.0
CACHED_WORDS = 150_000
# Counts that a task holds before it sends them on, and characters of a text whose words are listed at a time.
HELD_TOKENS = 200_000
# Sizes of written tables: texts of the sample in a file, and tokens that come from a text on average.
TEXTS_A_FILE = 500
TOKENS_A_TEXT = 50
PART_CHARS = 200_000
# Evidence beyond this adds nothing; it keeps the logistic fit finite.
MOST_EVIDENCE = 200.0

words_of = re.compile(r"[^\W\d_]+").findall
spans_of = re.compile(r"[^\W\d_]+").finditer
_blank = re.compile(r"[ \n]").search


def parts_of(text: str) -> Iterator[str]:
    """The text in parts of about PART_CHARS that end before a blank or a line break, so that no word is cut."""
    at = 0
    while at < len(text):
        gap = _blank(text, at + PART_CHARS)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def tokens_of(word: str) -> list[str]:
    """The beginnings of a word, shortest first, then the whole word (marked, so the two can't be mixed up)."""
    return [word[:k] for k in PREFIXES if len(word) > k] + [word + "$"]


def maximal_segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end), in one scan over the positive scores.

    Segments seen so far are a stack of (start, end, sum before, sum after). A new one joins the last
    whose sum before is smaller, if that one's sum after is smaller too; else it stands for itself.
    """
    gains = np.flatnonzero(scores > 0)
    if not len(gains):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float]] = []
    below: list[int] = []  # for each entry the nearest earlier one with a smaller sum before, or -1
    for i in gains.tolist():
        start, end, before, after = i, i + 1, float(sums[i]), float(sums[i + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j = below[j]
            if j < 0 or stack[j][3] >= after:
                stack.append((start, end, before, after))
                below.append(j)
                break
            start, before = stack[j][0], stack[j][2]
            del stack[j:], below[j:]
    return [(after - before, start, end) for start, end, before, after in stack]


@dataclass
class Model:
    """Scores of significant tokens, the chance of segments, and the logistic function."""

    scores: dict[str, float]
    scale: float  # lambda
    log_k: float
    slopes: list[float]
    offset: float
    floor: float

    def word_score(self, word: str) -> float:
        """The score of the longest token of the word that has one."""
        for token in reversed(tokens_of(word)):
            if (s := self.scores.get(token)) is not None:
                return s
        return DRIFT

    def word_scores(self, words: Sequence[str], cache: dict[str, float]) -> np.ndarray:
        if len(cache) > CACHED_WORDS:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = self.word_score(w)
        return np.fromiter(map(cache.__getitem__, words), np.float64, len(words))

    def text_scores(self, text: str, cache: dict[str, float]) -> np.ndarray:
        """The scores of all words of a text."""
        rows = [self.word_scores(words_of(part.lower()), cache) for part in parts_of(text)]
        return np.concatenate(rows) if rows else np.zeros(0)

    def surprise(self, score: float, n: int) -> float:
        """-log of the number of such segments that chance would make in n tokens."""
        return self.scale * score - self.log_k - math.log(max(n, 1))

    def evidence(self, scores: np.ndarray) -> float:
        total = sum(max(0.0, self.surprise(s, len(scores))) for s, _, _ in maximal_segments(scores))
        return min(total, MOST_EVIDENCE)

    def probability(self, evidence: float) -> float:
        if not self.scores:
            return self.floor
        x = float(views(np.float64(evidence)) @ self.slopes) + self.offset
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, toxic, texts, words): for each class, texts with the token, and different words with it in each text.

    The words of a text come in order, so a beginning is new to the text unless the word before has it too, and
    counts can be sent on in the middle of a text of any length.
    """
    counts: dict[int, dict[str, list[int]]] = {0: {}, 1: {}}

    def flush(label: int) -> pa.RecordBatch:
        held = counts[label]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array([label] * len(held), pa.int32()),
             *[pa.array([c[n] for c in held.values()], pa.int64()) for n in (0, 1)]], names=["token", "toxic", "texts", "words"])
        held.clear()
        return batch

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held, before = counts[label], ""
            for word in sorted({w for part in parts_of(text or "") for w in words_of(part.lower())}):
                for token in tokens_of(word):
                    count = held.setdefault(token, [0, 0])
                    count[0] += len(before) <= len(token) or not before.startswith(token)
                    count[1] += 1
                before = word
                if len(held) > HELD_TOKENS:
                    yield flush(label)
    for label in counts:
        if counts[label]:
            yield flush(label)


def token_scores(sample: DataFrame, rates: dict[int, int]) -> dict[str, float]:
    """Log-odds of significant tokens with a Dirichlet prior of PRIOR words at the share of all texts.

    Significant: the share of toxic words is so far above the prior that, over all tokens tested, less
    than one would get there by chance (a Chernoff bound).
    """
    rows = sample.select("_text", "_label").mapInArrow(_token_rows, "token string, toxic int, texts bigint, words bigint")
    toxic = lambda c: F.sum(F.when(F.col("toxic") == 1, F.col(c)).otherwise(0))
    counts = written(rows.groupBy("token").agg(toxic("texts").alias("toxic_texts"), toxic("words").alias("y"), F.sum("words").alias("n"))
                     .where(F.col("n") >= LEAST_TEXTS), "toxic-tokens",
                     rows=sum(rates.values()) * TOKENS_A_TEXT)
    base = rates[1] / (rates[0] + rates[1])
    tested = counts.count()
    raw = F.col("y") / F.col("n")
    share = (F.col("y") + PRIOR * base) / (F.col("n") + PRIOR)
    x_log = lambda x, over: F.when(x > 0, x * F.log(x / over)).otherwise(0.0)
    bound = F.col("n") * (x_log(raw, base) + x_log(1 - raw, 1 - base))
    kept = counts.select("token", share.alias("share")).where(
        (F.col("toxic_texts") >= LEAST_TEXTS) & (raw > base) & (bound >= math.log(max(tested, 1)) + MARGIN) & (share >= LEAST_SHARE)).collect()
    return {r.token: min(MOST_SCORE, math.log(r.share / (1 - r.share)) - math.log(base / (1 - base))) for r in kept}


def full_row(n: int, places: Sequence[int], gains: Sequence[float]) -> np.ndarray:
    """The scores of a text of n tokens from its positive ones."""
    row = np.full(n, DRIFT)
    row[list(places)] = gains
    return row


def chance(model: Model, texts: Sequence[tuple[int, Sequence[int], Sequence[float]]]) -> tuple[float, float]:
    """lambda and log K from texts that are not toxic, given by length and positive tokens.

    lambda solves E[exp(lambda s)] = 1 for the scores of their tokens, every positive score being seen
    half a time more than it was; K is the one for which the largest segments have the mean of an
    extreme-value distribution.
    """
    values = Counter(round(s, 3) for _, _, gains in texts for s in gains)
    for s in set(round(v, 3) for v in model.scores.values()):
        values[s] += 0.5
    values[DRIFT] += 1 + sum(n - len(gains) for n, _, gains in texts)
    s = np.array(list(values))
    p = np.array(list(values.values())) / sum(values.values())
    low, high = 1e-6, 20.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if np.log(np.sum(p * np.exp(np.minimum(middle * s, 300)))) > 0 else (middle, high)
    scale = low
    gumbel = []
    for n, places, gains in texts:
        if n:
            best = max((x for x, _, _ in maximal_segments(full_row(n, places, gains))), default=0.0) if len(gains) else 0.0
            gumbel.append(scale * best - math.log(n))
    euler = 0.5772156649
    return scale, (float(np.mean(gumbel)) - euler if gumbel else 0.0)


def views(evidence: np.ndarray) -> np.ndarray:
    """Two rising views of evidence: whether there is any to speak of, and how much."""
    return np.stack([1 - np.exp(-evidence / 3), np.sqrt(evidence)], axis=-1)


def logistic_fit(x: np.ndarray, y: np.ndarray, shrink: float = 1e-2) -> tuple[list[float], float]:
    """Slopes and offset by Newton steps; a slope that would fall is left out, so more evidence never scores less."""
    used = list(range(x.shape[1]))
    while True:
        design = np.concatenate([x[:, used], np.ones((len(x), 1))], axis=1)
        w = np.zeros(design.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            gradient = design.T @ (p - y) + shrink * w
            hessian = (design * (p * (1 - p))[:, None]).T @ design + shrink * np.eye(len(w))
            move = np.clip(np.linalg.solve(hessian, gradient), -2, 2)
            w -= move
            if np.abs(move).max() < 1e-8:
                break
        falling = [u for u, v in zip(used, w) if v < 0]
        if not falling:
            slopes = dict(zip(used, w.tolist()))
            return [slopes.get(i, 0.0) for i in range(x.shape[1])], float(w[-1])
        used.remove(min(falling, key=lambda u: w[used.index(u)]))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", key: str = "doc_id",
        text: str = "text", bound: int = MAX_LABELLED) -> Model:
    """A model from the texts of at most ``bound`` labelled ids for which ``usable`` holds."""
    found = labelled_sample(docs, labels, label, usable, bound, key, text)
    # Equal texts count once, and repeated rows can't exceed the bound.
    by_text = Window.partitionBy("_hash").orderBy("_id")
    sample = written(found.withColumn("_hash", F.xxhash64("_text")).withColumn("_n", F.row_number().over(by_text))
                     .where("_n = 1").drop("_n", "_hash"), "toxic-sample", rows=bound, a_file=TEXTS_A_FILE)
    rates = {0: 0, 1: 0} | {r._label: r["count"] for r in sample.groupBy("_label").count().collect()}
    if not rates[0] or not rates[1]:
        return Model({}, 1.0, 0.0, [], 0.0, 1.0 if rates[1] else 0.0)
    model = Model(token_scores(sample, rates), 1.0, 0.0, [], 0.0, rates[1] / (rates[0] + rates[1]))
    if not model.scores:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        cache: dict[str, float] = {}
        for batch in batches:
            rows = [shared.value.text_scores(t or "", cache) for t in batch.column(1).to_pylist()]
            # Only positive tokens and the length matter; the rest of a row is the constant drift.
            where = [np.flatnonzero(r > 0) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(r) for r in rows], pa.int64()),
                 pa.array([w.tolist() for w in where], pa.list_(pa.int64())),
                 pa.array([r[w].tolist() for r, w in zip(rows, where)], pa.list_(pa.float64()))],
                names=["id", "label", "n", "places", "gains"])

    rows = sample.select("_id", "_text", "_label").mapInArrow(
        run, "id bigint, label int, n bigint, places array<bigint>, gains array<double>").collect()
    rows.sort(key=lambda r: r.id)

    texts = [(r.n, r.places, r.gains) for r in rows]
    model.scale, model.log_k = chance(model, [t for t, r in zip(texts, rows) if not r.label])
    evidence = np.array([model.evidence(full_row(*t)) if len(t[2]) else 0.0 for t in texts])
    model.slopes, model.offset = logistic_fit(views(evidence), np.array([r.label for r in rows], float))
    return model


def word_places(text: str, count: int, wanted: set[int]) -> dict[int, tuple[int, int]] | None:
    """Start and end of the words with these numbers; None if the text has not ``count`` words.

    Lower-casing can change a word's letters; positions are those of the text itself.
    """
    found, at = {}, -1
    for at, m in enumerate(spans_of(text)):
        if at in wanted:
            found[at] = m.span()
    return found if at + 1 == count else None


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score", passages: str = "passages") -> DataFrame:
    """``docs`` with the probability that each whole text is toxic, and its significant passages.

    Passages are (start, end, surprise) in code points of the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("surprise", pa.float64())]))

    def make():
        cache: dict[str, float] = {}
        known = shared.value

        def step(texts):
            probabilities, found = [], []
            for text in texts:
                row = known.text_scores(text, cache)
                evidence, out = 0.0, []
                for s, start, end in maximal_segments(row):
                    if (x := known.surprise(s, len(row))) > 0:
                        evidence += x
                        out.append((start, end, x))
                if out:
                    places = word_places(text, len(row), {w for a, b, _ in out for w in (a, b - 1)})
                    if places is not None:
                        out = [{"start": places[a][0], "end": places[b - 1][1], "surprise": x} for a, b, x in out]
                    else:
                        out = [{"start": 0, "end": len(text), "surprise": max(x for _, _, x in out)}]
                probabilities.append(known.probability(min(evidence, MOST_EVIDENCE)))
                found.append(out)
            return [pa.array(probabilities, pa.float64()), pa.array(found, kind)]

        return step

    fields = [(name, "double"), (passages, "array<struct<start:int,end:int,surprise:double>>")]
    return with_text_columns(docs, text, fields, make)
