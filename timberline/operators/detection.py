"""Which strategy fits each file, decided on the first lines of the file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.operators.structuring import HEURISTIC, Strategy, accepted
from timberline.sources.text_lines import head_sample

SAMPLE_LINES = 20
UNKNOWN_FORMAT = "unknown"
# What a report calls a file no strategy recognised.
UNKNOWN_LABEL = "Bilinmiyor (varsayilan kullaniliyor, sonuclar hatali olabilir)"


def score_samples(sample: DataFrame, strategies: Sequence[Strategy]) -> DataFrame:
    """Per file, how many sample lines each strategy accepts: ``path, source, score_<name>``."""
    for s in strategies:
        sample = accepted(sample, s, f"_ok_{s.name}")
    return sample.groupBy("path", "source").agg(
        F.max("file_mtime").alias("file_mtime"),
        *[F.count_if(F.col(f"_ok_{s.name}")).alias(f"score_{s.name}") for s in strategies],
    )


def choose_format(scores: DataFrame, strategies: Sequence[Strategy]) -> DataFrame:
    """Adds ``format`` (the strategy used) and ``detected`` (the same, or unknown).

    The highest score wins, on a tie the strategy registered first. A file on which nothing
    scored is still structured with the first strategy, but reported as unknown.
    """
    score = lambda s: F.col(f"score_{s.name}")
    best = F.greatest(*[score(s) for s in strategies]) if len(strategies) > 1 else score(strategies[0])
    chosen = F
    for s in strategies:
        chosen = chosen.when(score(s) == best, F.lit(s.name))
    return scores.withColumns({
        "format": chosen,
        "detected": F.when(best > 0, chosen).otherwise(F.lit(UNKNOWN_FORMAT)),
    })


def detect_formats(lines: DataFrame, strategies: Sequence[Strategy]) -> DataFrame:
    """One row per file: ``path, source, file_mtime, score_*, format, detected``."""
    return detect_from_sample(head_sample(lines, SAMPLE_LINES), strategies)


def detect_from_sample(sample: DataFrame, strategies: Sequence[Strategy]) -> DataFrame:
    """The same from the first lines of each file."""
    return choose_format(score_samples(sample, strategies), strategies)


def format_label(detected: Column, strategies: Sequence[Strategy]) -> Column:
    chain = F
    for s in strategies:
        chain = chain.when(detected == s.name, F.lit(s.label))
    return chain.otherwise(F.lit(UNKNOWN_LABEL))


def default_format(strategies: Sequence[Strategy]) -> str:
    return strategies[0].name if strategies else HEURISTIC
