"""Where a search text matches inside a message: ``ARRAY<STRUCT<start, length>>``.

The matches are marked in one regular-expression pass, and the marks are found in whole Arrow batches of marked
texts. Positions count characters from 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from timberline.functions import patterns
from timberline.functions.fuzzy import pieces, split_terms, within_typos
from timberline.plans.durable import importable

SPANS = "array<struct<start:int,length:int>>"
_WORD_SPANS = "array<struct<start:int,length:int,word:string>>"
# A noncharacter that Unicode keeps for use inside a program.
_MARK = "\ufdd0"
_WORD = r"[\p{L}\p{N}_]"
# Bytes of text, or spans, that are looked through at a time.
_TEXT_BYTES = 4 << 20
_SPANS = 1 << 18


def _span(start: Column, length: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), length.cast("int").alias("length"))


def _no_spans() -> Column:
    return F.array().cast(SPANS)


def _marked(text: Column, pattern: str) -> Column:
    """The text with a mark before and after each match."""
    # A mark in the text itself could be taken for ours; its substitute has the same length.
    clean = F.when(text.contains(_MARK), F.translate(text, _MARK, "\ufffd")).otherwise(text)
    marked = F.regexp_replace(clean, pattern, f"{_MARK}$0{_MARK}")
    # Two marks in a row are an empty match, or the end of one match where the next begins:
    # without them the first is gone and the others are joined.
    return F.replace(marked, F.lit(_MARK * 2), F.lit(""))


def _by_runs(values: pa.Array, weights: pa.Array, most: int, step: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``step`` of runs of values of about ``most`` in weight; a heavier value is a run of its own."""
    ends = np.cumsum(pc.fill_null(weights, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    done, begin = [], 0
    while begin < len(values) or not done:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, "right")))
        done.append(step(values.slice(begin, end - begin)))
        begin = end
    return pa.concat_arrays(done)


def _lists(ends: np.ndarray, nulls: pa.Array, **fields: pa.Array) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(list(fields.values()), list(fields)), mask=nulls)


def _ints(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int32())


def _between_marks(texts: pa.Array, with_word: bool) -> pa.Array:
    """Spans between the marks 0 and 1, 2 and 3, ... of each text, counted without the marks; the text there as ``word``."""
    filled = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = filled.buffers()
    offsets = np.frombuffer(offsets or bytes(8), np.int64)[filled.offset:filled.offset + len(filled) + 1]
    data = np.frombuffer(data or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    lead, *rest = _MARK.encode()
    at = np.flatnonzero(data == lead)
    for k, byte in enumerate(rest, 1):
        at = at[data[at + k] == byte]
    # All bytes but the first of a character look like this in UTF-8.
    inner = np.flatnonzero((data & 0xC0) == 0x80)
    characters = lambda place: place - np.searchsorted(inner, place)
    marks = np.searchsorted(at, offsets)
    row = np.searchsorted(offsets, at, "right") - 1
    place = characters(at) - characters(offsets)[row] - (np.arange(len(at)) - marks[row])
    spans = {"start": _ints(place[::2]), "length": _ints(place[1::2] - place[::2])}
    if with_word:
        begin = at[::2] + len(_MARK.encode())
        size = at[1::2] - begin
        ends = np.cumsum(size)
        taken = np.repeat(begin - (ends - size), size) + np.arange(size.sum())
        spans["word"] = pa.LargeStringArray.from_buffers(
            len(size), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(data[taken])).cast(pa.string())
    return _lists(marks[1:] // 2, texts.is_null(), **spans)


def _found(text: Column, pattern: str, with_word: bool = False) -> Column:
    """The matches as spans, touching ones joined, on request each with its text."""
    importable(SparkSession.active())

    @F.arrow_udf(_WORD_SPANS if with_word else SPANS)
    def found(texts: pa.Array) -> pa.Array:
        return _by_runs(texts, pc.binary_length(texts), _TEXT_BYTES, lambda run: _between_marks(run, with_word))

    return found(_marked(text, pattern))


def regex_spans(text: Column, pattern: str) -> Column:
    """Every non-empty match, touching ones joined."""
    return _found(text, patterns.to_java(pattern).text)


def word_spans(text: Column, search: str) -> Column:
    """Per word, the first term that matches it: the matching part, or on a typo the whole word."""
    terms = [t.lower() for t in split_terms(search)]
    if not terms:
        return F.when(text.isNotNull(), _no_spans())
    # Only words that hold a piece of some term are marked; the rest cannot match.
    parts = "|".join(sorted({re.escape(p) for t in terms for p in pieces(t)}, key=len, reverse=True))
    candidate = f"(?iu)(?<!{_WORD}){_WORD}*(?:{parts}){_WORD}*"

    def hit(found: Column) -> Column:
        lowered = F.lower(found["word"])
        span = F
        for term in terms:
            inside = F.locate(term, lowered)
            span = span.when(inside > 0, _span(found["start"] + inside - 1, F.lit(len(term)))).when(
                within_typos(lowered, term), _span(found["start"], found["length"]))
        return span

    return F.filter(F.transform(_found(text, candidate, with_word=True), hit), lambda span: span.isNotNull())


def _islands(spans: pa.Array) -> pa.Array:
    """A sweep by start: a span begins a new one if it lies beyond the end of all before it in its row."""
    flat = spans.flatten()
    start, length = (pc.struct_field(flat, f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "length"))
    # All rows on one line, so far apart that no span reaches the next row.
    row = np.repeat(np.arange(len(spans)), pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))
    origin = row * (int((start + length).max(initial=0)) + 2)
    start += origin
    order = np.argsort(start, kind="stable")
    start, origin = start[order], origin[order]
    reach = np.maximum.accumulate(start + length[order])
    head = np.concatenate([start[:1] == start[:1], start[1:] > reach[:-1]])
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(start))[:len(first)] - 1
    return _lists(np.searchsorted(row[first], np.arange(len(spans)), "right"), spans.is_null(),
                  start=_ints(start[first] - origin[first]), length=_ints(reach[last] - start[first]))


def merge_spans(spans: Column) -> Column:
    """Spans in order, with those that overlap or touch joined into one."""
    importable(SparkSession.active())

    @F.arrow_udf(SPANS)
    def merged(lists: pa.Array) -> pa.Array:
        return _by_runs(lists, pc.list_value_length(lists), _SPANS, _islands)

    return merged(spans)


def highlight_spans(spark: SparkSession, text: Column, search: str) -> Column:
    """Merged spans of ``search`` in ``text``; an empty search has none."""
    if not search:
        return F.when(text.isNotNull(), _no_spans())
    if not patterns.looks_like_regex(search):
        # At most one span per word, and words do not touch: nothing to merge.
        return word_spans(text, search)
    java = patterns.compile_check(spark, search, "search")
    if patterns.may_match_empty(spark, search, java.text):
        return merge_spans(_spans_of_empty_matching(search)(text))
    return regex_spans(text, search)


def _spans_of_empty_matching(pattern: str):
    """For a pattern that can match nothing at all, such as ``x*``.

    After an empty match the next one may start at the same place if it is not empty, a rule
    Java's matcher does not have and Python's has.
    """
    python = patterns.python_spelling(pattern)
    try:
        compiled = re.compile(python, re.ASCII)
    except re.error as error:
        raise ValueError(f"search is not supported for highlighting: {pattern}") from error

    @F.pandas_udf(SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else [
                {"start": m.start(), "length": m.end() - m.start()}
                for m in compiled.finditer(t) if m.end() > m.start()])

    return spans
