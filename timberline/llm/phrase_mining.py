"""Phrase collocations by Toivonen's mining: a sample proposes, full passes count exactly, failures of the border extend.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words at blanks and
tabs. A sample of the rows proposes phrases of up to four words that may be frequent. A full pass counts all
words, the proposed phrases, and their negative border: every phrase whose two parts, without its last and without
its first word, are proposed. All counts are exact. Frequent phrases that were not proposed are failures
of the border (Toivonen, 1996). A frequent phrase that was not counted has a part that was not proposed; the shortest such
part was counted, so it is a failure. The expansion pass counts every phrase that holds a failure and was not counted,
as far as its other parts are proposed, and closes the search at once: what it finds frequent has no longer
phrases that it did not count too. The sample decides whether that pass is needed, never what comes out.

Proposals are asked for in a table of bits (Bloom, 1970) of bounded size, over 64-bit hashes of group and words. A
wrong yes costs a phrase counted in vain; phrases are counted under their own text. With far more proposals
than MOST_BITS / 16 the table fills up and more is counted, with the same result.

A text of any length is worked through in slices that overlap by three words. Null texts are empty, null groups
are called ``und``, rows count as often as they occur, columns other than text and group are not used. No
frequent phrase gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import join_counted, written

MOST_WORDS = 4
SAMPLE_SHARE = 0.25
# A phrase is proposed from this part of the count that a phrase at the bound has in the sample on average.
LOWERED = 0.6
# A longer phrase with this share of a phrase's occurrences stands for it.
COVERS = (80, 100)
SCALE = 2_000_000
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
SLICE_BYTES = 2_000_000
# Texts that wait for others of their group, in slices; rows unpacked and rows sent at a time.
HELD_SLICES = 4
ROWS_A_STEP = 256
ROWS_A_BATCH = 50_000
VOCABULARY = 150_000
# Parts of a group that are ranked apart before the group's best are merged.
RANK_PARTS = 64
UNKNOWN_GROUP = "und"

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_tokens = re.compile(rb"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r]+").findall
_gap = re.compile(rb"[ \t.,;:!?\n-\r]").search
_MIX, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _NEXT
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


class Vocabulary(dict):
    """Words of a task as numbers from 1 on, with their hashes; runs of breaks are number 0."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = [b""]
        self.hashes = np.zeros(1, np.uint64)

    def __missing__(self, token: bytes) -> int:
        number = 0 if token[0] in _BREAKS else len(self.words)
        if number:
            self.words.append(token)
        self[token] = number
        return number

    def empty(self) -> None:
        self.clear()
        self.words, self.hashes = [b""], np.zeros(1, np.uint64)

    def numbers(self, tokens: list[bytes]) -> np.ndarray:
        ids = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        new = self.words[len(self.hashes):]
        if new:
            more = np.fromiter((xxhash.xxh64_intdigest(w) for w in new), np.uint64, len(new))
            self.hashes = np.concatenate([self.hashes, more])
        return ids

    def texts(self) -> pa.Array:
        return pa.array(self.words, pa.binary()).cast(pa.string())


def _group_hash(group: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(group.encode(), 1))


def window_hashes(ids: np.ndarray, word_hashes: np.ndarray, group: np.uint64) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each length from 1 on: the hash of the phrase that ends at each token, and whether it lies in one piece."""
    own = word_hashes[ids]
    hashes, whole = [_mixed(own ^ group)], [ids > 0]
    for _ in range(1, MOST_WORDS):
        h, w = np.zeros_like(hashes[0]), np.zeros_like(whole[0])
        h[1:] = _mixed(hashes[-1][:-1] * _MIX + own[1:])
        w[1:] = whole[-1][:-1] & whole[0][1:]
        hashes.append(h)
        whole.append(w)
    return hashes, whole


class Bits:
    """A set of 64-bit hashes as bits: no member is missed, a few others are taken for members."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for p in (hashes & self.mask, (hashes >> np.uint64(32)) & self.mask):
            found &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return found

    def at(self, hashes: np.ndarray, where: np.ndarray) -> np.ndarray:
        """``has`` at the places of ``where``, false elsewhere."""
        out = np.zeros(len(hashes), bool)
        places = np.flatnonzero(where)
        out[places] = self.has(hashes[places])
        return out

    @staticmethod
    def of(hashes: DataFrame, bits: int) -> Bits:
        """The set of a column ``hash``. Spark sets the bits; at most ``bits`` / 8 bytes reach the driver, as words."""
        h, last = F.col("hash"), F.lit(bits - 1).cast("long")
        places = hashes.select(F.explode(F.array(h.bitwiseAND(last), F.shiftrightunsigned(h, 32).bitwiseAND(last))).alias("place"))
        one = F.expr("shiftleft(1L, CAST(pmod(place, 64) AS INT))")
        rows = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
        words = np.zeros(bits // 64, np.uint64)
        words[np.asarray(rows.column("word"))] = np.asarray(rows.column("bits")).view(np.uint64)
        return Bits(words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)


def _slices(buffer: bytes) -> Iterator[tuple[bytes, bool]]:
    """Parts of at most about SLICE_BYTES that end at a gap, and whether the part goes on from the one before."""
    at = 0
    while at < len(buffer):
        end = at + SLICE_BYTES
        if end < len(buffer):
            gap = _gap(buffer, end)
            end = gap.start() if gap else len(buffer)
        yield buffer[at:end], at > 0
        at = end


def token_runs(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[tuple[str, np.ndarray, int]]:
    """(group, tokens, old): tokens of the texts of a group; the first ``old`` belong to the run before."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def runs(group: str) -> Iterator[tuple[str, np.ndarray, int]]:
        buffer = b"\n".join(held.pop(group)).lower()  # bytes are lowered in A-Z only
        del sizes[group]
        carry: list[bytes] = []
        for part, goes_on in _slices(buffer):
            carry = carry if goes_on else []
            tokens = carry + _tokens(part)
            yield group, vocabulary.numbers(tokens), len(carry)
            carry = tokens[-(MOST_WORDS - 1):]

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_A_STEP):
            rows = batch.slice(at, ROWS_A_STEP)
            for text, group in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                if text:
                    held.setdefault(group, []).append(text)
                    sizes[group] = sizes.get(group, 0) + len(text)
                    if sizes[group] >= SLICE_BYTES:
                        yield from runs(group)
            while sum(sizes.values()) > HELD_SLICES * SLICE_BYTES:
                yield from runs(max(sizes, key=sizes.get))
    for group in list(held):
        yield from runs(group)


def _sampled(known: Bits | None):
    """Tasks that count hashes of the sample: words and pairs, or with their table ``known`` the longer phrases."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for group, ids, old in token_runs(batches, vocabulary):
            hashes, whole = window_hashes(ids, vocabulary.hashes, _group_hash(group))
            if known is None:
                picked = [hashes[k][old:][whole[k][old:]] for k in (0, 1)]
            else:
                picked, members = [], known.at(hashes[1], whole[1])
                for k in range(2, MOST_WORDS):
                    both = np.zeros(len(ids), bool)
                    both[1:] = members[:-1] & members[1:]
                    members = both & whole[k]
                    picked.append(hashes[k][old:][members[old:]])
            values, counts = np.unique(np.concatenate(picked), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["hash", "n"])
            if len(vocabulary) > VOCABULARY:
                vocabulary.empty()

    return run


def distinct_windows(ids: np.ndarray, hashes: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """One place for each different phrase of ``length`` words that ends at ``places``, and how often it occurs.

    Hashes sort them; words are compared, so that equal hashes of different phrases do no harm.
    """
    order = np.argsort(hashes[places])
    places = places[order]
    new = np.ones(len(places), bool)
    new[1:] = hashes[places[1:]] != hashes[places[:-1]]
    for back in range(length):
        words = ids[places - back]
        if ((words[1:] != words[:-1]) & ~new[1:]).any():
            columns = np.stack([ids[places - b] for b in range(length)], axis=1)
            _, first, counts = np.unique(columns, axis=0, return_index=True, return_counts=True)
            return places[first], counts
    first = np.flatnonzero(new)
    return places[first], np.diff(first, append=len(places))


def _either(x: np.ndarray, both: bool) -> np.ndarray:
    """At each end of a phrase, whether both of its parts, or one of them, have a property that ``x`` tells by their ends."""
    out = np.zeros(len(x), bool)
    out[1:] = x[:-1] & x[1:] if both else x[:-1] | x[1:]
    return out


def _counted(known: Bits, failed: Bits | None):
    """Tasks that count words and the phrases whose two parts ``known`` holds, or the phrases that hold one of ``failed``.

    The latter are those that were not counted with ``known``, and whose parts ``known`` holds or that hold such a
    phrase themselves. A group's words altogether are counted under the empty phrase.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        totals: dict[str, np.ndarray] = {}

        def rows(group: str, phrases: Callable[[np.ndarray], pa.Array], which: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(which), ROWS_A_BATCH):
                part = slice(at, at + ROWS_A_BATCH)
                texts = phrases(which[part])
                groups = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(texts), np.int32)), [group]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([groups, texts, pa.array(counts[part].astype(np.int64))], names=["grp", "phrase", "f"])

        def flush() -> Iterator[pa.RecordBatch]:
            texts = vocabulary.texts()
            for group, counts in totals.items():
                counts[0] = counts.sum()  # number 0, the empty phrase
                used = np.flatnonzero(counts)
                yield from rows(group, lambda which: texts.take(pa.array(which)), used, counts[used])
            totals.clear()

        for group, ids, old in token_runs(batches, vocabulary):
            hashes, whole = window_hashes(ids, vocabulary.hashes, _group_hash(group))
            if failed is None:
                counts = np.bincount(ids[old:], minlength=len(vocabulary.words))
                counts[0] = 0
                if (sofar := totals.get(group)) is not None:
                    counts[:len(sofar)] += sofar
                totals[group] = counts
            texts = None
            members = known.at(hashes[0], whole[0])
            holds = failed.at(hashes[0], whole[0]) if failed else np.zeros(len(ids), bool)
            if failed and not holds.any() and not failed.at(hashes[1], whole[1]).any() and not failed.at(hashes[2], whole[2]).any():
                if len(vocabulary) > VOCABULARY:
                    vocabulary.empty()
                continue
            likely = members | holds
            for k in range(1, MOST_WORDS):
                counted = _either(members, True) & whole[k]
                above = _either(holds, False) & whole[k]
                asked = above & _either(likely, True) & ~counted if failed else counted.copy()
                asked[:old] = False
                places = np.flatnonzero(asked)
                if len(places):
                    texts = texts or vocabulary.texts()
                    shown, counts = distinct_windows(ids, hashes[k], places, k + 1)
                    joined = lambda ends: pc.binary_join_element_wise(
                        *[texts.take(pa.array(ids[ends - back])) for back in range(k, -1, -1)], " ")
                    yield from rows(group, joined, shown, counts)
                members = known.at(hashes[k], counted)
                if failed:
                    holds = above | failed.at(hashes[k], counted)
                    likely = members | holds
            if len(vocabulary) > VOCABULARY:
                yield from flush()
                vocabulary.empty()
        yield from flush()

    return run


def _with_hash(known: Bits):
    """Tasks that add to phrases (grp, phrase, f) their hash, and whether ``known`` holds it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vocabulary = Vocabulary()
            out = np.zeros(batch.num_rows, np.uint64)
            for i, (group, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                ids = vocabulary.numbers(phrase.encode().split(b" ") if phrase else [])
                if len(ids):
                    out[i] = window_hashes(ids, vocabulary.hashes, _group_hash(group))[0][len(ids) - 1][-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64)), pa.array(known.has(out))],
                                             names=["grp", "phrase", "f", "hash", "known"])

    return run


def frequent_phrases(df: DataFrame, text: str, group: str, least: int) -> DataFrame:
    """(grp, phrase, f): all phrases of up to four words that occur ``least`` times or more in their group, and
    under the empty phrase all its words."""
    named = F.coalesce(F.col(f"`{group}`").cast("string"), F.lit(UNKNOWN_GROUP))
    narrow = df.select(F.col(f"`{text}`").cast("binary").alias("text"), named.alias("grp")).where(F.octet_length("text") > 0)
    sample = narrow.sample(SAMPLE_SHARE, seed=11)
    enough = max(2, round(LOWERED * SAMPLE_SHARE * least))

    def proposed(known: Bits | None) -> DataFrame:
        counts = sample.mapInArrow(_sampled(known), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
        return written(counts.where(F.col("n") >= enough).select("hash"), "proposed-phrases")

    short = proposed(None)
    # Room for the longer ones too, and for failures of the border.
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (32 * short.count()).bit_length()))
    known = Bits.of(short, bits)
    known |= Bits.of(proposed(known), bits)

    def frequent(failed: Bits | None) -> DataFrame:
        counts = narrow.mapInArrow(_counted(known, failed), "grp string, phrase string, f long").groupBy("grp", "phrase").agg(F.sum("f").alias("f"))
        return counts.where(F.col("f") >= least)

    first = written(frequent(None).mapInArrow(_with_hash(known), "grp string, phrase string, f long, hash long, known boolean"), "frequent-phrases")
    out = first.select("grp", "phrase", "f")
    # The longest phrases have no longer ones to be counted for.
    failures = first.where(~F.col("known") & (F.col("phrase") != "") & (F.size(F.split("phrase", " ")) < MOST_WORDS))
    if not failures.isEmpty():
        out = out.unionByName(frequent(Bits.of(failures.select("hash"), bits)))
    return written(out, "all-frequent-phrases")


def _key(phrase: Column) -> Column:
    """Group and phrase as one: phrases hold no line break."""
    return F.concat("grp", F.lit("\n"), phrase)


def collocations(df: DataFrame, text: str = "text", group: str = "lang", least: int = 30, best: int = 2000) -> DataFrame:
    """(group, rank, phrase, a, l, r, n, score): the ``best`` phrases of two to four words of each group.

    a: the phrase's occurrences, l and r: those of the two parts at its weakest cut, n: the group's words;
    score: floor(2,000,000 a / (l + r)), exactly, the least over all cuts, ties to the first. Phrases inside a longer one
    that has 80 % of their occurrences are left out. Order: score, then a, both descending, then the phrase.
    """
    frequent = frequent_phrases(df, text, group, least)
    words = F.split("phrase", " ")
    longer = frequent.where(F.size(words) > 1).select("grp", "phrase", F.col("f").alias("a"), words.alias("words"), _key(F.col("phrase")).alias("key"))

    size = F.size("words")
    spans = longer.where(size > 2).select("grp", "a", "words", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    spans = spans.select("grp", "a", "words", "m", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)).alias("at"))
    inside = spans.select(_key(F.array_join(F.slice("words", F.col("at"), F.col("m")), " ")).alias("key"), "a").groupBy("key").agg(F.max("a").alias("cover"))
    part, whole = COVERS
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = longer.join(inside, "key", "left").where(F.col("cover").isNull() | (wide("cover") * whole < wide("a") * part)).drop("cover")

    cuts = kept.select("grp", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = written(cuts.select(
        "grp", "phrase", "a", "k", _key(F.array_join(F.slice("words", F.lit(1), F.col("k")), " ")).alias("first"),
        _key(F.array_join(F.slice("words", F.col("k") + 1, size), " ")).alias("rest")), "phrase-cuts")
    total = cuts.count()
    parts = frequent.select(_key(F.col("phrase")).alias("key"), "f")
    for end, name in (("first", "l"), ("rest", "r")):
        # Common words begin and end many phrases.
        uses = cuts.groupBy(F.col(end).alias("key")).agg(F.count("*").alias("uses"))
        small = written(parts.join(uses, "key").select(F.col("key").alias(end), F.col("f").alias(name), "uses"), "cut-parts")
        cuts = join_counted(cuts, small, end, "uses", total).drop("uses")
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    weakest = F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("grp", "phrase", "a").agg(weakest).select("grp", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # A group of any size is ranked in parts first: its best are among the best of the parts.
    salted = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    salted = salted.withColumn("_n", F.row_number().over(Window.partitionBy("grp", "_part").orderBy(*order))).where(F.col("_n") <= best)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    sizes = frequent.where("phrase = ''").select("grp", F.col("f").alias("n"))
    return ranked.join(sizes, "grp").select(F.col("grp").alias(group), "rank", "phrase", "a", "l", "r", "n", "score")
