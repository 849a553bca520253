"""Near copies by SimHash and meet-in-the-middle balls.

Two fingerprints differ in at most 2r bits exactly if some word lies within r bits of both. So every
distinct fingerprint emits all words within radius r, half the (even) distance, equal words meet, and
their fingerprints are linked. Words are shuffled by their leading bits: a fingerprint goes once to every
prefix that its ball touches, with the radius that is left, and the words below a prefix are made where
they meet. That is the same set of words with a small part of the rows. A meeting of whole words proves the
distance, and a group of any size is linked to its smallest member, never pairwise.

A null or empty text has the fingerprint zero and is linked like any other. Repeated rows share their
component. Components without an id (all null) have a null component id. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import join_counted, whole_row, with_text_columns, written

BITS = 64
SHINGLE = 4
SEED = 42
DISTANCE = 4
# Distinct fingerprints aimed at below one prefix; the number of prefix bits follows the input.
PER_PREFIX = 1000
MOST_PREFIX_BITS = 24
# Words made at once within a task; fuller prefixes are divided by further bits.
WORDS_AT_ONCE = 4_000_000


# --- fingerprints -------------------------------------------------------------------------------


def shingle_hashes(text: str, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; A-Z lower-cased, words at ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    starts = [0, *ends[:-width].tolist()]
    stops = (ends[width - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(stops))


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes, as an unsigned number."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of each whole text as a signed 64-bit number."""

    def make():
        def step(texts):
            prints = np.array([fingerprint(shingle_hashes(t)) for t in texts], np.uint64)
            return [pa.array(prints.view(np.int64))]

        return step

    return with_text_columns(df, text, [(name, "bigint")], make)


def as_hex(fingerprints: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprints)), 16, "0")


# --- meeting words ------------------------------------------------------------------------------


def flips(first: int, last: int, most: int) -> np.ndarray:
    """All masks that flip at most ``most`` of the bits first..last-1, counted from the top."""
    bits = [1 << (BITS - 1 - i) for i in range(first, last)]
    return np.array([sum(c) for n in range(most + 1) for c in combinations(bits, n)], np.uint64)


def _meetings(prints: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(group, place of the print) of every word that two or more prints' balls share."""
    words, owners = [], []
    for radius in np.unique(left):
        own = np.flatnonzero(left == radius)
        masks = flips(depth, BITS, int(radius))
        words.append((prints[own][:, None] ^ masks[None, :]).ravel())
        owners.append((own, len(masks)))
    low = (np.uint64(1) << np.uint64(BITS - depth)) - np.uint64(1) if depth else np.uint64(2**64 - 1)
    flat = np.concatenate(words) & low
    order = np.sort(flat)
    shared = order[1:][order[1:] == order[:-1]]
    if not len(shared):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shared = shared[np.concatenate([[True], shared[1:] != shared[:-1]])]
    # Few words are shared: a table of hash bits passes over the others.
    spread = lambda w: (w * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
    table = np.zeros(1 << 20, bool)
    table[spread(shared)] = True
    near = np.flatnonzero(table[spread(flat)])
    at = np.minimum(np.searchsorted(shared, flat[near]), len(shared) - 1)
    hit = shared[at] == flat[near]
    near, at = near[hit], at[hit]
    owner = np.empty(len(near), np.int64)
    begin = 0
    for own, count in owners:
        inside = (near >= begin) & (near < begin + len(own) * count)
        owner[inside] = own[(near[inside] - begin) // count]
        begin += len(own) * count
    return at, owner


def _ones(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values).astype(np.int64)


def linked(prints: np.ndarray, left: np.ndarray, depth: int, label: np.ndarray) -> None:
    """Lowers ``label`` (places of sorted prints) to the smallest linked place, below one prefix.

    Prefixes with too many words at once are divided by four more bits; a prefix of all bits is one word.
    """
    many = sum(int((left == r).sum()) * sum(math.comb(BITS - depth, k) for k in range(r + 1))
               for r in range(left.max(initial=0) + 1))
    places = np.arange(len(prints))
    if many > WORDS_AT_ONCE and depth < BITS:
        step = min(4, BITS - depth)
        part = (prints >> np.uint64(BITS - depth - step)) & np.uint64((1 << step) - 1)
        pairs = [np.empty((2, 0), np.int64)]
        for value in range(1 << step):
            rest = left - _ones(part ^ np.uint64(value))
            own = places[rest >= 0]
            if len(own) > 1:
                sub = np.arange(len(own))
                linked(prints[own], rest[own], depth + step, sub)
                joined = np.flatnonzero(sub != np.arange(len(own)))
                pairs.append(np.stack([own[joined], own[sub[joined]]]))
        _join(label, *np.concatenate(pairs, axis=1))
        return
    group, owner = _meetings(prints, left, depth)
    if not len(group):
        return
    order = np.argsort(group, kind="stable")
    group, owner = group[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    run = np.repeat(np.arange(len(starts)), np.diff([*starts, len(group)]))
    while True:
        before = label.copy()
        least = np.minimum.reduceat(label[owner], starts)
        np.minimum.at(label, owner, least[run])
        np.minimum(label, label[label], out=label)
        if np.array_equal(before, label):
            return


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Lowers labels until the ends of every pair have the same."""
    while not np.array_equal(label[a], label[b]):
        least = np.minimum(label[a], label[b])
        for end in (a, b):
            np.minimum.at(label, label[end], least)
            np.minimum.at(label, end, least)
        np.minimum(label, label[label], out=label)


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): each fingerprint a with a smaller one b in the same component, enough to span it.

    ``prints`` has one column ``fp`` of distinct values. Every link lies in some word's group, so the
    spanning links of the groups connect exactly what pairs within ``distance`` connect.
    """
    if distance % 2:
        raise ValueError("the distance must be even: an odd one has meetings that are no links")
    radius = distance // 2
    count = prints.count()
    bits = min(MOST_PREFIX_BITS, max(1, (count // PER_PREFIX).bit_length()))
    masks = [(int(m) >> (BITS - bits), radius - int(m).bit_count()) for m in flips(0, bits, radius)]
    ball = F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(r).alias("left")) for m, r in masks]))
    sent = (prints.select("fp", ball.alias("m"))
            .select("fp", F.col("m.left").alias("left"),
                    F.shiftrightunsigned("fp", BITS - bits).cast("int").bitwiseXOR(F.col("m.mask")).alias("prefix")))

    def meet(group: pa.Table) -> pa.Table:
        prints = group.column("fp").to_numpy().astype(np.int64)
        order = np.argsort(prints)
        prints = prints[order]
        left = group.column("left").to_numpy().astype(np.int64)[order]
        label = np.arange(len(prints))
        if len(prints) > 1:
            linked(prints.view(np.uint64), left, bits, label)
        joined = np.flatnonzero(label != np.arange(len(prints)))
        return pa.table({"a": prints[joined], "b": prints[label[joined]]})

    return sent.groupBy("prefix").applyInArrow(meet, "a bigint, b bigint").distinct()


# --- components ---------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b), root being the smallest node of the component.

    Alternates two steps until nothing changes, a logarithmic number of rounds: every larger neighbour
    of a node is tied to the node's smallest neighbour, then every smaller one. Each round is a written
    table. Minima are combined before the shuffle; hubs, of which there can only be few, are looked up
    in a broadcast of bounded size.
    """
    pairs = written(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                    .where("hi <> lo").distinct(), "links")
    known = None
    while True:
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first())
        if state == known or not state[0]:
            return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
                pairs.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).distinct()
        known = state
        count = state[0]
        both = pairs.union(pairs.select("lo", "hi")).toDF("u", "v")
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "least", rows=2 * count)
        larger = join_counted(both.where("v > u"), least, "u", "n", 2 * count).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        pairs = written(larger.where("hi <> lo").distinct(), "links", rows=2 * count)
        size = pairs.count()
        least = written(pairs.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"), F.count("*").alias("n")), "least", rows=size)
        smaller = join_counted(pairs.toDF("u", "v"), least, "u", "n", size).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        pairs = written(smaller.where("hi <> lo").union(least.select("u", "m")).distinct(), "links", rows=2 * size)


def in_components(rows: DataFrame, edges: DataFrame | Callable[[DataFrame], DataFrame], node: str, key: str) -> DataFrame:
    """``rows`` (key, node, others) with the component of each and its smallest key; ``edges`` links nodes, or makes links of them."""
    every = rows.count()
    nodes = written(rows.groupBy(node).agg(F.min(key).alias("least"), F.count("*").alias("n")), "distinct-nodes", rows=every)
    roots = components(edges(nodes) if callable(edges) else edges).toDF(node, "root")
    placed = nodes.join(roots, node, "left").select(node, "least", "n", F.coalesce("root", node).alias("component"))
    ids = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    # A component of very many nodes is a hot key too.
    total = nodes.count()
    ids = written(ids, "component-ids", rows=total)
    of_node = written(join_counted(placed.select(node, F.col("n").alias("n_rows"), "component"), ids, "component", "n", total)
                      .select(node, "component", "component_id", F.col("n_rows").alias("n")), "components", rows=total)
    return join_counted(rows, of_node, node, "n", every).select(*rows.columns, "component", "component_id")


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``df``: its key, fingerprint, text_hash, component (a fingerprint) and component_id.

    ``component_id`` is the smallest key of the component. Distinct fingerprints are linked once,
    whatever the number of their copies.
    """
    narrow = df.select(F.col(f"`{key}`").alias(key), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").alias("_text"))
    rows = written(with_fingerprint(narrow, "_text", "fp").drop("_text"), "fingerprints")
    found = in_components(rows, lambda prints: links(prints.select("fp"), distance), "fp", key)
    return found.select(key, "text_hash", F.col("fp").alias("fingerprint"), "component", "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """``df`` with one row of each component: the smallest key (null last), then text hash, then other columns."""
    return keep_first(df, near_copies(df, key, text, distance), key, text)


def keep_first(df: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` with one row of each component of ``found`` (key, text_hash, component), chosen as in ``keep_one``."""
    first = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col("text_hash").alias("hash")))
    winners = written(found.groupBy("component").agg(first.alias("w")).select(
        F.col("w.id").alias("_id"), F.col("w.hash").alias("_hash")), "kept", rows=found.count())
    rows = df.select(F.col(f"`{key}`").alias("_key"), F.xxhash64(F.col(f"`{text}`")).alias("_text_hash"), whole_row(df).alias("_row"))
    kept = rows.join(winners, rows["_key"].eqNullSafe(winners["_id"]) & (rows["_text_hash"] == winners["_hash"]))
    # Rows of one key and text are one group: the join has them together already.
    others = [F.col("_row").getField(c) for c in df.columns if c not in (key, text)]
    one = Window.partitionBy("_id", "_hash").orderBy(*(others or [F.col("_hash")]))
    return kept.withColumn("_n", F.row_number().over(one)).where("_n = 1").select("_row.*")
