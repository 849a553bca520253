"""Near copies by SimHash balls and the Jaccard similarity of word shingles.

Texts are near copies from a similarity of four fifths of their distinct five-word shingles on. The balls of
``simhash_ball``, over fingerprints of the same shingles, group texts within 4 bits of each other and what these
chains connect: no such pair is missed. Near copies further apart, most of them, meet in MinHash bands, which are added; a pair at the
bound shares none of these with a probability of 7 in 100,000, a closer pair with a smaller one. The whole shingle sets
decide on the pairs of both kinds of group, so no link is made on an estimate.

All pairs of a small group are compared. In a larger one every text first meets one leader, the text that
shares most bands with others, such as the template of edited copies. Texts that are linked by then need not meet
each other. Pairs of others do so by what sets them apart from their leader: two texts far from it are near each other
only if they differ from it in the same shingles. That is a join on the least overlap of sets, by prefixes in an order
from rare to common and by places in them (Chaudhuri et al., 2006; Xiao et al., 2008); what copies share with
their template, and letters with their form, is not looked at. No pair of a large group that is at the
bound and not linked already is left out.

Texts of equal shingle sets are one node; null, empty and blank texts are the node zero, without bands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import HOT_KEYS, join_counted, with_text_columns, written
from timberline.llm.simhash_ball import components, fingerprint, in_components, keep_first, links, shingle_hashes

SHINGLE = 5
# The least similarity as a fraction of whole numbers.
LEAST = (4, 5)
BANDS, IN_BAND = 24, 5
# Groups of up to so many texts are compared pair by pair.
SMALL_GROUP = 32
# Ids of texts to verify are broadcast up to this number, so that other texts are not shuffled.
MOST_BROADCAST = 1_000_000
_RANDOM = np.random.default_rng(42)
_FLIP = _RANDOM.integers(0, 2**64, BANDS * IN_BAND, np.uint64)
_TIMES = _RANDOM.integers(0, 2**64, BANDS * IN_BAND, np.uint64) | np.uint64(1)


def shingle_set(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE))


def band_keys(shingles: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band of least hashes; sets that agree in a band have equal keys."""
    if not len(shingles):
        return []
    least = np.full(BANDS * IN_BAND, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 512):
        part = shingles[i:i + 512, None] ^ _FLIP
        part *= _TIMES
        np.minimum(least, part.min(axis=0), out=least)
    rows = least.reshape(BANDS, IN_BAND)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def with_bands(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the fingerprint and the node of each whole text, the number of its distinct shingles and its band keys."""

    def make():
        def step(texts):
            hashes = [shingle_hashes(t, SHINGLE) for t in texts]
            prints = np.array([fingerprint(h) for h in hashes], np.uint64)
            sets = [np.unique(h) for h in hashes]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], np.uint64)
            return [pa.array(prints.view(np.int64)), pa.array(nodes.view(np.int64)), pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))]

        return step

    return with_text_columns(df, text, [("fp", "bigint"), ("node", "bigint"), ("size", "int"), ("bands", "array<bigint>")], make)


def ball_groups(banded: DataFrame) -> DataFrame:
    """(node, size, band): the nodes of each component of fingerprints (node, size, fp) linked by their balls, under a key of its own.

    Texts of one shingle set differ in what they repeat, so a node can have several fingerprints.
    """
    rows = written(banded.where("size > 0").select("node", "size", "fp").distinct(), "node-prints", rows=banded.count())
    found = in_components(rows, lambda prints: links(prints.select("fp")), "fp", "node")
    return found.select("node", "size", F.xxhash64(F.lit("ball"), "component").alias("band")).distinct()


def _with_set(df: DataFrame, text: str) -> DataFrame:
    def make():
        return lambda texts: [pa.array([shingle_set(t).view(np.int64) for t in texts], pa.list_(pa.int64()))]

    return with_text_columns(df, text, [("shingles", "array<bigint>")], make).drop(text)


def _alike(pairs: DataFrame) -> DataFrame:
    """(a, b), a > b, of pairs whose sizes allow the least similarity."""
    least, whole = LEAST
    return (pairs.where(whole * F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b"))
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def proposed(nodes: DataFrame, balls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes that share a small group, of ``balls`` or of a band, or whose one end leads a large one, and the
    nodes of large groups with the leaders of these (node, lead)."""
    banded = written(balls.unionByName(nodes.select("node", "size", F.explode("bands").alias("band"))), "bands")
    total = banded.count()
    shared = written(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "shared-bands", rows=total // 2)
    rows = written(join_counted(banded, shared, "band", "n", total), "band-groups", rows=total)
    central = rows.groupBy("node").agg(F.sum("n").alias("centre"))

    small = rows.where(F.col("n") <= SMALL_GROUP)
    mates = small.select("band", F.col("node").alias("b"), F.col("size").alias("size_b"))
    pairs = small.join(mates, "band").where("node > b").select(F.col("node").alias("a"), "b", F.col("size").alias("size_a"), "size_b")

    large = rows.where(F.col("n") > SMALL_GROUP)
    leads = (large.join(central, "node").groupBy("band")
             .agg(F.max(F.struct("centre", "node", "size")).alias("lead"), F.max("n").alias("m")))
    leads = written(leads, "leaders", rows=max(1, total // SMALL_GROUP))
    large = large.select("band", "node", "size")
    met = (join_counted(large, leads, "band", "m", rows.count())
           .select(F.col("node").alias("a"), F.col("lead.node").alias("b"), F.col("size").alias("size_a"), F.col("lead.size").alias("size_b")).distinct())
    met = written(met, "met", rows=total)
    return _alike(pairs.unionByName(met.where("a <> b"))), met.select(F.col("a").alias("node"), F.col("b").alias("lead"))


def _with_sets(rows: DataFrame, keys: DataFrame, end: str, sets: DataFrame) -> DataFrame:
    """``rows`` with the set of the node in column ``end``; ``keys`` holds the narrow columns of the same rows.

    The set of a node in very many rows is sent to several tasks, each with a part of these; no set is broadcast.
    """
    total = keys.count()
    bound = max(1000, total // HOT_KEYS)
    counts = written(keys.groupBy(end).agg(F.count("*").alias("n")), "ends", rows=total)
    # Fewer than HOT_KEYS nodes, without their sets.
    hot = F.broadcast(counts.where(F.col("n") > bound).select(end, F.ceil(F.col("n") / bound).alias("parts")))
    dealt = rows.join(hot, end, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(*keys.columns), "parts"), F.lit(0))).drop("parts")
    used = sets.withColumnsRenamed({"node": end, "shingles": f"set_{end}"}).join(counts.select(end), end)
    last = F.coalesce(F.col("parts") - 1, F.lit(0))
    return dealt.join(used.join(hot, end, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("parts"), [end, "part"]).drop("part")


def filtered(large: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different labels (node, label) that have a leader in common and may have the least similarity.

    ``large`` (node, lead) and ``sets`` (node, shingles) are written; nodes linked to their leader have its label. Let
    d(x) be the shingles that only one of x and the leader has. Those that only one of x and y has are d(x) + d(y) less
    twice what these share, so at 4/5 they share at least (over(x) + over(y)) / 18, over(x) = 9 |d(x)| - |x|. A node
    is linked to its leader if over(x) <= |leader|, and no node is below -|leader|: of two labels, the one further
    away is not linked, and something is shared. The first shingle shared, in an order from rare to common,
    has that many places from its own on in both.
    """
    least, whole = LEAST
    both, apart = whole + least, whole - least
    met = _with_sets(_with_sets(large, large, "lead", sets), large, "node", sets)
    only = F.concat(F.array_except("set_node", "set_lead"), F.array_except("set_lead", "set_node"))
    met = written(met.select("node", "lead", F.size("set_node").alias("size"), F.size("set_lead").alias("size_lead"), only.alias("only")), "apart")
    words = met.select("node", "lead", F.explode("only").alias("shingle")).withColumn("at_lead", F.xxhash64("lead", "shingle"))
    words = written(words.select("node", "lead", "at_lead"), "apart-shingles")
    total = words.count()
    counts = words.groupBy("at_lead").agg(F.count("*").alias("n")).where("n > 1")
    # Shingles of one text only come first in every order and are shared with none: their number is enough.
    shared = join_counted(words, written(counts, "shingle-counts", rows=total // 2), "at_lead", "n", total)
    lists = shared.groupBy("node", "lead").agg(F.sort_array(F.collect_list(F.struct("n", "at_lead"))).alias("order"))
    lists = lists.join(met.select("node", "lead", "size", "size_lead", F.size("only").alias("d")), ["node", "lead"])
    lists = lists.withColumn("over", both * F.col("d") - apart * F.col("size")).withColumn("bar", apart * F.col("size_lead"))
    shares = lambda overs: F.greatest(F.lit(1), F.ceil(overs / (2 * both)).cast("int"))
    outer = F.when(F.col("over") > F.col("bar"), F.col("d") - shares(F.col("over") - F.col("bar"))).otherwise(-1)
    inner = F.col("d") - shares(F.col("over") + F.greatest("over", "bar"))
    order = lists.select("node", "size", "over", "d", outer.alias("outer"), inner.alias("inner"),
                         (F.col("d") - F.size("order")).alias("alone"), F.posexplode("order").alias("place", "s"))
    at = F.col("alone") + F.col("place")
    order = order.where(at <= F.greatest("outer", "inner")).select(
        "node", "size", "over", F.col("s.at_lead").alias("shingle"), (F.col("d") - at).alias("rest"),
        (at <= F.col("outer")).alias("outer"), (at <= F.col("inner")).alias("inner"))
    placed = written(order.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "prefixes", rows=total)

    # Within a shingle's texts, those of the most frequent label meet only the others.
    by_label = placed.groupBy("shingle", "label").agg(F.count("*").alias("n"))
    groups = by_label.groupBy("shingle").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels"), F.sum("n").alias("n"))
    groups = written(groups.where("labels > 1").select("shingle", F.col("top.label").alias("main"), "n"), "shingle-groups", rows=total)
    mixed = written(join_counted(placed, groups, "shingle", "n", placed.count()), "mixed-prefixes", rows=total)
    few = mixed.where("label <> main")
    every = mixed.select("shingle", (F.col("label") == F.col("main")).alias("main_b"), F.col("node").alias("b"),
                         *[F.col(c).alias(f"{c}_b") for c in ("size", "over", "label", "rest", "outer", "inner")])
    further = F.struct("over", "node") > F.struct("over_b", "b")
    pairs = few.join(every, "shingle").where(
        (F.col("label") != F.col("label_b")) & (F.col("main_b") | (F.col("node") > F.col("b")))
        & F.when(further, F.col("outer") & F.col("inner_b")).otherwise(F.col("inner") & F.col("outer_b"))
        & (2 * both * F.least("rest", "rest_b") >= F.col("over") + F.col("over_b")))
    return _alike(pairs.select(F.col("node").alias("a"), "b", F.col("size").alias("size_a"), "size_b"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (node, shingles) have the least similarity; ``pairs`` is written."""
    rows = _with_sets(_with_sets(pairs, pairs, "a", sets), pairs, "b", sets)
    both = F.size(F.array_intersect("set_a", "set_b"))
    least, whole = LEAST
    # both / (a + b - both) >= least / whole
    return rows.where((least + whole) * both >= least * (F.size("set_a") + F.size("set_b"))).select("a", "b")


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: its key, text_hash, node, component (a node) and component_id, the smallest key."""
    narrow = df.select(F.col(f"`{key}`").alias(key), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").alias("_text"))
    banded = written(with_bands(narrow, "_text").drop("_text"), "banded")
    nodes = banded.groupBy("node").agg(F.first("size").alias("size"), F.first("bands").alias("bands"), F.min("text_hash").alias("text_hash"))
    nodes = written(nodes, "nodes", rows=banded.count())
    pairs, large = proposed(nodes, ball_groups(banded))
    pairs = written(pairs, "proposed")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(large.select("node")).distinct()
    ends = written(nodes.select("node", "text_hash").join(ends, "node"), "to-verify", rows=2 * pairs.count() + large.count())
    if ends.count() <= MOST_BROADCAST:
        ends = F.broadcast(ends)
    texts = narrow.select("text_hash", "_text").join(ends, "text_hash").drop("text_hash")
    sets = written(_with_set(texts, "_text").dropDuplicates(["node"]), "sets")
    alike = written(verified(pairs, sets), "links-at-once", rows=pairs.count())
    if not large.isEmpty():
        labels = components(alike).select("node", F.col("root").alias("label"))
        late = written(filtered(large, sets, labels), "proposed-late")
        alike = alike.union(verified(late, sets))
    rows = banded.select(key, "text_hash", "node")
    return in_components(rows, alike, "node", key)


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each component: the smallest key (null last), then text hash, then other columns."""
    return keep_first(df, near_copies(df, key, text), key, text)
