"""A minimal perfect hash of distinct 64-bit keys, built in parts by Spark.

Keys are spread over parts of about PART_KEYS by a mixing hash, so no part is large whatever the keys are. In
a part the keys fall into small buckets, and each bucket, the largest first, gets a pilot: a seed and a shift that
move all its keys to places that are still free (hash and displace). A key's index is its part's offset plus
its place; n keys have the indexes 0 to n - 1. A key that is not a member gets an index too, so whoever looks up
others compares the key that is stored there. A pilot takes about eleven bits a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from timberline.llm.common import written

PART_KEYS = 1024
BUCKET_KEYS = 3
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _bucket_of(h: np.ndarray, buckets: np.ndarray | int) -> np.ndarray:
    return (mixed(h + _B) % np.asarray(buckets, np.uint64)).astype(np.int64)


def _place(h: np.ndarray, seed: np.ndarray | int, size: np.ndarray | int) -> np.ndarray:
    return (mixed(h ^ (np.asarray(seed, np.uint64) * _A)) % np.asarray(size, np.uint64)).astype(np.int64)


def buckets_for(size: np.ndarray | int) -> np.ndarray | int:
    return size // BUCKET_KEYS + 1


def pilots_of(h: np.ndarray) -> np.ndarray:
    """A pilot, seed and shift in 16 bits each, for each bucket of a part's hashes."""
    n, buckets = len(h), buckets_for(len(h))
    bucket = _bucket_of(h, buckets)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    starts = np.cumsum(sizes) - sizes
    free = np.ones(2 * n, bool)  # twice in a row, for shifts beyond the end
    pilots = np.zeros(buckets, np.uint32)
    for b in np.argsort(-sizes, kind="stable"):
        if not sizes[b]:
            break
        keys = h[order[starts[b]:starts[b] + sizes[b]]]
        for seed in range(1 << 16):
            at = _place(keys, seed, n)
            fits = free[at[0]:at[0] + n].copy()
            for p in at[1:]:
                fits &= free[p:p + n]
            shift = int(fits.argmax())
            if fits[shift] and len(set(at.tolist())) == len(at):
                taken = (at + shift) % n
                free[taken] = free[taken + n] = False
                pilots[b] = seed << 16 | shift
                break
        else:
            raise RuntimeError("no pilot fits; are the keys distinct?")
    return pilots


@dataclass
class PerfectHash:
    """Sizes and offsets of the parts, offsets of their buckets, and the pilots of all."""

    sizes: np.ndarray
    offsets: np.ndarray
    bucket_offsets: np.ndarray
    pilots: np.ndarray

    def __len__(self) -> int:
        return int(self.sizes.sum())

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; of keys that are not members any index, of empty parts too."""
        if not len(self):
            return np.zeros(len(keys), np.int64)
        h = mixed(keys.astype(np.int64, copy=False).view(np.uint64))
        part = _part_of(h, len(self.sizes))
        size = np.maximum(self.sizes[part], 1)
        pilot = self.pilots[self.bucket_offsets[part] + _bucket_of(h, buckets_for(self.sizes[part]))]
        place = (_place(h, pilot >> np.uint32(16), size) + (pilot & np.uint32(0xFFFF)).astype(np.int64)) % size
        return np.minimum(self.offsets[part] + place, len(self) - 1)

    @staticmethod
    def of_parts(sizes: np.ndarray, pilots: list[np.ndarray]) -> PerfectHash:
        buckets = np.array([len(p) for p in pilots], np.int64)
        return PerfectHash(sizes, np.cumsum(sizes) - sizes, np.cumsum(buckets) - buckets,
                           np.concatenate(pilots) if pilots else np.zeros(0, np.uint32))


def build(keys: DataFrame, column: str, count: int) -> PerfectHash:
    """The hash of ``count`` distinct longs. The driver gets the pilots only, about eleven bits a key."""
    parts = max(1, -(-count // PART_KEYS))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = mixed(np.asarray(batch.column(0)).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(_part_of(h, parts)), pa.array(h.view(np.int64))], names=["part", "h"])

    def solve(table: pa.Table) -> pa.Table:
        h = np.asarray(table.column("h").combine_chunks()).view(np.uint64)
        return pa.table({"part": [table.column("part")[0].as_py()], "size": [len(h)], "pilots": [pilots_of(h).tobytes()]},
                        schema=pa.schema([("part", pa.int64()), ("size", pa.int64()), ("pilots", pa.binary())]))

    solved = keys.select(column).mapInArrow(spread, "part long, h long").groupBy("part").applyInArrow(solve, "part long, size long, pilots binary")
    rows = {r.part: r for r in written(solved, "hash-parts").collect()}
    none = np.zeros(1, np.uint32)
    sizes = np.array([rows[p].size if p in rows else 0 for p in range(parts)], np.int64)
    return PerfectHash.of_parts(sizes, [np.frombuffer(rows[p].pilots, np.uint32) if p in rows else none for p in range(parts)])
