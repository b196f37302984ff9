"""Two Bloom filters for hashes seen once and seen twice, built by shards.

Every 64-bit hash belongs to a shard (top bits).  Map tasks send packed 32-bit
remainders to the shards; a shard's task streams them through a once-seen and
a twice-seen filter: an item whose bits are all set in the first goes into the
second.  There are no false negatives: the second occurrence of a hash always
finds its own bits.  Only the twice-seen filter leaves the task.  Its size is
``BITS_PER_ITEM`` bits an item, and never more than ``MAX_BITS`` (64 MiB):
beyond that it fills up and lets more items pass, which costs shuffle later,
never a wrong answer.  That bound is why the filter may be broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, cut_lineage

BITS_PER_ITEM = 16
MAX_BITS = 1 << 29
SHARD_BITS = 1 << 21
_MULT = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def filter_bits(n_items: int) -> int:
    """Power of two with at least BITS_PER_ITEM bits an item, within [SHARD_BITS, MAX_BITS]."""
    need = max(BITS_PER_ITEM * max(n_items, 1), SHARD_BITS)
    return min(1 << (need - 1).bit_length(), MAX_BITS)


def split_hash(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard number and 32-bit remainder of 64-bit hashes."""
    n_shards = bits // SHARD_BITS
    shard = (h >> np.uint64(32)) & np.uint64(n_shards - 1)
    return shard.astype(np.int64), h.astype(np.uint32)


def _positions(rest: np.ndarray) -> list[np.ndarray]:
    shift = np.uint32(32 - (SHARD_BITS.bit_length() - 1))
    out = []
    with np.errstate(over="ignore"):
        for m in _MULT:
            x = rest * np.uint32(m)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            out.append(x >> shift)
    return out


class RepeatFilter:
    """Membership test in the twice-seen filter (unpacked once per worker)."""

    def __init__(self, bits: int, shards: dict[int, bytes]):
        self.bits = bits
        self.data = np.zeros(bits // 8, dtype=np.uint8)
        size = SHARD_BITS // 8
        for k, v in shards.items():
            self.data[k * size:(k + 1) * size] = np.frombuffer(v, dtype=np.uint8)

    def test(self, h: np.ndarray) -> np.ndarray:
        shard, rest = split_hash(h, self.bits)
        hit = np.ones(len(h), dtype=bool)
        for p in _positions(rest):
            at = shard * SHARD_BITS + p
            hit &= (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return hit


def repeat_filter(df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], n_items: int) -> RepeatFilter:
    """The twice-seen filter over ``hashes(slice)`` of all rows.

    ``hashes`` returns 64-bit hashes; one that it returns twice counts as seen twice.
    """
    bits = filter_bits(n_items)

    def send(b):
        h = hashes(b)
        shard, rest = split_hash(h, bits)
        order = np.argsort(shard, kind="stable")
        shard, rest = shard[order], rest[order]
        ids, at = np.unique(shard, return_index=True)
        yield {"shard": ids, "data": [x.tobytes() for x in np.split(rest, at[1:])] if len(ids) else []}

    def collect(batches):
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for b in batches:
            for shard, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rest, n = np.unique(np.frombuffer(data, dtype=np.uint32), return_counts=True)
                one = once.setdefault(shard, np.zeros(SHARD_BITS, dtype=bool))
                two = twice.setdefault(shard, np.zeros(SHARD_BITS, dtype=bool))
                pos = _positions(rest)
                hit = (n > 1) | (one[pos[0]] & one[pos[1]] & one[pos[2]])
                for p in pos:
                    two[p[hit]] = True
                    one[p] = True
        for shard, two in twice.items():
            if two.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int64()), pa.array([np.packbits(two, bitorder="little").tobytes()], pa.binary())],
                    names=["shard", "data"])

    n_shards = bits // SHARD_BITS
    sent = arrow_map(df, send, "shard long, data binary", max_bytes=32 << 20)
    parts = sent.repartition(min(n_shards, max(8, n_shards // 4)), "shard").mapInArrow(collect, "shard long, data binary")
    return RepeatFilter(bits, {r["shard"]: bytes(r["data"]) for r in cut_lineage(parts).collect()})
