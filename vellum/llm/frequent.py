"""Frequent 64-bit hashes of a corpus, by mergeable Misra-Gries summaries.

Hashes are dealt into partitions by their leading bits. A partition's summary has a
capacity above its mass divided by ``least``, so its error stays below ``least`` and every
hash that occurs ``least`` times survives, however many distinct ones pass through.
Survivors mark their partition's segment of a bitmap of 2^BITS bits, the only thing that
reaches the driver, and of this size for any corpus. A bitmap that fills up marks more
than is frequent, never less."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import shuffles_dropped

#: Hashes share a bitmap of 2^BITS bits (16 MB).
BITS = 27
#: Entries of one summary, about, and the most hash partitions; beyond, summaries are larger.
CAPACITY, MOST_PARTS = 1 << 18, 1 << 14
#: Distinct hashes that a task combines before it sends them.
COMBINE = 1 << 22
#: Bits of a hash that are sent, besides those that name its partition. Equal ones only make a summary keep more.
SENT = 40


class MisraGries:
    """Counts of frequent keys. ``error`` is how far a count may be too small;
    it stays below ``least``: a summary whose capacity can't hold to that grows."""

    def __init__(self, capacity: int, least: int):
        self.capacity, self.least, self.error, self.room = max(1, capacity), least, 0, 4 * max(1, capacity)
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        if len(self.keys) + sum(len(k) for k, _ in self.waiting) > self.room:
            self.compress()

    def merge(self, other: MisraGries) -> None:
        """Take over another summary: both errors add up. With a capacity above the
        mass of both divided by ``least`` the sum stays below ``least``."""
        other.compress()
        if self.error + other.error >= self.least:
            raise ValueError("the summaries are too small for their mass: frequent keys could be lost")
        self.error += other.error
        self.add(other.keys, other.counts)

    def compress(self) -> None:
        if self.waiting:
            self.keys, self.counts = combined(np.concatenate([self.keys, *(k for k, _ in self.waiting)]),
                                              np.concatenate([self.counts, *(c for _, c in self.waiting)]))
            self.waiting = []
        if len(self.keys) > self.capacity:
            at = len(self.keys) - self.capacity - 1
            cut = int(np.partition(self.counts, at)[at])  # the largest count that has no place
            if self.error + cut < self.least:
                left = self.counts > cut
                self.keys, self.counts, self.error = self.keys[left], self.counts[left] - cut, self.error + cut
        self.room = max(4 * self.capacity, 2 * len(self.keys))

    def frequent(self) -> np.ndarray:
        """All keys whose true count may be ``least`` or more."""
        self.compress()
        return self.keys[self.counts + self.error >= self.least]


def combined(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, their counts summed."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def counted_in(keys: np.ndarray, counts: np.ndarray, raw: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts, with the keys of ``raw`` counted in. The
    counts of known keys are raised in place, so only new keys cost a copy."""
    if not raw:
        return keys, counts
    new, n = np.unique(np.concatenate(raw), return_counts=True)
    at = np.searchsorted(keys, new)
    known = np.zeros(len(new), bool)
    inside = at < len(keys)
    known[inside] = keys[at[inside]] == new[inside]
    counts[at[known]] += n[known]
    at, new, n = at[~known], new[~known], n[~known]
    return np.insert(keys, at, new), np.insert(counts, at, n)


def marked(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - BITS)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0


def _short(keys: np.ndarray, bits: int) -> bytes:
    """Hashes of one partition in SENT bits each, without the leading ``bits``."""
    return (keys << np.uint64(bits) >> np.uint64(64 - SENT)).view(np.uint8).reshape(-1, 8)[:, :SENT // 8].tobytes()


def _long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) * 8 // SENT, 8), np.uint8)
    out[:, :SENT // 8] = np.frombuffer(raw, np.uint8).reshape(len(out), -1)
    return out.view(np.uint64).ravel()


def _packed(segment: np.ndarray) -> bytes:
    """Flags as bits, compressed: few are set, and the driver's JVM copies these bytes more than once."""
    return pa.compress(np.packbits(segment, bitorder="little").tobytes(), codec="zstd", asbytes=True)


def parts_bits(mass: int, least: int) -> int:
    """So many leading bits of a hash name its partition."""
    return min(MOST_PARTS, max(1, mass // (least * CAPACITY))).bit_length()


def frequent_bitmap(rows: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], mass: int, least: int) -> np.ndarray:
    """The bitmap of the hashes that may occur ``least`` times or more. ``hashes``
    makes a task's Arrow batches of ``rows`` into arrays of 64-bit hashes, ``mass`` of them
    at most in all."""
    bits = parts_bits(mass, least)
    parts, shift = 1 << bits, np.uint64(64 - bits)
    capacity = max(CAPACITY, mass // (least * parts) + 1)

    def count(batches):
        keys, counts, raw = np.empty(0, np.uint64), np.empty(0, np.int64), []

        def sent():
            edge = np.searchsorted(keys >> shift, np.arange(parts + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(edge))
            for some in np.array_split(full, max(1, -(-len(keys) // COMBINE) * 4)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array([_short(keys[edge[p]:edge[p + 1]], bits) for p in some], pa.binary()),
                     pa.array([counts[edge[p]:edge[p + 1]].tobytes() for p in some], pa.binary())], names=["part", "keys", "counts"])

        for h in hashes(batches):
            raw.append(h)
            if sum(map(len, raw)) > COMBINE // 8:
                keys, counts = counted_in(keys, counts, raw)
                raw = []
                if len(keys) > COMBINE:
                    yield from sent()
                    keys, counts = keys[:0], counts[:0]
        keys, counts = counted_in(keys, counts, raw)
        if len(keys):
            yield from sent()

    def summarise(batches):
        summaries: dict[int, MisraGries] = {}  # one: a task has the rows of one hash partition
        for batch in batches:
            for p, k, c in zip(*(x.to_pylist() for x in batch.columns)):
                summaries.setdefault(p, MisraGries(capacity, least)).add(_long(k), np.frombuffer(c, np.int64))
        for p, summary in summaries.items():
            segment = np.zeros(1 << (BITS - bits), bool)
            segment[summary.frequent() >> np.uint64(SENT - BITS + bits)] = True
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([_packed(segment)], pa.binary())],
                                             names=["part", "segment"])

    dealt = rows.mapInArrow(count, "part int, keys binary, counts binary").repartitionById(parts, F.col("part"))
    bitmap = np.zeros(1 << (BITS - 3), np.uint8)
    size = len(bitmap) // parts
    with shuffles_dropped(rows.sparkSession):
        segments = dealt.mapInArrow(summarise, "part int, segment binary").collect()  # about len(bitmap) bytes in all at most
    for p, segment in segments:
        bitmap[p * size:(p + 1) * size] = np.frombuffer(pa.decompress(segment, decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    return bitmap
