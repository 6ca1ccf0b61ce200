"""Minimal perfect hashing of a set of 64-bit keys, in parts that Spark's tasks build and workers map.

A part holds the keys of one hash range. In it, a key takes the bit of the first level at which no other key hashes to the
same bit; its number is how many bits are set before. So n keys get the numbers 0 to n - 1 with a few bits a key.
The keys are stored by number, so a key that is not of the set is told from those that are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm import shared, words

#: Keys of a part on average, and bits of a level for each key still to be placed.
PART_KEYS, SPREAD = 1 << 16, 1.5

_SEED = 0x9E3779B97F4A7C15


def _bits(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (words.mix(keys.astype(np.uint64) + np.uint64((level + 1) * _SEED & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)


def _numbers(at: np.ndarray, bits: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For places in the bit array, how many bits are set before each."""
    word, low = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
    return before[word].astype(np.int64) + np.bitwise_count(bits[word] & low)


def build_part(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct keys: bits of each level, all bits, set bits before each word of them, and the keys by number."""
    sizes, levels, rest = [], [], keys.astype(np.int64)
    while len(rest):
        size = -(-int(SPREAD * len(rest) + 1) // 64) * 64
        at = _bits(rest, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        rest = rest[~alone[at]]
    flat = np.concatenate([*levels, np.zeros(0, dtype=bool)])
    bits = np.packbits(flat, bitorder="little").view(np.uint64)
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])[:-1].astype(np.uint32)
    sizes, by_number = np.array(sizes, dtype=np.int64), np.empty(len(keys), dtype=np.int64)
    by_number[look_up(keys, sizes, bits, before)] = keys
    return sizes, bits, before, by_number


def look_up(keys: np.ndarray, sizes: np.ndarray, bits: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Numbers of keys; that of a key which was not built in is any number, or -1."""
    out, open_, start = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        if not len(open_):
            break
        at = start + _bits(keys[open_], level, int(size))
        hit = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        out[open_[hit]] = _numbers(at[hit], bits, before)
        open_, start = open_[~hit], start + int(size)
    return out


class PerfectHash:
    """Parts are named by the leading `part_bits` bits of a key's hash; `sizes` has the number of keys of each."""

    def __init__(self, folder: str, part_bits: int, sizes: list[int]):
        self.folder, self.part_bits, self.sizes = folder, part_bits, sizes

    def parts(self, keys: np.ndarray) -> np.ndarray:
        return part_of(keys, self.part_bits)

    def numbers(self, part: int, keys: np.ndarray) -> np.ndarray:
        """Numbers within a part, -1 for keys that are not of the set."""
        if not self.sizes[part]:
            return np.full(len(keys), -1, dtype=np.int64)
        sizes, bits, before, own = (shared.array(f"{self.folder}/{part}-{name}", kind) for name, kind in _ARRAYS)
        at = look_up(keys, sizes, bits, before)
        return np.where((at >= 0) & (own[at] == keys), at, -1)

    def keys(self, part: int) -> np.ndarray:
        """The keys of a part by number."""
        return shared.array(f"{self.folder}/{part}-keys", np.int64)

    def spans(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For sorted or unsorted keys, by part: the part, which of the keys are in it, their numbers."""
        parts = self.parts(keys)
        order = np.argsort(parts, kind="stable")
        first = np.flatnonzero(np.diff(parts[order], prepend=-1))
        for a, b in zip(first, [*first[1:], len(keys)]):
            part, some = int(parts[order[a]]), order[a:b]
            yield part, some, self.numbers(part, keys[some])


_ARRAYS = (("sizes", np.int64), ("bits", np.uint64), ("before", np.uint32), ("keys", np.int64))


def part_of(keys: np.ndarray, part_bits: int) -> np.ndarray:
    if not part_bits:
        return np.zeros(len(keys), dtype=np.int64)
    return (words.mix(keys.astype(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - part_bits)).astype(np.int64)


def build(keys: DataFrame, count: int, part_keys: int | None = None) -> PerfectHash:
    """Of a table of `count` distinct longs; one task builds a part at a time."""
    spark, name = keys.sparkSession, keys.columns[0]
    part_bits = max(0, (count // (part_keys or PART_KEYS)).bit_length())
    folder, parts = shared.array_folder(spark, "hash"), 1 << part_bits

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(part_of(values, part_bits)), pa.array(values)], names=["part", "key"])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def write():
            own = np.concatenate(held)
            own = own[own >= 0]
            for (what, _), values in zip(_ARRAYS, build_part(own)):
                shared.write_array(f"{folder}/{part}-{what}", values)
            return pa.RecordBatch.from_pydict({"part": [part], "size": [len(own)]})
        for batch in batches:
            numbers, values = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            first = np.flatnonzero(np.diff(numbers, prepend=-1))
            for a, b in zip(first, [*first[1:], len(numbers)]):
                if part is not None and numbers[a] != part:
                    yield write()
                    held = []
                part = int(numbers[a])
                held.append(values[a:b])
        if part is not None:
            yield write()

    every = spark.range(parts).select(F.col("id").alias("part"), F.lit(-1).cast("long").alias("key"))  # so that each part is written
    sizes = {r["part"]: r["size"] for r in (
        keys.select(F.col(name).cast("long").alias("key")).mapInArrow(dealt, "part long, key long").unionByName(every)
        .repartition(min(parts, 4096), "part").sortWithinPartitions("part").mapInArrow(built, "part long, size long").collect())}
    if len(sizes) != parts or sum(sizes.values()) != count:
        raise OSError(f"{sum(sizes.values())} of {count} keys were placed")
    return PerfectHash(folder, part_bits, [sizes[p] for p in range(parts)])
