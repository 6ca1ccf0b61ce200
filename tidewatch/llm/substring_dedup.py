"""Removes passages that repeat anywhere in the corpus: count-min prefilter, then exact grouping.

1. Each task counts the hashes of its windows of `window` words into a count-min sketch; Spark
   merges the partial sketches. A cell only tells whether two or more windows fell into it.
2. Windows whose estimate is 2 or more (all that repeat, and a few others) are grouped exactly by a
   128-bit hash of their words. Each task first reduces them to distinct windows with a mark "seen twice",
   packs them by hash range, and one task per range writes the sorted array of the windows that do repeat.
3. Each text is read once more; words covered by a window found in that array go.

No window is capped or dropped, and nothing is grouped by document or passage: a window that repeats
a million times reaches its range once per task, where copies are merged as they come. The sketch has a cell per corpus
word at least and the number of ranges follows the corpus, both without a limit, so the share of single windows that
pass and the size of a range stay the same at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm import countmin, shared, words

#: Distinct suspect windows that a task holds before it sends them on.
FLUSH_WINDOWS = 2_000_000
#: About how many corpus words one hash range of windows stands for.
SHARD_WORDS = 4_000_000


def repeated_windows(docs: DataFrame, window: int = 35, text_col: str = "text", bits: int | None = None) -> RepeatedWindows:
    """All windows of `window` words that start at two or more places of `docs`."""
    docs = docs.select(text_col)
    bits = bits or countmin.width_bits(docs, text_col)

    def hashed(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in words.slices(batch, text_col, lower=False):
            yield part.grams(part.hashes(), window)[0]

    sketch = countmin.build(docs, hashed, bits)
    shard_bits = countmin.range_bits(docs, text_col, SHARD_WORDS)
    shards, shift = 1 << shard_bits, np.uint64(64 - shard_bits)
    folder = shared.array_folder(docs.sparkSession, "windows")

    def packed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pairs, twice = _distinct(np.concatenate(held), None)
        ids, first = np.unique(pairs["a"] >> shift, return_index=True)
        ends = [*first[1:], len(pairs)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids.astype(np.int64)), pa.array([pairs[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
             pa.array([np.packbits(twice[a:b]).tobytes() for a, b in zip(first, ends)], pa.binary())],
            names=["shard", "pairs", "twice"])

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in words.slices(batch, text_col, lower=False):
                a, starts = part.grams(part.hashes(), window)
                keep = np.flatnonzero(sketch.estimate(a) >= 2)
                if len(keep):
                    pairs = np.empty(len(keep), dtype=_PAIR)
                    pairs["a"], pairs["b"] = a[keep], part.grams(part.hashes(1), window, 1)[0][keep]
                    held.append(pairs)
                    n += len(pairs)
                if n >= FLUSH_WINDOWS:
                    yield from packed(held)
                    held, n = [], 0
        if n:
            yield from packed(held)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def write(shard, pairs, twice):
            pairs, twice = _distinct(np.concatenate(pairs), np.concatenate(twice))
            pairs = pairs[twice]
            for half in ("a", "b"):
                shared.write_array(f"{folder}/{shard}-{half}", pairs[half])
            return len(pairs)
        key, pairs, twice, found, n, more = None, [], [], 0, 0, 0
        for batch in batches:
            for shard, data, marks in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if shard != key and key is not None:
                    found, n = found + write(key, pairs, twice), n + 1
                    pairs, twice, more = [], [], 0
                key = shard
                pairs.append(np.frombuffer(data, _PAIR))
                twice.append(np.unpackbits(np.frombuffer(marks, np.uint8), count=len(pairs[-1])).astype(bool))
                more += len(pairs[-1])
                if more >= FLUSH_WINDOWS:  # windows that many tasks sent are merged as they come
                    pairs, twice = ([x] for x in _distinct(np.concatenate(pairs), np.concatenate(twice)))
                    more = 0
        if key is not None:
            found, n = found + write(key, pairs, twice), n + 1
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.int64()), pa.array([n], pa.int64())], names=["found", "shards"])

    # an empty message for each shard, so that each is written
    every = docs.sparkSession.range(shards).select(F.col("id").alias("shard"), F.lit(bytearray()).alias("pairs"), F.lit(bytearray()).alias("twice"))
    found, written = (docs.mapInArrow(suspects, "shard long, pairs binary, twice binary").unionByName(every)
                      .repartition(min(shards, countmin.MOST_TASKS), "shard").sortWithinPartitions("shard")
                      .mapInArrow(exact, "found long, shards long").agg(F.sum("found"), F.sum("shards")).first())
    if written != shards:
        raise OSError(f"{written} of {shards} window ranges were written")
    return RepeatedWindows(sketch, folder, int(shift), window, found)


_PAIR = np.dtype([("a", np.uint64), ("b", np.uint64)])


def _distinct(pairs: np.ndarray, twice: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct pairs; whether a pair came more than once or was marked so."""
    if not len(pairs):
        return pairs, np.zeros(0, dtype=bool)
    order = np.argsort(pairs["a"], kind="stable")
    pairs = pairs[order]
    if len(pairs) > 1 and np.any((pairs["a"][1:] == pairs["a"][:-1]) & (pairs["b"][1:] != pairs["b"][:-1])):
        again = np.lexsort((pairs["b"], pairs["a"]))
        order, pairs = order[again], pairs[again]
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    many = np.diff(np.append(first, len(pairs))) > 1
    if twice is not None:
        many |= np.logical_or.reduceat(twice[order], first)
    return pairs[first], many


class RepeatedWindows:
    """The sorted arrays of repeated windows, one file per hash range, mapped by the workers that look up."""

    def __init__(self, sketch: countmin.Sketch, folder: str, shift: int, window: int, count: int):
        self.sketch, self.folder, self.shift, self.window, self.count = sketch, folder, shift, window, count

    def contain(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), dtype=bool)
        order = np.argsort(a)
        a, b = a[order], b[order]
        ids = (a >> np.uint64(self.shift)).astype(np.int64)
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        for lo, hi in zip(first, [*first[1:], len(a)]):
            keys, seconds = (shared.array(f"{self.folder}/{ids[lo]}-{x}", np.uint64) for x in "ab")
            if not len(keys):
                continue
            at = np.searchsorted(keys, a[lo:hi])
            hit = np.zeros(hi - lo, dtype=bool)
            while True:  # almost always one step: windows of equal first hash stand side by side
                inside = np.minimum(at, len(keys) - 1)
                same = (at < len(keys)) & (keys[inside] == a[lo:hi])
                hit |= same & (seconds[inside] == b[lo:hi])
                if not np.any(same & ~hit):
                    break
                at = at + 1
            out[order[lo:hi]] = hit
        return out

    def covered(self, part: words.Slice) -> np.ndarray:
        """Which words of the slice lie in a repeated window."""
        n = len(part.starts)
        edges = np.zeros(n + 1, dtype=np.int64)
        a, starts = part.grams(part.hashes(), self.window)
        maybe = np.flatnonzero(self.sketch.estimate(a) >= 2)
        if len(maybe):
            b = part.grams(part.hashes(1), self.window, 1)[0]
            hit = starts[maybe[self.contain(a[maybe], b[maybe])]]
            np.add.at(edges, hit, 1)
            np.add.at(edges, hit + self.window, -1)
        return np.cumsum(edges[:n]) > 0


def remove_repeated(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text",
                    bits: int | None = None) -> DataFrame:
    """One row per row of `docs`: id, n_words, n_removed, kept (the words that stay, joined by one space).

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A null, empty or blank text has no words and an empty
    `kept`; texts of fewer than `window` words stay whole; rows that repeat, whether the id does or not, repeat
    each other's windows; other columns are ignored, also ones with the names of the result.
    """
    found = repeated_windows(docs, window, text_col, bits)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, text_col, lower=False):
                keep = np.flatnonzero(~found.covered(part))
                kept = np.bincount(part.row[keep], minlength=part.rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, part.rows), pa.array(part.counts.astype(np.int64)),
                     pa.array((part.counts - kept).astype(np.int64)), _joined(part, keep)],
                    names=["id", "n_words", "n_removed", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col))
            .mapInArrow(cleaned, f"id {kind}, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col))


def _joined(part: words.Slice, keep: np.ndarray) -> pa.Array:
    """For each row, its words of the numbers `keep` joined by one space."""
    sizes = part.ends[keep] - part.starts[keep]
    rows = part.row[keep]
    last = np.ones(len(keep), dtype=bool)
    last[:-1] = rows[1:] != rows[:-1]
    spans = sizes + ~last  # a space follows each word but the last of a row
    ends = np.cumsum(spans)
    total = int(ends[-1]) if len(ends) else 0
    out = np.full(total, 0x20, dtype=np.uint8)
    begins = ends - spans
    to = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    fro = np.repeat(part.starts[keep] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    out[to] = part.data[fro]
    offsets = np.zeros(part.rows + 1, dtype=np.int32)
    np.cumsum(np.bincount(rows, weights=spans, minlength=part.rows).astype(np.int64), out=offsets[1:])
    return pa.StringArray.from_buffers(part.rows, pa.py_buffer(offsets), pa.py_buffer(out))


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return (remove_repeated(docs)
            .select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))
