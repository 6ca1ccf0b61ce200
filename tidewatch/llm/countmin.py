"""Count-min sketches of hashed items of all texts: built per partition, merged by Spark, mapped by workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm import shared

#: Cells of one chunk of a sketch row; a chunk is merged and written by one task.
CHUNK_BITS = 22
#: A task sends its counts on after so many items, so its memory doesn't follow its input.
FLUSH_ITEMS = 4_000_000

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (hashes * np.uint64(_ODD[row])) >> np.uint64(64 - bits)


def corpus_words(docs: DataFrame, text_col: str = "text") -> int:
    """About how many words all texts have together (six bytes each): what ranges and sketches are sized by."""
    return (docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // 6


def width_bits(docs: DataFrame, text_col: str = "text", least: int = 16) -> int:
    """log2 of a width of at least one cell a word, so the error doesn't grow with the corpus, however large."""
    return max(least, corpus_words(docs, text_col).bit_length())


def range_bits(docs: DataFrame, text_col: str, words_a_range: int) -> int:
    """log2 of the number of hash ranges (8 or more) of about so many words of the corpus each."""
    return max(3, (corpus_words(docs, text_col) // words_a_range).bit_length())


#: Tasks that ranges or chunks are dealt to at most; a task takes its ranges one after another.
MOST_TASKS = 1 << 15


class Sketch:
    """`bits`: log2 of the cells of a row, `span`: of a chunk; `levels`: what a cell can count to (1 bit a cell if 2, else a byte)."""

    def __init__(self, folder: str, bits: int, span: int, depth: int, levels: int):
        self.folder, self.bits, self.span, self.depth, self.levels = folder, bits, span, depth, levels

    def estimate(self, hashes: np.ndarray) -> np.ndarray:
        """Never less than an item's true count, up to `levels`."""
        out = np.full(len(hashes), self.levels, dtype=np.uint8)
        for row in range(self.depth):
            at = cells(hashes, row, self.bits)
            chunks = (at >> np.uint64(self.span)).astype(np.int64)
            if self.bits - self.span <= 16:
                chunks = chunks.astype(np.uint16)  # sorts in linear time
            order = np.argsort(chunks, kind="stable")
            at, chunks = at[order] & np.uint64((1 << self.span) - 1), chunks[order].astype(np.int64)
            first = np.flatnonzero(np.diff(chunks, prepend=-1))
            for a, b in zip(first, [*first[1:], len(at)]):
                table, cell = shared.array(f"{self.folder}/{row}-{chunks[a]}", np.uint8), at[a:b]
                if self.levels == 2:
                    found = ((table[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1) + 1
                else:
                    found = table[cell]
                out[order[a:b]] = np.minimum(out[order[a:b]], found)
        return out


def build(docs: DataFrame, items: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int,
          levels: int = 2, depth: int = 2) -> Sketch:
    """Counts the item hashes that `items` yields for each batch, over all rows of `docs`."""
    folder = shared.array_folder(docs.sparkSession, "sketch")
    span = np.uint64(min(bits, CHUNK_BITS))
    chunks = 1 << (bits - int(span))

    def packed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate(held)
        for row in range(depth):
            at = np.sort(cells(hashes, row, bits))
            if levels < len(at):  # more than `levels` of a cell say nothing new
                at = at[np.concatenate([np.ones(levels, dtype=bool), at[levels:] != at[:-levels]])]
            chunks, first = np.unique(at >> span, return_index=True)
            ends = [*first[1:], len(at)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row * (1 << 40) + int(c) for c in chunks], pa.int64()),
                 pa.array([shared.encode(at[a:b] & ((np.uint64(1) << span) - np.uint64(1)))
                           for a, b in zip(first, ends)], pa.binary())], names=["chunk", "counts"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for hashes in items(batch):
                held.append(hashes)
                n += len(hashes)
                if n >= FLUSH_ITEMS:
                    yield from packed(held)
                    held, n = [], 0
        if n:
            yield from packed(held)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def write(key, counts):
            if levels == 2:
                counts = np.packbits(counts >= 2, bitorder="little")
            shared.write_array(f"{folder}/{key >> 40}-{key & ((1 << 40) - 1)}", counts)
        key, counts, written = None, None, 0
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if chunk != key:
                    if key is not None:
                        write(key, counts)
                    key, counts, written = chunk, np.zeros(1 << int(span), dtype=np.uint8), written + 1
                at = shared.decode(data).astype(np.int64)
                once = np.flatnonzero(np.diff(at, prepend=-1))
                n = np.diff(np.append(once, len(at)))
                counts[at[once]] = np.minimum(counts[at[once]].astype(np.int64) + n, levels)
        if key is not None:
            write(key, counts)
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["chunks"])

    # an empty message for each chunk, so that each is written
    every = docs.sparkSession.range(depth * chunks).select(
        F.expr(f"(id div {chunks}) * {1 << 40} + id % {chunks}").alias("chunk"), F.lit(bytearray()).alias("counts"))
    written = (docs.mapInArrow(partial, "chunk long, counts binary").unionByName(every)
               .repartition(max(8, min(depth * chunks, MOST_TASKS)), "chunk").sortWithinPartitions("chunk")
               .mapInArrow(merged, "chunks long").agg(F.sum("chunks")).first()[0])
    if written != depth * chunks:
        raise OSError(f"{written} of {depth * chunks} chunks of the sketch were written")
    return Sketch(folder, bits, int(span), depth, levels)
