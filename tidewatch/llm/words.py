"""Words of whole texts and their hashes, vectorised over slices of an Arrow batch.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D. As those are ASCII, this
works on UTF-8 bytes. Hashes are 64 bits wide; operators that group exactly take two of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: A slice holds about so many bytes of text at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_AS_IS = np.arange(256, dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, kept for the longest slice so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            steps = np.full(size, self.base, dtype=np.uint64)
            steps[0] = 1
            back = np.full(size, self.inverse, dtype=np.uint64)
            back[0] = 1
            self.up, self.down = np.cumprod(steps), np.cumprod(back)
        return self.up[:n], self.down[:n]


_BYTES = (_Powers(0x9E3779B97F4A7C15 | 1), _Powers(0xD6E8FEB86659FD93))
_GRAMS = (_Powers(0xA0761D6478BD642F), _Powers(0xE7037ED1A0B428DB))


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """A hash of values[start:end] for every pair, which doesn't depend on where it stands."""
    up, down = powers.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Slice:
    """Some rows of a batch: `data` holds their bytes, `starts` and `ends` the words, `row` each word's row.

    Rows count from `first` in the batch; `counts` has the words of each row, `at` the first word of each
    row and, at the end, the number of words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, lower: bool):
        self.first, self.rows, self.offsets = first, len(offsets) - 1, offsets
        self.data = (_LOWER if lower else _AS_IS)[data]
        word = ~_IS_SPACE[data]
        filled = offsets[:-1] < offsets[1:]
        opens = np.empty(len(data), dtype=bool)
        opens[:1] = True
        np.logical_not(word[:-1], out=opens[1:])
        opens[offsets[:-1][filled]] = True
        closes = np.empty(len(data), dtype=bool)
        closes[-1:] = True
        np.logical_not(word[1:], out=closes[:-1])
        closes[offsets[1:][filled] - 1] = True
        self.starts = np.flatnonzero(word & opens)
        self.ends = np.flatnonzero(word & closes) + 1
        self.at = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.at)
        self.row = np.repeat(np.arange(self.rows), self.counts)

    def hashes(self, which: int = 0) -> np.ndarray:
        return _ranges(self.data.astype(np.uint64) + np.uint64(1), self.starts, self.ends, _BYTES[which])

    def grams(self, words: np.ndarray, n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive words of one row, and the number of the word each starts at."""
        starts = np.arange(max(0, len(words) - n + 1))
        starts = starts[self.row[starts] == self.row[starts + n - 1]]
        return _ranges(words, starts, starts + n, _GRAMS[which]), starts

    def shingles(self, n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-word shingles and their rows; a row of fewer words has one of all its words."""
        words = self.hashes(which)
        found, starts = self.grams(words, n, which)
        short = np.flatnonzero((self.counts > 0) & (self.counts < n))
        if not len(short):
            return found, self.row[starts]
        whole = _ranges(words, self.at[short], self.at[short + 1], _GRAMS[which])
        rows = np.concatenate([self.row[starts], short])
        order = np.argsort(rows, kind="stable")
        return np.concatenate([found, whole])[order], rows[order]


def raw_slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES,
               rows: int = 1 << 30) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The batch in pieces of whole rows: first row, bytes of their texts, offsets of each row. A null text is empty."""
    texts = batch.column(column)
    if not len(texts):
        return
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, dtype=np.int64, count=len(texts) + texts.offset + 1)[texts.offset:]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = min(first + rows, max(first + 1, int(np.searchsorted(ends, ends[first] + size, "right")) - 1))
        yield first, data[ends[first]:ends[last]], ends[first:last + 1] - ends[first]
        first = last


def slices(batch: pa.RecordBatch, column: str = "text", lower: bool = True,
           size: int = SLICE_BYTES) -> Iterator[Slice]:
    """The batch in slices of whole rows; a null text has no words."""
    for first, data, offsets in raw_slices(batch, column, size):
        yield Slice(data, offsets, first, lower)


def carried(docs: DataFrame, text_col: str, carry: bool) -> tuple[list[Column], Callable[[pa.RecordBatch], pa.RecordBatch]]:
    """Columns that take a row's text to Python, as `_text` or with `carry` within the whole row as struct `row`, and what gets
    the texts of a batch of them. A carried text goes over once."""
    if not carry:
        return [F.col(text_col).alias("_text")], lambda batch: batch
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    if docs.columns.count(text_col) != 1:  # an expression, or a name in other letters
        return [F.col(text_col).alias("_text"), row], lambda batch: batch
    at = docs.columns.index(text_col)
    return [row], lambda batch: pa.RecordBatch.from_arrays([batch.column("row").field(at)], names=["_text"])
