"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted arrays, mapped by workers.

Training, over every training text, for words and then for each length of n-grams up to the order:
1. Words are counted by 64-bit hash; one task per hash range writes the sorted hashes and their counts. A word's id is
   its place in this order, so ids need no dictionary on the driver.
2. n-grams are counted as the integer (id of all but the last word) * vocabulary + (id of the last), an exact and invertible
   key; the first id is the place of that shorter n-gram among its sorted keys. Tasks send distinct n-grams with counts,
   gap-coded; one task per range of contexts writes the sorted keys and, for the order itself, counts, and for each
   context its total and how many successors occur once, twice, more often.
3. Each range's distinct n-grams without their first word are summed to the continuation counts of the level below (after how
   many words the shorter n-gram comes), which are that level's counts.

Scoring maps the arrays in each worker and looks up a slice of texts at once:
p(w|uv) = max(c(uvw) - D(c), 0) / c(uv) + g(uv) * p(w|v), and so on down to p(w) = max(N(w) - D'(N), 0) / N + g' / (V + 1),
with N the continuation counts and the three discounts of each level from its counts of counts. Texts begin with order - 1
begin marks. A word not seen in training is the one extra class of the V + 1. Probabilities over the V + 1 classes sum to 1
after every context.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm import countmin, shared, words
from tidewatch.sources.storage import checkpointed, remove_folder

#: Tokens that a task counts before it sends counts on; words per range of the model.
FLUSH_TOKENS, RANGE_WORDS = 4_000_000, 4_000_000

_BEGIN, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def remainder(id_col: str, of: int) -> Column:
    """crc32 of the id as text modulo `of`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % of


def _sequence(part: words.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes, an end after each text; where texts begin; the row of each token."""
    rows = np.arange(part.rows)
    tokens = np.empty(len(part.starts) + part.rows, dtype=np.uint64)
    tokens[np.arange(len(part.starts)) + part.row] = part.hashes()
    tokens[part.at[1:] + rows] = _END
    return tokens, part.at[:-1] + rows, np.repeat(rows, part.counts + 1)


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first) if len(first) else counts
    return keys[first], sums.astype(np.int64)


def _pack(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Which counts exceed 1, and those."""
    more = counts > 1
    return np.packbits(more).tobytes(), counts[more].astype(np.uint32).tobytes()


def _unpack(n: int, more: bytes, values: bytes) -> np.ndarray:
    counts = np.ones(n, dtype=np.int64)
    counts[np.unpackbits(np.frombuffer(more, np.uint8), count=n).astype(bool)] = np.frombuffer(values, np.uint32)
    return counts


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of a partition that is sorted by its first column, one group at a time."""
    key, held = None, []
    for batch in batches:
        for k, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key and key is not None:
                yield key, held
                held = []
            key = k
            held.append(rest)
    if key is not None:
        yield key, held


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == n).sum()) for n in (1, 2, 3, 4)]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more, from how many items have counts 1, 2, 3, 4; each between 0 and its count."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return tuple(min(float(k), max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0.5 * k for k in (1, 2, 3))


def _write_small(path: str, values: np.ndarray) -> None:
    """Mostly small counts: a byte each, larger ones apart with their places."""
    large = np.flatnonzero(values >= 255)
    shared.write_array(path, np.minimum(values, 255).astype(np.uint8))
    shared.write_array(f"{path}-at", large.astype(np.int64))
    shared.write_array(f"{path}-value", values[large].astype(np.int64))


class Model:
    """Where the arrays lie, and the totals. Arrays are mapped when first used in a process.

    Levels are the lengths of n-grams, 1 to `order`. The id of an n-gram is its place among the sorted keys of its level, a
    key is (id of all but the last word) * vocabulary + (id of the last word).
    """

    def __init__(self, folder: str, shift: int, order: int):
        self.folder, self.shift, self.order = folder, shift, order
        self.offsets: list[int] = []
        self.vocabulary = self.types = self.tokens = 0
        self.begin = -1
        self.low, self.low_rest = (0.5, 1.0, 1.5), 1.0
        #: By level: distinct n-grams, the first id of each range, contexts of a range, discounts.
        self.grams: dict[int, int] = {}
        self.firsts: dict[int, list[int]] = {}
        self.per_range: dict[int, int] = {2: 1}
        self.high: dict[int, tuple[float, float, float]] = {}

    def array(self, name: str, dtype) -> np.ndarray:
        return shared.array(f"{self.folder}/{name}", dtype)

    def small(self, name: str, at: np.ndarray) -> np.ndarray:
        out = self.array(name, np.uint8)[at].astype(np.int64)
        large = np.flatnonzero(out == 255)
        if len(large):
            out[large] = self.array(f"{name}-value", np.int64)[shared.find(self.array(f"{name}-at", np.int64), at[large])]
        return out

    def edge(self, level: int) -> int:
        """The id of the context of `level` begin marks."""
        return self.begin if level == 1 else self.grams[level]

    def before(self, grams: np.ndarray, level: int, begins: np.ndarray) -> np.ndarray:
        """The contexts of tokens, from the ids of the n-grams of `level` words that end at each token."""
        out = np.empty_like(grams)
        out[1:] = grams[:-1]
        out[begins] = self.edge(level)
        return out

    def found(self, level: int, before: np.ndarray, ids: np.ndarray, counted: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1 if not seen) and counts of n-grams, given as context and last word."""
        size, known = np.uint64(max(1, self.vocabulary)), np.flatnonzero((ids >= 0) & (before >= 0))
        keys, back = np.unique(before[known].astype(np.uint64) * size + ids[known].astype(np.uint64), return_inverse=True)
        grams, counts = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        ranges = (keys // (size * np.uint64(self.per_range[level]))).astype(np.int64)
        first = np.flatnonzero(np.diff(ranges, prepend=-1))
        for a, b in zip(first, [*first[1:], len(keys)]):
            at = shared.find(self.array(f"gram{level}-{ranges[a]}", np.uint64), keys[a:b])
            some = np.flatnonzero(at >= 0)
            grams[a + some] = at[some] + self.firsts[level][ranges[a]]
            if counted:
                counts[a + some] = self.small(f"count{level}-{ranges[a]}", at[some])
        out = np.full(len(ids), -1, dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
        out[0][known], out[1][known] = grams[back], counts[back]
        return out

    def grams_at(self, tokens: np.ndarray, begins: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Word ids, and the ids of the n-grams of `level` words that end at each token."""
        ids = grams = self.ids(tokens)
        for k in range(2, level + 1):
            grams, _ = self.found(k, self.before(grams, k - 1, begins), ids, counted=False)
        return ids, grams

    def tails(self, level: int, ids: np.ndarray) -> np.ndarray:
        """Ids of n-grams of `level` words without their first word; ids are sorted, the last may be the edge."""
        if level == 1:
            return np.zeros(len(ids), dtype=np.int64)
        out = np.full(len(ids), self.edge(level - 1), dtype=np.int64)
        inner = ids[ids < self.grams[level]]
        ranges = np.searchsorted(np.array(self.firsts[level]), inner, "right") - 1
        first = np.flatnonzero(np.diff(ranges, prepend=-1))
        for a, b in zip(first, [*first[1:], len(inner)]):
            at = inner[a:b] - self.firsts[level][ranges[a]]
            if level == 2:
                out[a:b] = (self.array(f"gram2-{ranges[a]}", np.uint64)[at] % np.uint64(self.vocabulary)).astype(np.int64)
            else:
                out[a:b] = self.array(f"tail{level}-{ranges[a]}", np.int64)[at]
        return out

    def contexts(self, level: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Totals of sorted contexts, and what they leave to the level below."""
        total, rest = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts))
        per_range = self.per_range[level]
        ranges = np.where(starts < 0, -1, starts // per_range)
        first = np.flatnonzero(np.diff(ranges, prepend=-2))
        for a, b in zip(first, [*first[1:], len(starts)]):
            if ranges[a] >= 0:
                at = starts[a:b] - ranges[a] * per_range
                total[a:b] = self.small(f"total{level}-{ranges[a]}", at)
                rest[a:b] = sum(d * self.small(f"after{level}-{k}-{ranges[a]}", at) for k, d in zip((1, 2, 3), self.high[level]))
        return total, np.where(total > 0, rest / np.maximum(total, 1), 1.0)

    def write_counts(self, level: int, key: int, first: np.ndarray, counts: np.ndarray) -> None:
        """Counts of the n-grams of a range and sums by context; `first` is the context of each within the range."""
        _write_small(f"{self.folder}/count{level}-{key}", counts)
        n = self.per_range[level]
        _write_small(f"{self.folder}/total{level}-{key}", np.bincount(first, weights=counts, minlength=n).astype(np.int64))
        for k, those in ((1, counts == 1), (2, counts == 2), (3, counts > 2)):
            _write_small(f"{self.folder}/after{level}-{k}-{key}", np.bincount(first[those], minlength=n))

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of words, -1 for words not seen in training."""
        distinct, back = np.unique(hashes, return_inverse=True)
        out = np.full(len(distinct), -1, dtype=np.int64)
        ranges = (distinct >> np.uint64(self.shift)).astype(np.int64)
        first = np.flatnonzero(np.diff(ranges, prepend=-1))
        for a, b in zip(first, [*first[1:], len(distinct)]):
            at = shared.find(self.array(f"word-hash-{ranges[a]}", np.uint64), distinct[a:b])
            out[a:b] = np.where(at < 0, -1, at + self.offsets[ranges[a]])
        return out[back]

    def _each(self, ids: np.ndarray, bounds: np.ndarray, name: str, dtype) -> np.ndarray:
        """Values of per-word arrays that are cut at `bounds`; 0 for an unknown word. ids are sorted."""
        out = np.zeros(len(ids), dtype=dtype)
        ranges = np.searchsorted(bounds, ids, "right") - 1
        first = np.flatnonzero(np.diff(ranges, prepend=-2))
        for a, b in zip(first, [*first[1:], len(ids)]):
            if ranges[a] >= 0:
                out[a:b] = self.array(f"{name}-{ranges[a]}", dtype)[ids[a:b] - bounds[ranges[a]]]
        return out

    def logs(self, tokens: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: its training count, its log10 base probability, its log10 model probability."""
        ids = grams = self.ids(tokens)
        distinct, back = np.unique(ids, return_inverse=True)
        by_hash, by_id = np.array(self.offsets), np.arange(0, self.vocabulary + 1, self.per_range[2])
        counts = self._each(distinct, by_hash, "word-count", np.int64)
        base = np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.types + 1)))
        follows = self._each(distinct, by_id, "follows", np.int64)
        low = np.full(len(distinct), self.low_rest / (self.types + 1))
        if self.grams[2]:
            low += np.maximum(follows - np.array([0, *self.low])[np.minimum(follows, 3)], 0) / self.grams[2]

        p = low[back]
        for level in range(2, self.order + 1):
            before = self.before(grams, level - 1, begins)
            starts, back_starts = np.unique(before, return_inverse=True)
            total, rest = self.contexts(level, starts)
            grams, number = self.found(level, before, ids)
            high = np.maximum(number - np.array([0, *self.high[level]])[np.minimum(number, 3)], 0)
            p = high / np.maximum(total, 1)[back_starts] + rest[back_starts] * p
        return counts[back], base[back], np.log10(p)


def train(docs: DataFrame, text_col: str = "text", order: int = 2) -> Model:
    """Counts all texts of `docs` for n-grams of up to `order` words (2 or more); a null text is empty and counts as its end alone."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    docs, spark = docs.select(text_col), docs.sparkSession
    range_bits = countmin.range_bits(docs, text_col, RANGE_WORDS)
    ranges = 1 << range_bits
    model = Model(shared.array_folder(spark, "model"), 64 - range_bits, order)
    folder, shift = model.folder, np.uint64(model.shift)
    reducers = min(ranges, countmin.MOST_TASKS)

    def flushed(batches, keys_of, pack):
        held, n = [], 0
        for batch in batches:
            for part in words.slices(batch, text_col):
                held.append(keys_of(part))
                n += len(held[-1])
                if n >= FLUSH_TOKENS:
                    yield pack(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield pack(np.concatenate(held))

    def cut(ids, *columns):
        owners, first = np.unique(ids, return_index=True)
        spans = list(zip(first, [*first[1:], len(ids)]))
        return pa.array(owners.astype(np.int64)), spans

    def pack_words(tokens):
        hashes, counts = _summed(tokens)
        owners, spans = cut(hashes >> shift)
        return pa.RecordBatch.from_arrays([owners, pa.array([hashes[a:b].tobytes() for a, b in spans], pa.binary()),
                                           *(pa.array([_pack(counts[a:b])[i] for a, b in spans], pa.binary()) for i in (0, 1))], names=["range", "keys", "more", "counts"])

    def write_words(batches):
        for key, rows in _by_key(batches):
            keys = [np.frombuffer(k, np.uint64) for k, _, _ in rows]
            hashes, counts = _summed(np.concatenate(keys), np.concatenate([_unpack(len(k), m, c) for k, (_, m, c) in zip(keys, rows)]))
            begin = shared.find(hashes, np.array([_BEGIN]))[0]
            if key == int(_BEGIN >> shift) and begin < 0:
                begin = int(np.searchsorted(hashes, _BEGIN))
                hashes, counts = np.insert(hashes, begin, _BEGIN), np.insert(counts, begin, 0)
            shared.write_array(f"{folder}/word-hash-{key}", hashes)
            shared.write_array(f"{folder}/word-count-{key}", counts)
            yield pa.RecordBatch.from_pydict({"range": [key], "size": [len(hashes)], "tokens": [int(counts.sum())], "types": [int((counts > 0).sum())], "begin": [int(begin)]})

    none = [F.lit(bytearray()).alias(c) for c in ("keys", "more", "counts")]
    every = spark.range(ranges).select(F.col("id").alias("range"), *none)  # an empty message for each range, so that each is written
    parts = (docs.mapInArrow(lambda it: flushed(it, lambda p: _sequence(p)[0], pack_words), "range long, keys binary, more binary, counts binary")
             .unionByName(every).repartition(reducers, "range").sortWithinPartitions("range")
             .mapInArrow(write_words, "range long, size long, tokens long, types long, begin long").collect())
    sizes = {p["range"]: p["size"] for p in parts}
    model.offsets = [int(x) for x in np.cumsum([0, *(sizes.get(r, 0) for r in range(ranges - 1))])]
    model.vocabulary, model.tokens, model.types = (sum(p[x] for p in parts) for x in ("size", "tokens", "types"))
    if model.vocabulary >= 1 << 32:
        raise ValueError("word ids are 32 bits wide; the corpus has more distinct words")
    model.begin = next(model.offsets[p["range"]] + p["begin"] for p in parts if p["range"] == int(_BEGIN >> shift))
    for level in range(2, order + 1):
        _count_level(docs, text_col, model, level, every, reducers, flushed, cut)
    return model


def _count_level(docs: DataFrame, text_col: str, model: Model, level: int, every: DataFrame, reducers: int, flushed, cut) -> None:
    """Writes the n-grams of `level` words, their counts if that is the order, and the continuation counts of the level below."""
    folder, below, top, ranges = model.folder, level - 1, level == model.order, every.count()
    contexts = model.vocabulary if level == 2 else model.grams[below] + 1
    if contexts * model.vocabulary >= 1 << 64:
        raise ValueError("n-gram keys are 64 bits wide; the corpus has more distinct n-grams")
    model.per_range[level] = -(-contexts // ranges)
    size, per_range = np.uint64(model.vocabulary), np.uint64(model.per_range[level])
    gaps = np.uint32 if contexts * model.vocabulary < FLUSH_TOKENS << 32 else np.uint64

    def grams_of(part):
        tokens, begins, _ = _sequence(part)
        ids, grams = model.grams_at(tokens, begins, below)
        return model.before(grams, below, begins).astype(np.uint64) * size + ids.astype(np.uint64)

    def pack_grams(keys):
        keys, counts = _summed(keys)
        if not top:
            counts = np.ones_like(counts)
        of = keys // (size * per_range)
        owners, spans = cut(of)
        return pa.RecordBatch.from_arrays([owners, pa.array([shared.encode(keys[a:b] - of[a] * size * per_range, gaps) for a, b in spans], pa.binary()),
                                           *(pa.array([_pack(counts[a:b])[i] for a, b in spans], pa.binary()) for i in (0, 1))], names=["range", "keys", "more", "counts"])

    def write_grams(batches):
        for key, rows in _by_key(batches):
            start = np.uint64(key) * size * per_range
            keys = [shared.decode(k, gaps) for k, _, _ in rows]
            keys, counts = _summed(np.concatenate(keys), np.concatenate([_unpack(len(k), m, c) for k, (_, m, c) in zip(keys, rows)]))
            shared.write_array(f"{folder}/gram{level}-{key}", keys + start)
            first = (keys // size).astype(np.int64)
            if top:
                model.write_counts(level, key, first, counts)
            tails = (keys % size).astype(np.int64)
            if level > 2:
                starts, back = np.unique(first, return_inverse=True)
                tails, _ = model.found(below, model.tails(below, starts + key * int(per_range))[back], tails, counted=False)
                if not top:
                    shared.write_array(f"{folder}/tail{level}-{key}", tails)
            tails, often = _summed(tails)
            if level == 2:
                of = tails // int(per_range)
                tails = tails - of * int(per_range)
            else:
                bounds = np.array(model.firsts[below])
                of = np.searchsorted(bounds, tails, "right") - 1
                tails = tails - bounds[of]
            _, spans = cut(of)
            yield pa.RecordBatch.from_pydict({
                "range": [int(of[a]) for a, _ in spans] + [-1], "keys": [shared.encode(tails[a:b], np.uint8) for a, b in spans] + [None],
                "more": [_pack(often[a:b])[0] for a, b in spans] + [None], "counts": [_pack(often[a:b])[1] for a, b in spans] + [None],
                "stats": [None] * len(spans) + [[key, len(keys), *_counts_of_counts(counts)]]}, schema=_CONTINUED)

    def write_follows(batches):
        for key, rows in _by_key(batches):
            grams = None if level == 2 else model.array(f"gram{below}-{key}", np.uint64)
            follows = np.zeros(int(per_range) if level == 2 else len(grams), dtype=np.int64)
            for keys, more, counts in rows:
                at = shared.decode(keys).astype(np.int64)
                follows[at] += _unpack(len(at), more, counts)
            if level == 2:
                shared.write_array(f"{folder}/follows-{key}", follows)
            else:
                model.write_counts(below, key, (grams // size).astype(np.int64) - key * model.per_range[below], follows)
            yield pa.RecordBatch.from_pydict({"stats": [[int((follows > 2).sum()), *_counts_of_counts(follows)]]})

    continued = checkpointed(docs.mapInArrow(lambda it: flushed(it, grams_of, pack_grams), "range long, keys binary, more binary, counts binary")
                             .unionByName(every).repartition(reducers, "range").sortWithinPartitions("range")
                             .mapInArrow(write_grams, "range long, keys binary, more binary, counts binary, stats array<long>"), "continued")
    stats = [r[0] for r in continued.where("range < 0").select("stats").collect()]
    sizes = {x[0]: x[1] for x in stats}
    model.firsts[level] = [int(x) for x in np.cumsum([0, *(sizes.get(r, 0) for r in range(ranges - 1))])]
    model.grams[level] = sum(sizes.values())
    if top:
        model.high[level] = discounts([sum(x) for x in zip(*(x[2:] for x in stats))] or [0] * 4)
    stats = [r[0] for r in continued.where("range >= 0").select("range", "keys", "more", "counts").unionByName(every).repartition(reducers, "range")
             .sortWithinPartitions("range").mapInArrow(write_follows, "stats array<long>").collect()]
    more, *low = [sum(x) for x in zip(*stats)] or [0] * 5
    if level > 2:
        model.high[below] = discounts(low)
    else:
        model.low = discounts(low)
        if model.grams[2]:
            model.low_rest = (model.low[0] * low[0] + model.low[1] * low[1] + model.low[2] * more) / model.grams[2]
    remove_folder(docs.sparkSession, continued.inputFiles()[0].rsplit("/", 1)[0])


_CONTINUED = pa.schema([("range", pa.int64()), ("keys", pa.binary()), ("more", pa.binary()), ("counts", pa.binary()), ("stats", pa.list_(pa.int64()))])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score, score of every row; `score` / n_tokens gives the perplexity.

    Tokens are words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, then one end. Null, empty and blank texts
    are the end alone. Rows that repeat are scored each; other columns are ignored. A model trained on nothing
    gives every token probability 1, as the base does.
    """
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, text_col):
                tokens, begins, rows = _sequence(part)
                counts, base, logs = model.logs(tokens, begins)
                total = lambda x: np.bincount(rows, weights=x, minlength=part.rows)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, part.rows), pa.array((part.counts + 1).astype(np.int64)),
                     pa.array(total(counts > 0).astype(np.int64)), pa.array(total(base)), pa.array(total(logs))],
                    names=["id", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col))
            .mapInArrow(scored, f"id {kind}, n_tokens long, n_known long, base_score double, score double").withColumnRenamed("id", id_col))


def _op4(spark, sf_dir: str, order: int) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(remainder("doc_id", 10) != 0), order=order)
    return score(docs, model).select(
        "doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lm_score(spark, sf_dir: str) -> DataFrame:
    return _op4(spark, sf_dir, 2)


def op4_lm_score_trigram(spark, sf_dir: str) -> DataFrame:
    return _op4(spark, sf_dir, 3)
