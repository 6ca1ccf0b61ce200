"""Aligns the tokens of two tokenizers over a corpus and counts which tokens stand for which.

1. Texts are tokenised once; the ids are stored, two or four bytes each.
2. The first pass aligns every text by byte offsets and gives the distinct (A id, B id) pairs that overlap anywhere. A
   minimal perfect hash numbers them.
3. Each task counts its links into dense vectors, one per part of the hash, indexed by the hash. Vectors are summed up
   a tree of shuffles and written as one array a part, next to the pairs by number.
4. The second pass aligns the texts again and looks the counts up; stored keys prove each number.

Two tokens overlap in one stretch of bytes, and between two neighbouring ends of tokens of either kind lies exactly one
such stretch. So links are found by merging the two lists of ends, never by comparing tokens pairwise.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm import perfect_hash, shared, words
from tidewatch.sources.storage import checkpointed

BYTE_BPE, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that are tokenised, tokens that are aligned at once; a longer text is taken alone.
TEXT_BYTES, TOKENS = 1 << 20, 1 << 19
#: Distinct pairs that a task holds before it sends them on, cells of count vectors it holds, vectors summed by one group.
FLUSH_PAIRS, FLUSH_CELLS, BRANCH = 4_000_000, 16_000_000, 16


# ---- tokenizers -------------------------------------------------------------------

def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_level_bytes(vocabulary: dict[str, int]) -> list[bytes]:
    letters = _byte_letters()
    out = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    return out


def piece_bytes(pieces: list[str]) -> list[bytes]:
    one = re.compile(r"<0x([0-9A-F]{2})>")
    return [bytes([int(m[1], 16)]) if (m := one.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]


# Fixed value: how byte-level BPE cuts a text into stretches that are merged each for itself.
STRETCH = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizers:
    """Two tokenizers from the contents of their files, so that workers need no file; each process loads them once.

    Where the merges of A's file stand in the order of their ids, as byte-level vocabularies have them, ids are ranks, and a
    faster library gives the same ids from the same vocabulary; stretches of blanks beyond its stack go to the other one.
    """

    def __init__(self, a_json: str, b_model: bytes):
        self.a_json, self.b_model = a_json, b_model

    @classmethod
    def read(cls, a_path: str = BYTE_BPE, b_path: str = PIECES) -> Tokenizers:
        with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
            return cls(a.read(), b.read())

    def __getstate__(self):
        return {"a_json": self.a_json, "b_model": self.b_model}

    @functools.cached_property
    def _spec(self) -> dict:
        return json.loads(self.a_json)

    @functools.cached_property
    def _a(self):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_str(self.a_json)
        loaded.encode_special_tokens = True
        return loaded

    @functools.cached_property
    def _a_ranks(self):
        """The faster encoder of A, or None where ids are not ranks."""
        model, cut = self._spec["model"], self._spec.get("pre_tokenizer") or {}
        ids, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not self._spec.get("normalizer")
        if not plain or sorted(ids.values()) != list(range(len(ids))) or any(ids.get(x + y) != 256 + k for k, (x, y) in enumerate(merges)):
            return None
        import tiktoken

        extra = {t["id"] for t in self._spec["added_tokens"]}
        ranks = {self.a_bytes[i]: i for i in ids.values() if i not in extra}
        return tiktoken.Encoding("a", pat_str=STRETCH, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def _b(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.b_model)

    @functools.cached_property
    def a_bytes(self) -> list[bytes]:
        return byte_level_bytes(self._spec["model"]["vocab"] | {t["content"]: t["id"] for t in self._spec["added_tokens"]})

    @functools.cached_property
    def b_bytes(self) -> list[bytes]:
        return piece_bytes([self._b.id_to_piece(i) for i in range(self._b.get_piece_size())])

    @functools.cached_property
    def vocabularies(self) -> list[Vocabulary]:
        return [Vocabulary(self.a_bytes), Vocabulary(self.b_bytes)]

    def encode_a(self, text: str) -> np.ndarray:
        if self._a_ranks is not None:
            try:
                return self._a_ranks.encode_to_numpy(text, disallowed_special=())
            except ValueError:
                pass
        return np.array(self._a.encode(text, add_special_tokens=False).ids, dtype=np.int64)

    def encode(self, texts: list[str], raw: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """By each tokenizer the ids of all texts and how many each text has: none where the bytes of its tokens are not a space and
        its own. `raw` holds the bytes of the texts, `sizes` how many each has."""
        found = [[self.encode_a(" " + t) if t else _NONE for t in texts],
                 [np.array(ids, dtype=np.int64) for ids in self._b.encode(texts, num_threads=1)]]
        same, out = sizes > 0, []
        for ids, vocabulary in zip(found, self.vocabularies):
            counts = np.array([len(x) for x in ids], dtype=np.int64)
            flat = np.concatenate([_NONE, *ids]).astype(np.int64)
            same &= vocabulary.spells(flat, counts, raw, sizes)
            out.append((flat, counts))
        return [(flat[np.repeat(same, counts)].astype(v.kind), np.where(same, counts, 0)) for (flat, counts), v in zip(out, self.vocabularies)]


_NONE = np.zeros(0, dtype=np.int64)


class Vocabulary:
    """The bytes of each id, and what numbers hold an id."""

    def __init__(self, tokens: list[bytes]):
        self.size, self.lengths = len(tokens), np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts, self.data = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(tokens), np.uint8)
        self.kind = np.dtype("<u2" if len(tokens) <= 1 << 16 else "<u4")

    def spells(self, ids: np.ndarray, counts: np.ndarray, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which texts, given by their bytes and sizes, are what their tokens say after a space."""
        lengths, rows = self.lengths[ids], np.repeat(np.arange(len(counts)), counts)
        ends = np.cumsum(lengths)
        total = np.bincount(rows, weights=lengths, minlength=len(counts)).astype(np.int64)
        right = total == sizes + 1
        if not right.any():
            return right
        said = self.data[np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1])]
        begins = np.cumsum(total) - total
        inner = np.ones(len(said), dtype=bool)
        inner[begins[total > 0]] = False
        right[right] = said[begins[right]] == 0x20
        said, kept = said[inner & np.repeat(right, total)], np.repeat(right, sizes)
        wrong = np.repeat(np.flatnonzero(right), sizes[right])[said != raw[kept]]
        right[wrong] = False
        return right


def tokenized(docs: DataFrame, tokenizers, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a, b): the ids of each text as packed little-endian numbers. `tokenizers` is a broadcast of Tokenizers."""
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = tokenizers.value
        for batch in batches:
            for first, raw, offsets in words.raw_slices(batch, size=TEXT_BYTES):
                n = len(offsets) - 1
                found = two.encode(batch.column(1).slice(first, n).fill_null("").to_pylist(), raw, np.diff(offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), *(_packed_rows(*f) for f in found)], names=["id", "a", "b"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(encoded, f"id {kind}, a binary, b binary")


def _packed_rows(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts * values.itemsize, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(values)]).cast(pa.binary())


# ---- alignment --------------------------------------------------------------------

class Aligned:
    """Some texts side by side: `a`, `b` their ids, `a_at`, `b_at` where each text's begin.

    Of every byte it is marked whether a token of A, of B ends there; texts follow each other, as both spell each whole.
    """

    def __init__(self, columns: list[pa.Array], vocabularies: list[Vocabulary]):
        (self.a, self.a_at), (self.b, self.b_at) = (_unpacked(c, v.kind) for c, v in zip(columns, vocabularies))
        ends = [np.cumsum(v.lengths[ids]) for v, ids in zip(vocabularies, (self.a, self.b))]
        self.marks = np.zeros((2, int(ends[0][-1]) + 1 if len(ends[0]) else 1), dtype=bool)
        for mark, at in zip(self.marks, ends):
            mark[at] = True
        self.a_last, self.b_last = self.marks[1][ends[0]], self.marks[0][ends[1]]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Which token of A and which of B, for each stretch of bytes that no token's end cuts."""
        a_ends, b_ends = self.marks[:, np.flatnonzero(self.marks[0] | self.marks[1])]
        return np.cumsum(a_ends) - a_ends, np.cumsum(b_ends) - b_ends

    def groups(self, a_names: np.ndarray, b_names: np.ndarray) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` for each text; the names of all ids as they stand inside a group, then as they end one."""
        a_group, b_group = np.cumsum(self.a_last) - self.a_last, np.cumsum(self.b_last) - self.b_last
        a_until = np.append(np.flatnonzero(self.a_last) + 1, 0)  # tokens up to the end of each group
        b_from = np.append(0, np.flatnonzero(self.b_last) + 1)
        out = np.empty(len(self.a) + len(self.b), dtype=object)
        out[np.arange(len(self.a)) + b_from[a_group]] = a_names[self.a + self.a_last * (len(a_names) // 2)]
        out[np.arange(len(self.b)) + a_until[b_group]] = b_names[self.b + self.b_last * (len(b_names) // 2)]
        at = self.a_at + self.b_at
        return ["".join(out[i:j].tolist())[:-1] for i, j in zip(at[:-1], at[1:])]


def _unpacked(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a packed column, and where each row's begin."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + column.offset + 1)[column.offset:]
    values = np.frombuffer(data if data is not None else b"", np.uint8)[offsets[0]:offsets[-1]]
    return values.view(kind).astype(np.int64), (offsets - offsets[0]) // kind.itemsize


def _pieces(batch: pa.RecordBatch, vocabularies: list[Vocabulary]) -> Iterator[tuple[int, int, Aligned]]:
    """A batch of `tokenized` in pieces of whole rows: first and last row, and their alignment."""
    columns = [batch.column(batch.schema.get_field_index(c)) for c in "ab"]
    sizes = np.cumsum((pc.binary_length(columns[0]).to_numpy(zero_copy_only=False) // vocabularies[0].kind.itemsize).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + TOKENS, "right")))
        yield first, last, Aligned([c.slice(first, last - first) for c in columns], vocabularies)
        first = last


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the number of each key among them."""
    bits = max(1, len(keys).bit_length())
    if not len(keys) or int(keys.max()).bit_length() + bits > 63:
        return np.unique(keys, return_inverse=True)
    both = np.sort(keys << bits | np.arange(len(keys)))  # values alone sort faster than places do
    sorted_keys, at = both >> bits, both & ((1 << bits) - 1)
    new = np.diff(sorted_keys, prepend=-1) != 0
    back = np.empty(len(keys), dtype=np.int64)
    back[at] = np.cumsum(new) - 1
    return sorted_keys[new], back


def distinct_pairs(tokens: DataFrame, tokenizers, width: int) -> DataFrame:
    """(key): A id * width + B id of all pairs of tokens that overlap anywhere."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [_NONE], 0

        def sent(keys):
            return (pa.RecordBatch.from_arrays([pa.array(keys[at:at + (1 << 16)])], names=["key"]) for at in range(0, len(keys), 1 << 16))
        for batch in batches:
            for _, _, part in _pieces(batch, tokenizers.value.vocabularies):
                i, j = part.links()
                held.append(np.unique(part.a[i] * width + part.b[j]))
                n += len(held[-1])
                if n >= FLUSH_PAIRS:
                    held = [np.unique(np.concatenate(held))]
                    n = len(held[0])
                    if n >= FLUSH_PAIRS // 2:
                        yield from sent(held[0])
                        held, n = [_NONE], 0
        yield from sent(np.unique(np.concatenate(held)))

    return tokens.select("a", "b").mapInArrow(found, "key long").distinct()


# ---- counts -----------------------------------------------------------------------

class PairCounts:
    """Counts of pairs by the number that a perfect hash gives them, and the largest count of each B id."""

    def __init__(self, hashed: perfect_hash.PerfectHash, folder: str, width: int, best: np.ndarray):
        self.hashed, self.folder, self.width, self.best = hashed, folder, width, best

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of distinct keys; 0 for a pair that never overlaps."""
        out = np.zeros(len(keys), dtype=np.int64)
        for part, some, at in self.hashed.spans(keys):
            if self.hashed.sizes[part]:
                out[some] = np.where(at >= 0, shared.array(f"{self.folder}/{part}", np.int64)[at], 0)
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """(a_id, b_id, n) of all pairs, one part of the hash at a time."""
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    keys, n = (np.asarray(x) for x in (self.hashed.keys(part), shared.array(f"{self.folder}/{part}", np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(keys // self.width), pa.array(keys % self.width), pa.array(n)], names=["a_id", "b_id", "n"])
        parts = len(self.hashed.sizes)
        return spark.range(0, parts, 1, min(parts, 4096)).mapInArrow(rows, "a_id long, b_id long, n long")


def count_pairs(tokens: DataFrame, tokenizers, width: int, part_keys: int | None = None) -> PairCounts:
    """Numbers the distinct pairs and counts every link of the corpus."""
    spark = tokens.sparkSession
    pairs = checkpointed(distinct_pairs(tokens, tokenizers, width), "pairs")
    hashed = perfect_hash.build(pairs, pairs.count(), part_keys)
    folder, parts = shared.array_folder(spark, "counts"), len(hashed.sizes)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = TaskContext.get().partitionId(), {}
        for batch in batches:
            for _, _, piece in _pieces(batch, tokenizers.value.vocabularies):
                i, j = piece.links()
                keys, often = np.unique(piece.a[i] * width + piece.b[j], return_counts=True)
                for part, some, at in hashed.spans(keys):
                    if (at < 0).any():
                        raise OSError("a pair of the first pass is not in the hash")
                    if part not in held:
                        held[part] = np.zeros(hashed.sizes[part], dtype=np.int64)
                    held[part][at] += often[some]
                if sum(map(len, held.values())) > FLUSH_CELLS:
                    yield from _packed(held, task)
                    held = {}
        yield from _packed(held, task)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, group), total in _totals(batches):
            yield from _packed({part: total}, group // BRANCH)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for (part, _), total in _totals(batches, hashed.sizes):
            shared.write_array(f"{folder}/{part}", total)
            n += 1
        yield pa.RecordBatch.from_pydict({"written": [n]})

    schema, reducers = "part long, grp long, counts binary", min(4096, max(8, parts))
    tasks = tokens.select("a").rdd.getNumPartitions()
    sums = tokens.select("a", "b").mapInArrow(vectors, schema).withColumn("grp", F.expr(f"grp div {BRANCH}"))
    for _ in range(math.ceil(math.log(max(2, tasks), BRANCH)) - 1):
        sums = sums.repartition(reducers, "part", "grp").sortWithinPartitions("part", "grp").mapInArrow(summed, schema)
    every = spark.range(parts).select(F.col("id").alias("part"), F.lit(0).cast("long").alias("grp"), F.lit(bytearray()).alias("counts"))
    n = (sums.withColumn("grp", F.lit(0).cast("long")).unionByName(every).repartition(reducers, "part").sortWithinPartitions("part")
         .mapInArrow(written, "written long").agg(F.sum("written")).first()[0])
    if n != parts:
        raise OSError(f"{n} of {parts} count vectors were written")
    found = PairCounts(hashed, folder, width, np.zeros(width, dtype=np.int64))
    best = found.table(spark).groupBy("b_id").agg(F.max("n").alias("n")).collect()  # a row per B id at most, which its vocabulary bounds
    for row in best:
        found.best[row["b_id"]] = row["n"]
    return found


def _packed(vectors: dict[int, np.ndarray], group: int) -> Iterator[pa.RecordBatch]:
    for part, counts in vectors.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([group], pa.int64()), pa.array([counts.tobytes()], pa.binary())],
                                         names=["part", "grp", "counts"])


def _totals(batches: Iterator[pa.RecordBatch], sizes: list[int] | None = None) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """Sums of the vectors of each (part, group) of a sorted partition, one vector in memory."""
    key, total = None, None
    for batch in batches:
        for part, group, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (part, group) != key:
                if key is not None:
                    yield key, total
                key, total = (part, group), np.zeros(sizes[part] if sizes is not None else len(data) // 8, dtype=np.int64)
            if data:
                total += np.frombuffer(data, np.int64)
    if key is not None:
        yield key, total


# ---- result -----------------------------------------------------------------------

def align(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECES, id_col: str = "doc_id", text_col: str = "text",
          part_keys: int | None = None) -> tuple[DataFrame, PairCounts]:
    """One row per row of `docs`, and the counts of all pairs.

    Rows: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (`a1,a2|b1;a3|b2,b3`: ids by groups). Texts are encoded without
    special tokens, after a space: A gets it with the text, B adds it itself. A null or empty text, and one whose tokens do not
    give its bytes back by either tokenizer, has no tokens: zeros and an empty string. Blank texts are texts. Rows that repeat
    are counted each; other columns are ignored; an empty table gives no rows. A text is taken whole whatever its length; a
    task needs some hundred bytes a token of its longest one.
    """
    spark = docs.sparkSession
    two = Tokenizers.read(a_path, b_path)  # a few MB, whatever the corpus
    width = two.vocabularies[1].size
    tokenizers = spark.sparkContext.broadcast(two)
    tokens = checkpointed(tokenized(docs, tokenizers, id_col, text_col), "tokens")
    counts = count_pairs(tokens, tokenizers, width, part_keys)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers.value.vocabularies
        a_names, b_names = (np.array([f"{i}{end}" for end in ends for i in range(v.size)], dtype=object) for v, ends in zip(own, (",|", ",;")))

        def sums(values, ends):  # exact, of the values up to each row's end
            return pa.array(np.diff(np.append(0, np.cumsum(values, dtype=np.int64))[np.append(0, ends)]))
        for batch in batches:
            for first, last, part in _pieces(batch, own):
                i, j = part.links()
                keys, back = _numbered(part.a[i] * width + part.b[j])
                count = counts.counts(keys)
                best = count == counts.best[keys % width]
                a_ends, link_ends = part.a_at[1:], np.searchsorted(i, part.a_at[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(np.diff(part.a_at)), pa.array(np.diff(part.b_at)),
                     sums(part.a_last, a_ends), pa.array(np.diff(link_ends, prepend=0)), sums(best[back], link_ends), sums(count[back], link_ends),
                     pa.array(part.groups(a_names, b_names), pa.string())],
                    names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = tokens.mapInArrow(looked_up, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
    return rows.withColumnRenamed("id", id_col), counts


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    rows, _ = align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                       F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256)).alias("groups_sha256"))
