"""Language identification by the nearest of several clustered centroids per language.

A text is a vector of hashed 1- to 3-grams of bytes (A-Z lower-cased, other ASCII than letters as one space), log
counts times inverse document frequency, normalised. Document frequencies come from all training texts; the
centroids of a language from spherical k-means over a bounded sample of its distinct training texts. A text gets the language of
the centroid with the largest cosine and is marked rejected if it is farther from it than the training texts are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.llm import words
from tidewatch.llm.lm_score import remainder
from tidewatch.sources.storage import checkpointed

#: Hashed n-grams; how many distinct training texts of a language the centroids are fitted on at most; centroids of a language.
DIMS, SAMPLE, CENTROIDS = 1 << 12, 1000, 4
#: The share of a centroid's training texts that lies within its distance.
WITHIN = 0.995
#: Languages whose sampling rates, and sampled hashes that, may be broadcast; beyond that the join is shuffled.
BROADCAST_ROWS = 100_000
_ROWS = 256

_FOLD = np.full(256, 0x20, dtype=np.uint64)
_FOLD[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = True


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n-gram counts of each row, (rows, DIMS); n-grams don't cross rows."""
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    folded = _FOLD[data]
    out, code = np.zeros(rows * DIMS), np.zeros(len(data), dtype=np.uint64)
    for n in range(3):
        code = code[:len(data) - n] * np.uint64(257) + folded[n:] if n else folded
        inside = row[:len(code)] == row[n:]
        bucket = ((code + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 12)
        out += np.bincount((row[:len(code)] * DIMS + bucket.astype(np.int64))[inside], minlength=rows * DIMS)
    return out.reshape(rows, DIMS)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    table = np.log1p(counts) * idf
    return (table / np.maximum(np.sqrt((table ** 2).sum(1, keepdims=True)), 1e-30)).astype(np.float32)


def _letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows have a letter, of any script."""
    found = np.add.reduceat(np.append(_ASCII_LETTER[data], False).astype(np.int64), offsets[:-1]) > 0
    found &= np.diff(offsets) > 0
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(c.isalpha() for c in data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


class Model:
    """Centroids of all languages; `languages` has each one's language, `limits` its distance."""

    def __init__(self, idf: np.ndarray, languages: list[str], centroids: np.ndarray, limits: np.ndarray):
        self.idf, self.languages, self.centroids, self.limits = idf, languages, centroids, limits


def _clustered(group: pd.DataFrame) -> pd.DataFrame:
    """Spherical k-means from spread-out starts; (lang, centroid, limit)."""
    table = np.stack([np.frombuffer(v, np.float32) for v in group.sort_values("key")["vector"]])
    centres = [table.mean(0)]
    while len(centres) < min(CENTROIDS + 1, len(table) + 1):
        centres.append(table[np.argmin((table @ np.stack(centres).T).max(1))])
    centres = np.stack(centres[1:])
    for _ in range(10):
        own = (table @ centres.T).argmax(1)
        centres = np.stack([table[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres /= np.maximum(np.sqrt((centres ** 2).sum(1, keepdims=True)), 1e-30)
    near = table @ centres.T
    own = near.argmax(1)
    limits = [float(np.quantile(1 - near[own == c, c], WITHIN)) if (own == c).any() else 0.0 for c in range(len(centres))]
    return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": [c.astype(np.float32).tobytes() for c in centres], "edge": limits})


def _few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def sample_texts(docs: DataFrame, sample: int) -> DataFrame:
    """(text, lang, key) of (text, lang): of each language's distinct texts with a letter the `sample` of smallest hash, once each.

    Copies count once, so no language is lost and none has more than `sample` texts.
    """
    key = F.xxhash64("text")

    def lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in words.raw_slices(batch, "text", rows=_ROWS):
                keep = pa.array(np.flatnonzero(_letters(data, offsets)))
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(first, len(offsets) - 1).take(keep) for i in (1, 2)], names=["lang", "key"])

    texts = checkpointed(docs.select("text", "lang", key.alias("key")).mapInArrow(lettered, "lang string, key long").distinct(), "texts")
    # some more than `sample` are let through by their hash alone, so that the ranking of a language is small
    rates = checkpointed(texts.groupBy("lang").agg((F.lit(2.0 * sample + 100) / F.count("*")).alias("rate")), "rates")
    near = texts.join(_few(rates), "lang").where(F.col("key") / 2.0 ** 64 + 0.5 <= F.col("rate"))
    chosen = checkpointed(near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("key")))
                          .where(F.col("place") <= sample).select("lang", "key"), "chosen")
    return (docs.select("text", "lang", key.alias("key")).join(_few(chosen), ["lang", "key"])
            .groupBy("lang", "key").agg(F.min("text").alias("text")).select("text", "lang", "key"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns from the rows of `docs` with a language and a letter."""
    docs = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS, dtype=np.int64), 0
        for batch in batches:
            for _, data, offsets in words.raw_slices(batch, "text", rows=_ROWS):
                total += (_counts(data, offsets) > 0).sum(0)
                n += len(offsets) - 1
        if n:
            yield pa.RecordBatch.from_pydict({"dim": np.arange(-1, DIMS, dtype=np.int32), "n": np.append(n, total)})

    known = {r["dim"]: r["n"] for r in docs.mapInArrow(frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    idf = np.log((1 + known.get(-1, 0)) / (1 + np.array([known.get(d, 0) for d in range(DIMS)]))) + 1

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in words.raw_slices(batch, "text", rows=_ROWS):
                keep = np.flatnonzero(_letters(data, offsets))
                table = _vectors(_counts(data, offsets), idf)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, len(offsets) - 1).take(pa.array(keep)), batch.column(2).slice(first, len(offsets) - 1).take(pa.array(keep)),
                                                  pa.array([table[i].tobytes() for i in keep], pa.binary())], names=["lang", "key", "vector"])

    some = sample_texts(docs, sample)
    rows = some.mapInArrow(sampled, "lang string, key long, vector binary").groupBy("lang").applyInPandas(_clustered, "lang string, centroid binary, edge double").collect()
    rows.sort(key=lambda r: (r["lang"], r["centroid"]))
    return Model(idf, [r["lang"] for r in rows], np.array([np.frombuffer(r["centroid"], np.float32) for r in rows]).reshape(-1, DIMS), np.array([r["edge"] for r in rows]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, rejected for every row.

    lang_pred is a learned language, or `und` where the text is null or has no letter (or nothing was learned). score is
    the cosine to the nearest centroid, 0 for `und`; of equally near centroids the language first in order wins. `rejected` marks
    texts farther from their centroid than its training texts, and `und`. Other columns are ignored.
    """
    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in words.raw_slices(batch, text_col, rows=_ROWS):
                n = len(offsets) - 1
                known = _letters(data, offsets) & bool(model.languages)
                cosines = _vectors(_counts(data, offsets), model.idf) @ model.centroids.T if model.languages else np.zeros((n, 1))
                best = cosines.argmax(1)
                score = np.where(known, np.clip(cosines[np.arange(n), best], 0, 1), 0.0).astype(np.float64)
                far = ~known | (1 - score > (model.limits[best] if model.languages else 0))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array([model.languages[b] if k else "und" for b, k in zip(best, known)], pa.string()),
                                                  pa.array(score), pa.array(far)], names=["id", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col))
            .mapInArrow(predicted, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(remainder("doc_id", 5) != 0))
    return predict(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")
