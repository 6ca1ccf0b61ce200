"""Toxicity by a classifier chain: linear models in sequence, each also fed the probabilities of the ones before.

The models are logistic regressions over hashed words that are in a text or not. They are fitted on a bounded, seeded sample of
labelled rows (`sample`), spread over `folds` folds. For each category of the chain Spark fits folds + 1 models at once, one
per task: each fold's from the other folds, which gives the fold's rows out-of-fold probabilities, and one from all rows, which
is kept. Later categories are trained on the out-of-fold probabilities of earlier ones, so they see them as
uncertain as they will be on new texts. The last category's threshold is the one with the best F0.5 on its out-of-fold
probabilities, so clean texts count more than toxic ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidewatch.llm import words
from tidewatch.sources.storage import checkpointed

#: Hashed words; labelled rows fitted on at most; folds.
DIM_BITS, SAMPLE, FOLDS = 18, 10_000, 5
EPOCHS, BATCH, RATE, SHRINK, LEAST = 10, 200, 0.1, 1e-3, 5


def _features(part: words.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words and their rows, by row."""
    pairs = np.unique((part.row.astype(np.uint64) << np.uint64(DIM_BITS)) | (part.hashes() >> np.uint64(64 - DIM_BITS)))
    return (pairs & np.uint64((1 << DIM_BITS) - 1)).astype(np.int32), (pairs >> np.uint64(DIM_BITS)).astype(np.int64)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(np.clip(p, 1e-3, 1 - 1e-3) / (1 - np.clip(p, 1e-3, 1 - 1e-3)))


def _margins(weights: np.ndarray, cells: np.ndarray, rows: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
    """Sum of word weights, bias, and weighted logits of the earlier categories."""
    top = 1 << DIM_BITS
    return (np.bincount(rows, weights=weights[cells], minlength=n) + weights[top]
            + earlier @ weights[top + 1:top + 1 + earlier.shape[1]])


def _fit(cells: list[np.ndarray], earlier: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by AdaGrad with shrinkage, in a fixed order of rows: weights of words, bias, earlier categories.

    A word counts by the log ratio of its frequency in either class, one in fewer than LEAST rows not at all, so the
    many words that tell nothing don't add up in a long text.
    """
    top = 1 << DIM_BITS
    flat = np.concatenate([*cells, np.zeros(0, np.int32)])
    ones = np.bincount(flat, weights=np.repeat(y, np.array([len(c) for c in cells], dtype=np.int64)), minlength=top)
    rows_with, positives = np.bincount(flat, minlength=top), y.sum()
    ratio = np.log((ones + 1) / (positives + 2)) - np.log((rows_with - ones + 1) / (len(y) - positives + 2))
    scale = np.append(np.where(rows_with >= LEAST, np.abs(ratio), 0), np.ones(1 + earlier.shape[1]))
    weights, squares = np.zeros(len(scale)), np.full(len(scale), 1e-8)
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            some = order[at:at + BATCH]
            flat = np.concatenate([cells[i] for i in some])
            rows = np.repeat(np.arange(len(some)), [len(cells[i]) for i in some])
            error = (_squash(_margins(weights * scale, flat, rows, len(some), earlier[some])) - y[some]) / len(some)
            grad = SHRINK * weights
            grad[:top] += np.bincount(flat, weights=error[rows], minlength=top) * scale[:top]
            grad[top] += error.sum()
            grad[top + 1:] += earlier[some].T @ error
            squares += grad ** 2
            weights -= RATE * grad / np.sqrt(squares)
    return weights * scale


def _fold_fit(i: int, folds: int):
    """For the rows of one fit: its weights if it is the one of all folds, else the probabilities of its fold."""
    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        held = (group["fold"] == group["fit"]).to_numpy()
        cells = [np.frombuffer(c, np.int32) for c in group["cells"]]
        earlier = _logit(np.stack([np.asarray(e, dtype=float).reshape(-1) for e in group["earlier"]]))
        y = group[f"y{i}"].to_numpy(dtype=float)
        weights = _fit([c for c, h in zip(cells, held) if not h], earlier[~held], y[~held])
        if group["fit"].iloc[0] == folds:
            return pd.DataFrame({"id": [None], "p": [None], "weights": [weights.astype(np.float32).tobytes()]})
        mine = [c for c, h in zip(cells, held) if h]
        flat = np.concatenate([*mine, np.zeros(0, np.int32)])
        row = np.repeat(np.arange(len(mine)), np.array([len(c) for c in mine], dtype=np.int64))
        return pd.DataFrame({"id": group["id"][held], "p": _squash(_margins(weights, flat, row, len(mine), earlier[held])), "weights": None})
    return fit


class Chain:
    """The fitted models in order, and the threshold of the last."""

    def __init__(self, categories: list[str], weights: list[np.ndarray], threshold: float):
        self.categories, self.weights, self.threshold = categories, weights, threshold

    def probabilities(self, cells: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, 0))
        for weights in self.weights:
            out = np.column_stack([out, _squash(_margins(weights, cells, rows, n, _logit(out)))])
        return out


def train(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text",
          sample: int = SAMPLE, folds: int = FOLDS) -> Chain:
    """Fits the chain; `labels` has the id and a 0/1 column per category, in the order of `categories`.

    Rows with a null id or label are left out; of rows of one id the largest labels and the smallest text count. Without any
    labelled row every probability is 0.5 and nothing is toxic.
    """
    labels = labels.select(F.col(id_col).alias("id"), *[F.col(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories)]).dropna()
    chosen = (labels.groupBy("id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(categories))])
              .orderBy(F.xxhash64("id"), "id").limit(sample))
    texts = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(checkpointed(chosen, "labels")), "id")
             .groupBy("id", *[f"y{i}" for i in range(len(categories))]).agg(F.min("text").alias("text")))

    def featurized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                cells, rows = _features(part)
                ends = np.cumsum(np.bincount(rows, minlength=part.rows))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(part.first, part.rows) for i in range(1 + len(categories))),
                                                  pa.array([cells[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)], pa.binary())],
                                                 names=["id", *[f"y{i}" for i in range(len(categories))], "cells"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = checkpointed(texts.select("id", *[f"y{i}" for i in range(len(categories))], "text")
                        .mapInArrow(featurized, f"id {kind}, {''.join(f'y{i} int, ' for i in range(len(categories)))}cells binary")
                        .withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(folds)).cast("int")).withColumn("earlier", F.array().cast("array<double>")), "features")
    fitted, threshold = [], 1.1
    for i in range(len(categories)):
        done = checkpointed(rows.withColumn("fit", F.explode(F.sequence(F.lit(0), F.lit(folds)))).groupBy("fit")
                            .applyInPandas(_fold_fit(i, folds), f"id {kind}, p double, weights binary"), "fits")
        kept = done.where("weights IS NOT NULL").select("weights").collect()
        fitted.append(np.frombuffer(kept[0][0], np.float32).astype(float) if kept else np.zeros((1 << DIM_BITS) + 1 + i))
        rows = checkpointed(rows.join(done.where("p IS NOT NULL").select("id", "p"), "id").withColumn("earlier", F.concat("earlier", F.array("p"))).drop("p"), "features")
    last = [(r["earlier"][-1], r["y"]) for r in rows.select("earlier", F.col(f"y{len(categories) - 1}").alias("y")).collect()]  # at most `sample`
    if last:
        threshold = _best_threshold(*map(np.array, zip(*last)))
    return Chain(categories, fitted, threshold)


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where rejecting from p up has the best F0.5; above all of them if nothing is labelled toxic."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    if not hits[-1]:
        return 1.1
    precision, recall = hits / np.arange(1, len(y) + 1), hits / hits[-1]
    best = int(np.argmax(1.25 * precision * recall / np.maximum(0.25 * precision + recall, 1e-12)))
    after = p[order][best + 1] if best + 1 < len(y) else 0.0
    return float((p[order][best] + after) / 2)


def predict(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per row of `docs`: id, probabilities (one per category), toxic; with `carry` the input row as struct `row`.

    Null, empty and blank texts have no words: their probabilities are the models' biases and they are never toxic. Rows that
    repeat get the same result each; other columns are ignored, or carried.
    """
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(texts(batch), "_text"):
                p = chain.probabilities(*_features(part), part.rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(part.first, part.rows) for c in kept),
                                                  pa.ListArray.from_arrays(pa.array(np.arange(part.rows + 1) * p.shape[1], pa.int32()), pa.array(p.reshape(-1))),
                                                  pa.array((p[:, -1] >= chain.threshold) & (part.counts > 0))],
                                                 names=[*kept, "probabilities", "toxic"])

    taken, texts = words.carried(docs, text_col, carry)
    kept = ["id", "row"] if carry else ["id"]
    some = docs.select(F.col(id_col).alias("id"), *taken)
    schema = T.StructType([*some.select(*kept).schema.fields, T.StructField("probabilities", T.ArrayType(T.DoubleType())), T.StructField("toxic", T.BooleanType())])
    return some.mapInArrow(scored, schema).withColumnRenamed("id", id_col)


#: The labels table's categories: junk (quality 0), then toxic.
CATEGORIES = ["junk", "toxic"]


def fitted(spark, sf_dir: str, docs: DataFrame) -> Chain:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return train(docs, labels.select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic"), CATEGORIES)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    p = lambda i: F.element_at("probabilities", i + 1).alias(f"p_{CATEGORIES[i]}")
    return predict(docs, fitted(spark, sf_dir, docs)).select("doc_id", p(0), p(1), "toxic")
