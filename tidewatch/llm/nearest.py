"""Approximate nearest neighbours by inner product with collision-counting hashing.

1. Index: every task cuts its rows into blocks and projects them on `projections` random lines; a block
   keeps, for each line, its rows sorted by their projection, as arrays in the shared folder. All rows are indexed.
   Inner products become distances by dividing vectors by the largest norm of their length, one more component sqrt(1 - |v|^2),
   and queries scaled to norm 1: the largest product is the smallest distance.
2. Search: for each line a window is centred on the query's own projection. A row collides once for each line whose window
   holds it; rows with at least `threshold` of all lines are verified by their exact product. Virtual rehashing widens all
   windows of a query step by step, counting only what each step adds, until a row as near as the k-th best so
   far would have been verified with the wanted probability. Windows never narrow and there is no cap on
   candidates: if distances don't tell rows apart, all of them are verified.

Tasks take a few queries each and map the blocks one after the other, so memory is a block's, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm import shared
from tidewatch.sources.storage import checkpointed

#: Rows of a block, queries of a task's piece of work, factor by which windows widen.
BLOCK_ROWS, PIECE, WIDEN = 4096, 32, 1.5
BLOCKS = pa.schema([("block", pa.string()), ("dim", pa.int32()), ("top_peak", pa.float64()), ("top_factor", pa.float64()),
                    ("rows", pa.int64()), ("queries", pa.int64())])


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           projections: int = 48, threshold: float = 0.70, sure: float = 0.97, seed: int = 1) -> DataFrame:
    """(query_id, rank, id, score): for each row whose id is divisible by `every`, its k nearest other rows.

    Nearest is the largest inner product in double precision, ties to the smaller id. Rows with a null id or
    a vector that is null, empty, zero, or holds null or non-finite components take no part. Vectors of several lengths are
    each searched among those of their own length. Components of any size take part; where a product is too large or too small for a
    double, the score is what doubles make of it (infinity, 0, or not a number, which comes last). Repeated ids and equal
    vectors are candidates each, also for each other; with fewer than k candidates all are returned; an empty table gives
    no rows; other columns are ignored. `sure` is the probability with which a row as near as the k-th one is found.
    """
    spark = vectors.sparkSession
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
            .where("id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))")
            .withColumn("dim", F.size("v")).withColumn("peak", F.array_max(F.transform("v", F.abs))).where("peak > 0"))
    # a norm is its largest component times a factor, so that squares neither vanish nor overflow
    factor = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("peak")) * (x / F.col("peak"))))
    longest = F.max_by(F.struct("peak", "factor"), F.log("peak") + F.log("factor"))
    shapes = checkpointed(rows.select("dim", "peak", factor.alias("factor")).groupBy("dim").agg(longest.alias("m"))
                          .select("dim", F.col("m.peak").alias("top_peak"), (F.col("m.factor") * (1 + 1e-12)).alias("top_factor")), "shapes")
    folder = shared.array_folder(spark, "nearest")
    need = int(np.ceil(threshold * projections))
    p = next(p for p in np.arange(threshold, 1, 0.001) if p - NormalDist().inv_cdf(sure) * np.sqrt(p * (1 - p) / projections) >= threshold)
    reach = NormalDist().inv_cdf((1 + p) / 2)  # window, in distances

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held = TaskContext.get().partitionId(), 0, {}

        def block(shape):
            nonlocal n
            dim, pieces = shape[0], held.pop(shape)
            ids, table = np.concatenate([i for i, _ in pieces]), np.concatenate([v for _, v in pieces])
            small = table / shape[1] / shape[2]
            lift = np.sqrt(np.maximum(1 - (small ** 2).sum(1), 0))
            lines = _lines(seed, projections, dim)
            at = lines[:, :dim] @ small.T + lines[:, dim:] * lift
            order = np.argsort(at, axis=1, kind="stable")
            name, n = f"{part}-{n}", n + 1
            for what, values in (("ids", ids), ("vectors", table), ("order", order), ("sorted", np.take_along_axis(at, order, 1))):
                shared.write_array(f"{folder}/{name}-{what}", values)
            return pa.RecordBatch.from_pydict({"block": [name], "dim": [dim], "top_peak": [shape[1]], "top_factor": [shape[2]],
                                               "rows": [len(ids)], "queries": [int((ids % every == 0).sum())]}, schema=BLOCKS)

        def size(shape):
            return sum(len(i) for i, _ in held[shape])
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(at, BLOCK_ROWS)
                ids, dims, peaks, factors = (piece.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3, 4))
                for dim in np.unique(dims):
                    mine = np.flatnonzero(dims == dim)
                    shape = (int(dim), float(peaks[mine[0]]), float(factors[mine[0]]))
                    table = piece.column(1).take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    held.setdefault(shape, []).append((ids[mine], table))
                    if size(shape) >= BLOCK_ROWS:
                        yield block(shape)
                if sum(map(size, held)) >= 4 * BLOCK_ROWS:  # many lengths
                    yield from map(block, list(held))
        yield from map(block, list(held))

    shaped = rows.join(shapes, "dim").select("id", "v", "dim", "top_peak", "top_factor")
    blocks = checkpointed(shaped.mapInArrow(index, "block string, dim int, top_peak double, top_factor double, rows long, queries long"), "blocks")
    names = {}  # one row per 4096 vectors
    for r in blocks.select("dim", "block", "rows").orderBy("block").collect():
        names.setdefault(r["dim"], []).append((r["block"], r["rows"]))
    pieces = blocks.where("queries > 0").select("block", "dim", "top_peak", "top_factor", F.explode(
        F.sequence(F.lit(0), (F.col("queries") - 1).cast("int"), F.lit(PIECE))).alias("at"))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own, dim, peak, factor, at in zip(*(batch[c] for c in ("block", "dim", "top_peak", "top_factor", "at"))):
                ids, table = _block(folder, own, dim)
                mine = np.flatnonzero(ids % every == 0)[at:at + PIECE]
                yield _piece(folder, names[dim], own, mine, ids[mine], np.array(table[mine]), _lines(seed, projections, dim),
                             peak, factor, need, reach, k).rename(columns={"id": id_col})

    return (pieces.repartition(max(64, spark.sparkContext.defaultParallelism * 4), "block", "at")
            .mapInPandas(found, f"query_id long, rank int, {id_col} long, score double"))


def _lines(seed: int, projections: int, dim: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((projections, dim + 1))


def _block(folder: str, name: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return shared.read_array(f"{folder}/{name}-ids", np.int64), shared.read_array(f"{folder}/{name}-vectors", np.float64).reshape(-1, dim)


def _piece(folder, names, own, mine, query_ids, queries, lines, peak, factor, need, reach, k) -> pd.DataFrame:
    """The k nearest of some queries, which are rows `mine` of block `own`. `peak` * `factor` is the largest norm."""
    dim, m = queries.shape[1], len(lines)
    peaks = np.abs(queries).max(1)
    units = queries / peaks[:, None]
    norms = np.sqrt((units ** 2).sum(1))
    units /= norms[:, None]
    centres = units @ lines[:, :dim].T
    with np.errstate(over="ignore", under="ignore", divide="ignore"):
        scale = 1 / (peaks * norms * peak * factor)  # from scores to products of the scaled vectors
    usual = (scale > 1e-280) & (scale < 1e280)
    best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0)) for _ in mine]
    for name, n in sorted(names, key=lambda x: x[0] != own):
        ids, table = map(np.asarray, _block(folder, name, dim))
        order = np.asarray(shared.read_array(f"{folder}/{name}-order", np.int64)).reshape(m, n)
        at = np.asarray(shared.read_array(f"{folder}/{name}-sorted", np.float64)).reshape(m, n)
        counts, seen = np.zeros((len(mine), n), dtype=np.int64), np.zeros((len(mine), n), dtype=bool)
        if name == own:
            seen[np.arange(len(mine)), mine] = True
        widths = np.zeros(len(mine))
        lo = hi = np.stack([np.searchsorted(a, c) for a, c in zip(at, centres.T)])
        while True:
            far = np.array([np.sqrt(max(0.0, 2 - 2 * near.min())) if len(near) == k else np.inf for _, _, near in best])
            want = np.maximum(far * reach, 1e-6)
            active = np.flatnonzero((widths < want) & ~seen.all(1))
            if not len(active):
                break
            widths[active] = np.minimum(want, np.maximum(widths * WIDEN, 0.8))[active]
            new_lo = np.stack([np.searchsorted(a, c - widths, "left") for a, c in zip(at, centres.T)])
            new_hi = np.stack([np.searchsorted(a, c + widths, "right") for a, c in zip(at, centres.T)])
            for q in active:
                added = [order[j, a:b] for j, (x, y, z, w) in enumerate(zip(new_lo[:, q].tolist(), lo[:, q].tolist(), hi[:, q].tolist(), new_hi[:, q].tolist()))
                         for a, b in ((x, y), (z, w)) if a < b]
                if added:
                    counts[q] += np.bincount(np.concatenate(added), minlength=n)
                fresh = np.flatnonzero((counts[q] >= need) & ~seen[q])
                if len(fresh):
                    seen[q, fresh] = True
                    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
                        scores = table[fresh] @ queries[q]
                        near = scores * scale[q] if usual[q] else (table[fresh] / peak / factor) @ units[q]
                    best[q] = _top(*(np.concatenate(two) for two in zip(best[q], (scores, ids[fresh], near))), k)
            lo, hi = new_lo, new_hi
    return pd.DataFrame({"query_id": np.repeat(query_ids, [len(s) for s, _, _ in best]), "rank": np.concatenate([np.arange(1, len(s) + 1) for s, _, _ in best]).astype(np.int32),
                         "id": np.concatenate([i for _, i, _ in best]), "score": np.concatenate([s for s, _, _ in best])})


def _top(scores: np.ndarray, ids: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest scores, ties to the smaller id, what is not a number last."""
    key = np.where(np.isnan(scores), -np.inf, scores)
    if len(scores) > 4 * k:
        some = np.flatnonzero(key >= np.partition(key, -k)[-k])
        scores, ids, near, key = scores[some], ids[some], near[some], key[some]
    first = np.lexsort((ids, -key))[:k]
    return scores[first], ids[first], near[first]


def op10_nearest(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
