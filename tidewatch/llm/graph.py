"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.sources.storage import checkpointed

#: Links a task reduces to a forest at once; tasks grow with the links.
LINKS_A_TASK = 1 << 16


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that reach a smaller one by these links, and the smallest each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[:len(a)], at[len(a):], np.arange(len(nodes))
    while (label[a] != label[b]).any():
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))  # the larger root hangs on the smaller one
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _reduced(links: DataFrame) -> DataFrame:
    """Links (a, b), b the smaller one, that connect the same nodes: of every LINKS_A_TASK a forest of stars."""
    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def forest() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _forest(*map(np.concatenate, zip(*held)))], names=["a", "b"])
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("a", "b")])
            n += batch.num_rows
            if n >= LINKS_A_TASK:
                yield forest()
                held, n = [], 0
        if n:
            yield forest()

    tasks = -(-links.count() // LINKS_A_TASK)
    return checkpointed(links.select("a", "b").coalesce(max(1, tasks)).mapInArrow(forests, "a long, b long"), "edges")


def components(links: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable from node; only nodes of `links` (a, b) with another end.

    Every task first reduces its links to stars, so few are left where they are few. What hangs together over several
    tasks is found by alternating large and small stars: every round hangs each node's neighbours on its smallest one, so
    the depth shrinks by powers. Each round is a few aggregations and equi-joins and is written out; a
    node with very many neighbours meets one row in the join, which Spark can split.
    """
    edges = _reduced(links)
    while True:
        # stars: each node has one label, and no centre hangs on another
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")))
        labels = checkpointed(ends.groupBy("node").agg(F.min("label").alias("label"), F.max("label").alias("most")), "labels")
        if labels.where("label <> most").isEmpty():
            return labels.select("node", "label")
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # `large` only has edges to smaller nodes
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(down.select("a", F.col("m").alias("b"))).distinct())
        edges = _reduced(checkpointed(small, "edges"))
