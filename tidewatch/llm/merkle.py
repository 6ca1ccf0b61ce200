"""Merkle manifest of a dataset by time-forward processing: digests go up, proofs come back down.

Leaves are rows, a tree holds the leaves of one source, and the roots of all sources are the leaves of one more tree. Every
FAN consecutive nodes of a level have one parent. A node's label is (tree, level, place), so a child's label is smaller
than its parent's.

Forward sweep: nodes are taken in the order of their labels. Each sends its digest to its parent's label through a priority
queue; a label that comes up finds the digests of all its children at the head of the queue. Backward sweep: labels come
up in reverse order and send each child the siblings on its way to the root.

The queue is external in two steps. A block of FAN ** LEVELS neighbours is swept inside a task, where the queue holds at most a
block's messages; messages that leave a block are rows of a table that Spark partitions, sorts by label and spills. So a
round takes LEVELS levels, each round has FAN ** LEVELS times fewer nodes than the one before, and no task sees more
than a block of a tree at once, however many leaves one source has. Proofs are delivered to runs of FAN leaves, as these
share all but their own siblings.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.llm.native import lower_ascii
from tidewatch.sources.storage import checkpointed

#: Children of a node at most, and the levels that one round sweeps.
FAN, LEVELS = 16, 2

_PATH = "array<struct<left:string,right:string>>"
_ARROW_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_TOP = 1 << 20  # a level above all others


def field(column: Column) -> Column:
    """`-` for NULL, else the UTF-8 byte count, `:` and the value."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- places ---------------------------------------------------------------------

def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds `place`, from 0 in each `tree` by `order`, and `n`, the rows of the tree. `tree` must not be NULL.

    One range sort; places are counted inside its partitions, and (tree, partition) sums carry them on.
    """
    spread = (rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
              .withColumn("_at", F.monotonically_increasing_id()))
    spread = checkpointed(spread.withColumn("_part", F.shiftrightunsigned("_at", 33)), "placed")
    parts = spread.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_c"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).withColumn("n", F.sum("_c").over(whole))
    return (spread.join(parts.drop("_c"), ["tree", "_part"])
            .withColumn("place", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before"))


# ---- sweeps ---------------------------------------------------------------------

def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of a sorted partition, those of one (tree, block) at a time: at most a block."""
    key, held = None, []
    for batch in batches:
        for tree, block, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if (tree, block) != key:
                if held:
                    yield key, held
                key, held = (tree, block), []
            held.append(rest)
    if held:
        yield key, held


def _forward(nodes: DataFrame, level: int) -> DataFrame:
    """One round: (tree, block, level, place, digests, digest, top) of all nodes above `nodes` (tree, place, digest, n), up to LEVELS levels."""
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (tree, block), rows in _groups(batches):
            queue = [((level + 1, place // FAN), place, own) for place, own, _ in rows]
            heapq.heapify(queue)
            last = level + (LEVELS if rows[0][2] > FAN ** (LEVELS - 1) else next(k for k in range(1, LEVELS + 1) if FAN ** k >= rows[0][2]))
            while queue:
                label, digests = queue[0][0], []
                while queue and queue[0][0] == label:
                    digests.append(heapq.heappop(queue)[2])
                own = _hash(digests)
                out.append((tree, block, *label, digests, own, label[0] == last))
                if label[0] < last:
                    heapq.heappush(queue, ((label[0] + 1, label[1] // FAN), label[1], own))
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist([dict(zip(names.names, r)) for r in out], schema=names)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names.names, r)) for r in out], schema=names)

    names = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("level", pa.int32()), ("place", pa.int64()),
                       ("digests", pa.list_(pa.string())), ("digest", pa.string()), ("top", pa.bool_())])
    return (nodes.where("n > 1").select("tree", F.expr(f"place div {FAN ** LEVELS}").alias("block"), "place", "digest", "n")
            .repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
            .mapInArrow(sweep, "tree string, block long, level int, place long, digests array<string>, digest string, top boolean"))


def _backward(records: DataFrame, paths: DataFrame, level: int) -> DataFrame:
    """Turns a round round: from the paths (tree, place, path) of its top nodes those of the nodes it began with, or, if
    these are leaves, (tree, place, digests, path) of their runs: the place, children and path of the leaves' parents."""
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (tree, block), rows in _groups(batches):
            queue = []
            for (at, place, digests, path) in rows:  # labels in descending order
                if at == _TOP:
                    top = path
                    continue
                if not queue:  # the block's top node comes first
                    heapq.heappush(queue, ((-at, -place), top))
                label, path = heapq.heappop(queue)
                assert label == (-at, -place), "labels of a block must come in order"
                if at == 1:
                    out.append((tree, place, digests, path))
                    continue
                for k in range(len(digests)):
                    child = [{"left": "".join(digests[:k]), "right": "".join(digests[k + 1:])}, *path]
                    if at - 1 > level:
                        heapq.heappush(queue, ((1 - at, -(place * FAN + k)), child))
                    else:
                        out.append((tree, place * FAN + k, None, child))
            if len(out) >= 500:
                yield pa.RecordBatch.from_pylist([dict(zip(names.names, r)) for r in out], schema=names)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names.names, r)) for r in out], schema=names)

    names = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("digests", pa.list_(pa.string())), ("path", _ARROW_PATH)])
    from_top = paths.select("tree", F.col("place").alias("block"), F.lit(_TOP).alias("level"), "place",
                            F.lit(None).cast("array<string>").alias("digests"), "path")
    return (records.select("tree", "block", "level", "place", "digests", F.lit(None).cast(_PATH).alias("path")).unionByName(from_top)
            .repartition("tree", "block").sortWithinPartitions("tree", "block", F.desc("level"), F.desc("place"))
            .mapInArrow(sweep, f"tree string, place long, digests array<string>, path {_PATH}"))


def sweep_up(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """From leaves (tree, place, digest, n): (tree, digest, round) of each tree's root, and the stored records of each round."""
    roots, rounds, step = None, [], FAN ** LEVELS
    largest = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        done = nodes.where("n = 1").select("tree", "digest", F.lit(len(rounds)).alias("round"))
        roots = done if roots is None else roots.unionByName(done)
        if largest <= 1:
            return roots, rounds
        rounds.append(checkpointed(_forward(nodes, LEVELS * len(rounds)), "records"))
        sizes = nodes.where("place = 0 AND n > 1").select("tree", F.expr(f"(n + {step - 1}) div {step}").alias("n"))
        nodes = rounds[-1].where("top").select("tree", "place", "digest").join(sizes, "tree")
        largest = -(-largest // step)


def sweep_down(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """From (tree, round, path) of each tree's root: (tree, place, digests, path) of every run of leaves; a tree of one leaf
    has one row without digests, whose path is the leaf's own."""
    def entering(r: int) -> DataFrame:
        return tops.where(F.col("round") == r).select("tree", F.lit(0).cast("long").alias("place"), F.lit(None).cast("array<string>").alias("digests"), "path")

    paths = entering(len(rounds))
    for r in reversed(range(len(rounds))):
        paths = checkpointed(_backward(rounds[r], paths, LEVELS * r), "paths").unionByName(entering(r))
    return paths


def manifest(docs: DataFrame, columns: list[str], tree_col: str = "source", id_col: str = "doc_id",
             tampered: dict[str, Column] | None = None, tampered_if: Column | None = None) -> DataFrame:
    """One row per row of `docs`: id, leaf, subroot, root, path (the siblings left and right of the row's node, level by level from
    the leaf via its tree's root to the root) and folded_root, what these give with the leaf as it is now.

    A leaf is the SHA-256 of `columns`, each written as `field` does. Trees are the values of `tree_col`, NULL one of them and the
    first, the others in bytewise order; leaves stand by id, NULL first, rows of equal id by their digests, so repeated rows are
    leaves each. A single leaf is its tree's root, a single tree's root the root; an empty table gives no rows. Where
    `tampered_if` holds, `folded_root` comes from the row with the `tampered` columns put in place of its own. Other columns are
    ignored, whatever their names. Texts are hashed whole by Spark; sweeps only see digests.
    """
    own = {c: F.col(f"`{c}`") for c in columns}
    changed = digest([(tampered or {}).get(c, own[c]) for c in columns])
    leaves = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.concat(F.lit("s"), F.col(f"`{tree_col}`").cast("string")), F.lit("")).alias("tree"),
        digest(list(own.values())).alias("digest"),
        (F.when(tampered_if, changed) if tampered_if is not None else F.lit(None).cast("string")).alias("changed"))
    leaves = checkpointed(placed(leaves, ["id", "digest"]), "leaves")
    subroots, rounds = sweep_up(leaves.select("tree", "place", "digest", "n"))
    subroots = checkpointed(subroots, "subroots")
    trees = checkpointed(placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("member"), "digest"), ["member"]), "trees")
    top, outer = sweep_up(trees)
    top = checkpointed(top, "root")
    root = top.select("digest").first()  # one row
    tops = _paths(trees, sweep_down(outer, top.select("tree", "round", F.array().cast(_PATH).alias("path"))))
    tops = checkpointed(tops.select(F.col("member").alias("tree"), "path").join(subroots.select("tree", "round"), "tree"), "tops")
    found = _paths(leaves, sweep_down(rounds, tops)).join(subroots.select("tree", F.col("digest").alias("subroot")), "tree")
    folded = F.aggregate("path", F.coalesce("changed", "digest"), lambda now, s: F.sha2(F.concat(s["left"], now, s["right"]), 256))
    return found.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", F.lit(root[0] if root else None).cast("string").alias("root"),
                        "path", folded.alias("folded_root"))


def _paths(leaves: DataFrame, runs: DataFrame) -> DataFrame:
    """The leaves with their paths, from those of their runs."""
    at = F.col("place") % FAN
    own = F.struct(F.array_join(F.slice("digests", 1, at.cast("int")), "").alias("left"),
                   F.array_join(F.slice("digests", (at + 2).cast("int"), FAN), "").alias("right"))
    runs = runs.select("tree", F.col("place").alias("_run"), "digests", F.col("path").alias("_path"))
    return (leaves.withColumn("_run", F.expr(f"place div {FAN}")).join(runs, ["tree", "_run"])
            .withColumn("path", F.when(F.col("digests").isNull(), F.col("_path")).otherwise(F.concat(F.array(own), "_path")))
            .drop("_run", "_path", "digests"))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every fifth row by hash of its id has its text lower-cased after the manifest was made."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], tampered={"text": lower_ascii("text")},
                     tampered_if=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))


def _oracle(levels: int = 8, outer: int = 4) -> str:
    """Level by level, for up to 16 ** levels rows of a source and 16 ** outer sources."""
    fields = lambda text: " || ".join(
        f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    step = "CASE WHEN xor(a, x) & 1 = 1 THEN xor(xor(a, x) >> 1, 3988292384) ELSE xor(a, x) >> 1 END"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda a, x: {step}), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = [f"""WITH d AS (SELECT doc_id, coalesce('s' || source, '') AS t, sha256({fields('text')}) AS leaf,
  CASE WHEN {crc} % 5 = 0 THEN sha256({fields(lower)}) END AS changed FROM documents),
p0 AS (SELECT doc_id, t, leaf, coalesce(changed, leaf) AS fold, '' AS proof, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d),
n0 AS (SELECT t, place, leaf AS h, count(*) OVER (PARTITION BY t) AS n FROM p0)"""]

    def climb(p: str, n: str, count: int) -> None:
        keep = "doc_id, t, leaf" + (", subroot" if p == "q" else "")
        for k in range(count):
            sql.append(f"""
r{n}{k} AS (SELECT t, place // 16 AS run, list(h ORDER BY place) AS hs, max(n) AS n FROM {n}{k} GROUP BY ALL),
{n}{k + 1} AS (SELECT t, run AS place, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, (n + 15) // 16 AS n FROM r{n}{k}),
{p}{k + 1} AS (SELECT {keep.replace("t,", f"{p}{k}.t,")}, place // 16 AS place,
  CASE WHEN n = 1 THEN fold ELSE sha256(array_to_string(hs[1:place % 16], '') || fold || array_to_string(hs[place % 16 + 2:], '')) END AS fold,
  proof || CASE WHEN n = 1 THEN '' ELSE array_to_string(hs[1:place % 16], '') || array_to_string(hs[place % 16 + 2:], '') END AS proof
  FROM {p}{k} JOIN r{n}{k} ON {p}{k}.t = r{n}{k}.t AND place // 16 = run)""")

    climb("p", "n", levels)
    sql.append(f"""
s AS (SELECT t AS member, h, row_number() OVER (ORDER BY encode(t)) - 1 AS place, count(*) OVER () AS n FROM n{levels}),
m0 AS (SELECT '' AS t, place, h, n FROM s),
q0 AS (SELECT doc_id, '' AS t, leaf, s.h AS subroot, s.place, fold, proof FROM p{levels} JOIN s ON p{levels}.t = member)""")
    climb("q", "m", outer)
    return ",".join(sql) + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified FROM q{outer}, m{outer}"""


ORACLE = _oracle()
