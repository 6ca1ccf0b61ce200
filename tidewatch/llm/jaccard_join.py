"""Exact Jaccard self-join of shingle sets with adaptive multi-match prefixes, down to linked components.

- Texts with equal sets are one node, known by a 128-bit fingerprint.
- The shingles of a set are ordered by estimated document frequency, rarest first, then hash. The estimates
  come from a count-min sketch over all texts; any fixed order gives right results, this one makes prefixes rare.
- A set of n shingles that must share at least `need` of them with a partner shares l or more within the first
  n - need + l. Each document lengthens its prefix (l = 1, 2, ...) while the estimated cost, postings read
  plus verifications they can lead to, falls; a pair then needs as many common prefix shingles as the smaller l of
  the two before it is verified. The join finds pairs by the first common one, which stands within n - need + 1.
  Shingles estimated to occur once have no partner and are not emitted.
- Near copies would meet in all pairs. So before the join, while the lists hold many pairs, each node is verified against one node
  of its posting lists, the one that looks nearest to all; lists whose nodes are already in one component are done. The join then
  emits only pairs of different components that pass the size, position and count filters, and verifies all.
- Verification intersects the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidewatch.llm import countmin, graph, words
from tidewatch.sources.storage import checkpointed, remove_folder

#: Longest l tried, and what verifying costs per shingle of a set, in postings read.
LONGEST, VERIFY_COST = 4, 0.1
#: Pairs an entry of the posting lists may stand for on average when all are joined; while there are more, stars are linked first.
PAIRS_AN_ENTRY = 4
#: Keys of rows to drop that may be broadcast (24 bytes each); beyond that the join is shuffled.
BROADCAST_ROWS = 1_000_000


def _distinct(part: words.Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, rows = part.shingles(k)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], rows[new]


def _sums(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    return (total[starts + counts] - total[starts]).view(np.int64)


def _fingerprint(hashes, starts, counts):
    """128 bits of each set, whatever its order."""
    return (_sums(words.mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)), starts, counts),
            _sums(words.mix(hashes ^ np.uint64(0x9FB21C651E98DF25)), starts, counts))


def shingle_sets(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """id, n_shingles and fingerprint (fa, fb) of each row's set of k-word shingles, with `carry` also the row as struct `row`."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(texts(batch), "_text"):
                hashes, rows = _distinct(part, k)
                counts = np.bincount(rows, minlength=part.rows)
                fa, fb = _fingerprint(hashes, np.cumsum(counts) - counts, counts)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(part.first, part.rows) for c in kept),
                                                  pa.array(counts.astype(np.int64)), pa.array(fa), pa.array(fb)],
                                                 names=[*kept, "n_shingles", "fa", "fb"])

    taken, texts = words.carried(docs, text_col, carry)
    kept = ["id", "row"] if carry else ["id"]
    some = docs.select(F.col(id_col).alias("id"), *taken)
    return some.mapInArrow(sets, T.StructType([*some.select(*kept).schema.fields, *(T.StructField(c, T.LongType()) for c in ("n_shingles", "fa", "fb"))]))


def _prefixes(docs: DataFrame, k: int, percent: int, text_col: str, sketch: countmin.Sketch) -> DataFrame:
    """The sets with a prefix shingle that may have a partner: fingerprint, n, l, prefix (hash, position), set."""
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, text_col):
                hashes, rows = _distinct(part, k)
                if not len(rows):
                    continue
                often = sketch.estimate(hashes).astype(np.int64)
                order = np.lexsort((hashes, often, rows))
                often, ranked = often[order], hashes[order]
                counts = np.bincount(rows, minlength=part.rows)
                starts = np.cumsum(counts) - counts
                need = (percent * counts + 99) // 100
                spare = np.concatenate([[0], np.cumsum(often - 1)])
                best, cost = np.ones(part.rows, dtype=np.int64), np.full(part.rows, np.inf)
                for l in range(1, LONGEST + 1):
                    reach = np.minimum(counts, counts - need + l)
                    postings = spare[starts + reach] - spare[starts]
                    now = np.where(l <= np.maximum(need, 1), postings * (1 + VERIFY_COST * counts / l), np.inf)
                    best, cost = np.where(now < cost, l, best), np.minimum(now, cost)
                place = np.arange(len(rows)) - starts[rows]
                keep = np.flatnonzero((place < (counts - need + best)[rows]) & (often > 1))
                kept = np.bincount(rows[keep], minlength=part.rows)
                some = np.flatnonzero(kept)
                if not len(some):
                    continue
                fa, fb = _fingerprint(hashes, starts, counts)
                inside = np.isin(rows, some)
                lists = lambda n, v: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[some])]).astype(np.int32)), pa.array(v))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fa[some]), pa.array(fb[some]), pa.array(counts[some].astype(np.int32)), pa.array(best[some].astype(np.int32)),
                     lists(kept, ranked[keep].view(np.int64)), lists(kept, place[keep].astype(np.int32)),
                     lists(counts, hashes[inside].view(np.int64))], names=["fa", "fb", "n", "l", "tokens", "places", "shingles"])

    return docs.select(text_col).mapInArrow(
        prefixes, "fa long, fb long, n int, l int, tokens array<long>, places array<int>, shingles array<long>")


def _joined(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Pairs of entries under one token that can be the first common one of a link: a and b.

    The first common token of two sets leaves at most the shorter rest to share, besides itself.
    """
    both = left.select("token", *[F.col(c).alias(f"a_{c}") for c in left.columns if c != "token"]).join(
        right.select("token", *[F.col(c).alias(f"b_{c}") for c in right.columns if c != "token"]), "token")
    reach = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"))
    return both.where((F.col("a_label") != F.col("b_label"))
                      & (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
                      & ((100 + percent) * reach >= percent * (F.col("a_n") + F.col("b_n"))))


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs with enough common tokens in the prefixes of the smaller l, and then enough common shingles."""
    side = lambda x: nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "l", "tokens", "places", "shingles")])
    l = F.least("a_l", "b_l")

    def prefix(x):
        size = F.col(f"{x}_n") - F.ceil(F.col(f"{x}_n") * percent / 100) + l
        return F.slice(F.col(f"{x}_tokens"), 1, F.size(F.filter(f"{x}_places", lambda p: p < size)))
    return (pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
            .where(F.size(F.array_intersect(prefix("a"), prefix("b"))) >= l)
            .where((100 + percent) * F.size(F.array_intersect("a_shingles", "b_shingles")) >= percent * (F.col("a_n") + F.col("b_n")))
            .select("a", "b"))


def _labelled(entries: DataFrame, labels: DataFrame) -> DataFrame:
    return (entries.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                    rounds: int = 2) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id; further fa and fb (the set's fingerprint) and `first`, true for the
    rows of the component's smallest id that have its first set.

    Sets of distinct k-word shingles over lower-cased (A-Z) words `[^\\x20\\x09-\\x0D]+`; fewer words are one
    shingle. Two rows link when 100 * intersection >= percent * union, so rows of equal sets do;
    component_id is the smallest id reachable by links. A text without words (null, empty, blank) has
    no shingles and is linked with nothing. Repeated ids and rows keep their rows; null ids take part, but never
    are a component's id unless all its ids are null. Other columns are ignored.
    """
    spark = docs.sparkSession

    def distinct_shingles(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in words.slices(batch, text_col):
            yield _distinct(part, k)[0]

    info = checkpointed(shingle_sets(docs, k, id_col, text_col), "sets")
    bits = countmin.width_bits(docs, text_col)
    sketch = countmin.build(docs.select(text_col), distinct_shingles, bits, levels=255)
    nodes = checkpointed(_prefixes(docs, k, percent, text_col, sketch).dropDuplicates(["fa", "fb"])
                         .withColumn("node", F.monotonically_increasing_id()), "nodes")
    remove_folder(spark, sketch.folder)
    entries = nodes.select("node", "n", F.explode(F.arrays_zip("tokens", "places")).alias("e")).select(
        "node", "n", F.col("e.tokens").alias("token"), F.col("e.places").alias("place"))
    entries = entries.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100))  # the first common one is there
    shared = entries.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    entries = checkpointed(entries.join(shared, "token", "left_semi"), "entries")

    links, labels, open_ = None, None, entries.withColumn("label", F.col("node"))
    for left in range(rounds, -1, -1):
        most = checkpointed(open_.groupBy("token", "label").agg(F.count("*").alias("c")).groupBy("token")
                            .agg(F.max_by("label", F.struct("c", "label")).alias("most"), (F.sum("c").cast("double") * (F.sum("c") - F.max("c"))).alias("pairs")), "most")
        size = most.agg(F.sum("pairs")).first()[0] or 0
        if not left or size <= PAIRS_AN_ENTRY * entries.count():
            break
        centres = open_.groupBy("token").agg(F.min_by(F.struct("node", "n", "place", "label"), F.struct("place", "node")).alias("r")).select("token", "r.*")
        pairs = (_joined(open_, centres, percent).groupBy("a_node", "b_node").agg(F.count("*").alias("c"))
                 .groupBy(F.col("a_node").alias("a")).agg(F.max_by("b_node", F.struct("c", "b_node")).alias("b")))
        found = checkpointed(_verified(pairs, nodes, percent), "links")
        links = found if links is None else links.unionByName(found)
        labels = graph.components(links)
        open_ = checkpointed(_open(_labelled(entries, labels)), "open")

    rest = open_.join(most.select("token", "most"), "token").where("label <> most")  # every pair of two labels has a row outside the largest
    pairs = (_joined(rest, open_, percent).where("b_label = a_most OR a_node < b_node")
             .select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct())
    found = checkpointed(_verified(pairs, nodes, percent), "links")
    if links is None or not found.isEmpty():
        labels = graph.components(found if links is None else links.unionByName(found))

    smallest = info.groupBy("fa", "fb").agg(F.min("id").alias("least"))
    labelled = (smallest.join(nodes.select("fa", "fb", "node"), ["fa", "fb"]).join(labels, "node")
                .select("fa", "fb", "label", "least"))
    rank = F.struct(F.col("least").isNull(), "least", "fa", "fb")
    whole = labelled.groupBy("label").agg(F.min_by(F.struct("least", "fa", "fb"), rank).alias("top"))
    classes = smallest.join(labelled.join(whole, "label").select("fa", "fb", "top"), ["fa", "fb"], "left")
    classes = classes.select("fa", "fb", F.coalesce("top", F.struct("least", "fa", "fb")).alias("top"))
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("id")).otherwise(F.col("top.least"))
    first = alone | ((F.col("top.fa") == F.col("fa")) & (F.col("top.fb") == F.col("fb")) & F.col("id").eqNullSafe(F.col("top.least")))
    return (info.join(classes, ["fa", "fb"])
            .select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), "fa", "fb", first.alias("first")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without near duplicates: of each component the row of the smallest id, of equal such rows one.

    Rows without words are linked with nothing and all stay. Only the keys of the rows to drop meet the texts: the id of a
    single row; only where an id has several rows its rows are told apart by their sets, which takes them to Python.
    """
    near = near_duplicates(docs, k, percent, id_col, text_col).select(F.col(id_col).alias("_id"), "n_shingles", "fa", "fb", "first")
    ids = checkpointed(near.groupBy("_id").agg(F.count("*").alias("c"), F.every("first").alias("stays"), F.max("n_shingles").alias("n"))
                       .where("NOT stays OR (c > 1 AND n > 0)").select("_id", "c"), "dropped")
    small = lambda keys: F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    kept = docs.join(small(ids), docs[f"`{id_col}`"].eqNullSafe(ids["_id"]), "left_anti")
    several = ids.where("c > 1").select("_id")
    if several.isEmpty():
        return kept
    same_id = F.col("id").eqNullSafe(F.col("_id"))
    found = checkpointed(near.withColumnRenamed("_id", "id").join(several, same_id, "left_semi").where("n_shingles > 0")
                         .groupBy(F.col("id").alias("_id"), F.col("fa").alias("_fa"), F.col("fb").alias("_fb"))
                         .agg(F.first("first").alias("first"), F.count("*").alias("c")).where("NOT first OR c > 1"), "dropped")
    rows = shingle_sets(docs.join(small(several), docs[f"`{id_col}`"].eqNullSafe(several["_id"]), "left_semi"), k, id_col, text_col, carry=True)
    same = same_id & (F.col("fa") == F.col("_fa")) & (F.col("fb") == F.col("_fb"))
    kept = kept.unionByName(rows.join(small(found), same, "left_anti").select("row.*"))
    equal = found.where("first")
    if equal.isEmpty():
        return kept
    ones = rows.join(small(equal), same, "left_semi").dropDuplicates(["id", "fa", "fb"])
    return kept.unionByName(ones.select("row.*"))


def _open(entries: DataFrame) -> DataFrame:
    """The entries of tokens under which nodes of different labels meet."""
    some = entries.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    return entries.join(some, "token", "left_semi")


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")
