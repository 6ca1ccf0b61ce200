"""What can be reached from where in a graph, as bitmaps.

Nodes get 64-bit numbers in the order of their names, so related nodes mostly lie close together. The set of nodes that a node
reaches is kept as rows (node, word, mask): bit b of the mask says that node word * 64 + b is reached. Sets are
merged by `bit_or`, which Spark combines before it shuffles, and counted by `bit_count`: counts never need the pairs.
"""

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.sources.storage import checkpointed

BITS = 64


def word_of(number: Column) -> Column:
    return F.shiftright(number, 6)


def bit_of(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), number.bitwiseAND(63).cast("int"))


def numbered(names: DataFrame) -> DataFrame:
    """(uid, number) of the distinct uids; shorter names first, so that running numbers in names keep their order."""
    spread = names.select("uid").distinct().repartitionByRange(F.length("uid"), "uid").sortWithinPartitions(F.length("uid"), "uid")
    return checkpointed(spread.withColumn("number", F.monotonically_increasing_id()), "numbers")


def renumbered(numbers: DataFrame, names: DataFrame) -> DataFrame:
    """`numbers` and further ones for the uids that have none yet; those given stay."""
    last = numbers.agg(F.max("number")).first()[0]
    fresh = numbered(names.select("uid").distinct().join(numbers, "uid", "left_anti"))
    start = 0 if last is None else (last // BITS + 1) * BITS
    return numbers.unionByName(fresh.select("uid", (F.col("number") + start).alias("number")))


def _below(starts: DataFrame, step: DataFrame, hops: int) -> DataFrame:
    """The edges that lie behind any of the starts (number): what other nodes reach is not asked for."""
    seen = frontier = checkpointed(starts.select("number").distinct(), "seen")
    while True:
        layer = frontier
        found = None
        for _ in range(hops):
            layer = layer.join(step, F.col("number") == F.col("parent"), "inner").select(F.col("child").alias("number")).distinct()
            found = layer if found is None else found.unionByName(layer)
        frontier = checkpointed(found.distinct().join(seen, "number", "left_anti"), "seen")
        if frontier.isEmpty():
            return step.join(seen, F.col("parent") == F.col("number"), "left_semi")
        seen = seen.unionByName(frontier)


def closure(edges: DataFrame, starts: DataFrame | None = None, hops: int = 4) -> DataFrame:
    """(node, word, mask): what each node reaches by one edge or more, of the graph of edges (parent, child) between numbers.

    A node's set grows by the sets of its children. A round takes what is new `hops` edges up and is written once; bits known
    before are taken out, hence cycles end, and a node on a cycle reaches itself. With `starts` (number), only sets
    of nodes that lie on ways from them are found.
    """
    step = checkpointed(edges.select("parent", "child").distinct(), "steps")
    if starts is not None and not step.join(starts, F.col("parent") == F.col("number"), "left_anti").isEmpty():
        step = checkpointed(_below(starts, step, hops), "steps")
    return _grow(step, _children(step), hops)


def _children(step: DataFrame) -> DataFrame:
    return (step.groupBy(F.col("parent").alias("node"), word_of(F.col("child")).alias("word"))
            .agg(F.bit_or(bit_of(F.col("child"))).alias("mask")))


def _grow(step: DataFrame, own: DataFrame, hops: int) -> DataFrame:
    """Sets that hold `own` and all sets of the nodes that edges of `step` lead to."""
    known = frontier = checkpointed(own, "reached")
    while True:
        layer, layers = frontier.select("node", "word", "mask"), None
        for hop in range(1, hops + 1):
            layer = (layer.join(step, F.col("node") == F.col("child")).groupBy(F.col("parent").alias("node"), "word")
                     .agg(F.bit_or("mask").alias("mask")))
            here = layer.withColumn("last", F.col("mask") if hop == hops else F.lit(0).cast("bigint"))
            layers = here if layers is None else layers.unionByName(here)
        merged = known.groupBy("node", "word").agg(F.bit_or("mask").alias("had"))
        grown = layers.groupBy("node", "word").agg(F.bit_or("mask").alias("mask"), F.bit_or("last").alias("last"))
        open_ = F.bitwise_not(F.coalesce("had", F.lit(0).cast("bigint")))
        fresh = checkpointed(grown.join(merged, ["node", "word"], "left").select(
            "node", "word", F.col("mask").bitwiseAND(open_).alias("mask"), F.col("last").bitwiseAND(open_).alias("last"))
            .filter("mask <> 0"), "reached")
        known = known.select("node", "word", "mask").unionByName(fresh.select("node", "word", "mask"))
        frontier = fresh.filter("last <> 0").select("node", "word", F.col("last").alias("mask"))
        if frontier.isEmpty():
            return known.groupBy("node", "word").agg(F.bit_or("mask").alias("mask"))


def updated(words: DataFrame, before: DataFrame, edges: DataFrame, hops: int = 4) -> DataFrame:
    """The closure of `edges`, from that of the edges `before` (all by the same numbers).

    Only nodes that reach a parent of an added or removed edge can change. Their sets are found anew, from their children and the
    sets of children that don't change; all other sets stay. So the work follows the change, not the graph.
    """
    pair = ["parent", "child"]
    roots = edges.join(before, pair, "left_anti").select("parent").unionByName(before.join(edges, pair, "left_anti").select("parent"))
    roots = checkpointed(roots.select(F.col("parent").alias("number")).distinct(), "changed")
    asked = marks(roots, {"asked": F.lit(True)})
    above = words.join(asked, "word").filter(F.col("mask").bitwiseAND(F.col("asked")) != 0).select(F.col("node").alias("number"))
    affected = checkpointed(roots.unionByName(above).distinct(), "affected")
    inner = checkpointed(edges.join(affected.withColumnRenamed("number", "parent"), "parent", "left_semi"), "steps")
    child = affected.select(F.col("number").alias("child"))
    settled = inner.join(child, "child", "left_anti").join(words, F.col("child") == F.col("node")).select(
        F.col("parent").alias("node"), "word", "mask")
    own = _children(inner).unionByName(settled).groupBy("node", "word").agg(F.bit_or("mask").alias("mask"))
    grown = _grow(inner.join(child, "child", "left_semi"), own, hops)
    return words.join(affected.withColumnRenamed("number", "node"), "node", "left_anti").unionByName(grown)


def members(words: DataFrame) -> DataFrame:
    """(node, reached): the sets as pairs of numbers."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.getbit(F.col("mask"), b) == 1)
    return words.select("node", F.explode(F.transform(bits, lambda b: F.col("word") * BITS + b)).alias("reached"))


def marks(numbers: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """(word, kind...): for each kind the mask of the numbers that are of it."""
    return numbers.groupBy(word_of(F.col("number")).alias("word")).agg(*[
        F.bit_or(F.when(is_kind, bit_of(F.col("number"))).otherwise(F.lit(0).cast("bigint"))).alias(kind) for kind, is_kind in kinds.items()])


def counts(words: DataFrame, marked: DataFrame) -> DataFrame:
    """(node, kind...): how many numbers of each kind a node reaches."""
    kinds = [c for c in marked.columns if c != "word"]
    return words.join(marked, "word").groupBy("node").agg(*[
        F.sum(F.bit_count(F.col("mask").bitwiseAND(F.col(kind)))).cast("bigint").alias(kind) for kind in kinds])
