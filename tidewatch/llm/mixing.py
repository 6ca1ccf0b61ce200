"""Mixes sources to target weights in equal-token blocks by Sainte-Laguë apportionment.

1. Targets: the sources share all words by weight; none gets more than `most` times its own words, and what it can't
   take is shared again by weight among the others until none is above.
2. Quotas: blocks of `block_words` words go to sources one after the other by the highest quotient target / (2 j - 1) for a
   source's j-th block. Every `shard_blocks` awards in this order make a shard, so each shard has integer quotas
   whose running totals stay close to the targets.
3. Blocks: a source's documents stand in seeded order on a line of words, passed over as often as its blocks need. Each shard
   has a stretch of the line, in proportion to its quota: in whole passes exactly its blocks, in the last, unfinished pass
   a longer stretch, from which it takes as many consecutive blocks as its quota asks for, beginning at a seeded
   block. Blocks that follow each other cut fewer documents than blocks drawn one by one. A document is taken as often
   as the shards' blocks cover its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.llm.native import let, n_words, running_sums, words
from tidewatch.sources.storage import checkpointed

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (1, 2, 3)
SEED = "mix"


def targets(sizes: DataFrame, most: int = 3, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size) to (source, source_size, rank, target): one row per source; a null source is one, the last."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * most)
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    big = lambda c: c.cast("decimal(19,0)")
    before = lambda c: F.coalesce(F.sum(c).over(fill), F.lit(0))
    filled = (ranked.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
              .withColumn("full", big(F.col("cap")) * big(F.col("all_w") - before("w")) <= big(F.col("w")) * big(F.col("total") - before("cap")))
              .withColumn("cap_full", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0)))
              .withColumn("w_full", F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(everything), F.lit(0))))
    share = (F.col("w") * (F.col("total") - F.col("cap_full"))).cast("double") / (F.col("all_w") - F.col("w_full"))
    return filled.select("source", "source_size", "rank", "total", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def awards(goals: DataFrame, block_words: int = 32, shard_blocks: int = 4096, most: int = 3) -> DataFrame:
    """(shard, rank, blocks): how many blocks each source has in each shard.

    The blocks are ranked by a range-partitioned sort and the row counts of its partitions, not in one task.
    """
    n = F.floor((2 * F.col("total") + block_words) / (2 * block_words))
    goals = goals.withColumn("n", n).withColumn("sources", F.count("*").over(Window.partitionBy()))
    enough = F.least(F.ceil(F.col("target") / block_words) + F.ceil(F.col("sources") / 2) + 1,
                     F.ceil(F.col("source_size") * most / block_words)).cast("long")
    seats = (goals.where("target > 0").select("rank", "n", "target", F.explode(F.sequence(F.lit(1).cast("long"), enough)).alias("j"))
             .select("rank", "n", (F.col("target") / (2 * F.col("j") - 1)).alias("quotient")))
    placed = checkpointed(seats.repartitionByRange(F.col("quotient").desc(), "rank").sortWithinPartitions(F.col("quotient").desc(), "rank")
                          .select("rank", "n", F.spark_partition_id().alias("part"),
                                  F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "awards")
    sizes = placed.groupBy("part").agg(F.count("*").alias("c"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    place = F.col("start") + F.col("at")
    return (placed.join(starts, "part").where(place < F.col("n"))
            .groupBy(F.floor(place / shard_blocks).alias("shard"), "rank").agg(F.count("*").alias("blocks")))


def runs(quotas: DataFrame, goals: DataFrame, block_words: int = 32, most: int = 3) -> DataFrame:
    """(rank, shard, lo, hi, last): the words of each source's line that a shard takes, as stretches [lo, hi).

    The line of a source is its words, repeated; `last` marks stretches of the unfinished pass. `quotas` as awards() gives them.
    """
    known = quotas.join(goals.select("rank", "source_size"), "rank")
    line = running_sums(known.withColumn("chunk", F.floor(F.col("shard") / 4096)), "rank", "chunk", ["shard"], "blocks", "before")
    total = quotas.groupBy("rank").agg(F.sum("blocks").alias("all_blocks"))
    cap = F.col("source_size") * most
    line = (line.join(total, "rank")
            .withColumn("lo_word", F.least(F.col("before") * block_words, cap))
            .withColumn("hi_word", F.least((F.col("before") + F.col("blocks")) * block_words, cap))
            .withColumn("words", F.least(F.col("all_blocks") * block_words, cap))
            .withColumn("part", F.expr("words % source_size")).withColumn("whole", F.expr("words - part"))
            .withColumn("rest", F.greatest("lo_word", "whole")))
    # the unfinished pass, of which `part` words are taken, is dealt to its shards whole
    dealt = "whole + CAST({0} - whole AS DECIMAL(19,0)) * CAST(source_size AS DECIMAL(19,0)) div greatest(part, 1)"
    line = (line.withColumn("pool", F.expr(dealt.format("rest")))
            .withColumn("slack", F.greatest(F.lit(0), F.expr(dealt.format("hi_word")) - F.col("pool") - (F.col("hi_word") - F.col("rest")))))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.col("rank").cast("string"), F.lit(":"), F.col("shard").cast("string"))), 1, 8), 16, 10).cast("long")
    start = F.col("pool") + block_words * (drawn % (F.floor(F.col("slack") / block_words) + 1))
    both = F.array(F.struct(F.col("lo_word").alias("lo"), F.least("hi_word", "whole").alias("hi"), F.lit(False).alias("last")),
                   F.struct(start.alias("lo"), (start + F.col("hi_word") - F.col("rest")).alias("hi"), F.lit(True).alias("last")))
    return line.select("rank", "shard", F.inline(both)).where("lo < hi")


def placements(line: DataFrame, stretches: DataFrame) -> DataFrame:
    """(uid, shard, last, first, n): for rows on their source's line the n words from the first-th on that a shard takes, per pass.

    `line` has uid, rank, start, size and source_size. Both sides are cut into cells of the line, a stretch on average,
    and meet in the one cell where the later of the two begins.
    """
    ends = stretches.groupBy("rank").agg(F.max("hi").alias("end"), F.count("*").alias("c"))
    cells = ends.select("rank", "end", F.greatest(F.lit(1), F.ceil(F.col("end") / F.col("c"))).cast("long").alias("cell"))
    copies = (line.where("size > 0").join(cells, "rank")
              .withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("end") - 1) / F.col("source_size")))))
              .withColumn("a", F.col("start") + F.col("pass") * F.col("source_size")).where("a < end")
              .select("uid", "rank", "cell", "a", (F.col("a") + F.col("size")).alias("b")))
    at = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / F.col("cell")), F.floor((F.col(hi) - 1) / F.col("cell")))).alias("nth")
    mine = copies.select("*", at("a", "b"))
    theirs = stretches.join(cells, "rank").select("rank", "shard", "lo", "hi", "last", at("lo", "hi"))
    return (mine.join(theirs, ["rank", "nth"]).where((F.col("a") < F.col("hi")) & (F.col("lo") < F.col("b"))
                                                     & (F.floor(F.greatest("a", "lo") / F.col("cell")) == F.col("nth")))
            .select("uid", "shard", "last", (F.greatest("a", "lo") - F.col("a")).alias("first"),
                    (F.least("b", "hi") - F.greatest("a", "lo")).alias("n")))


def mix(docs: DataFrame, block_words: int = 32, shard_blocks: int = 4096, most: int = 3, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """One row per row of `docs`: id, size, source_size, target, taken, first_shard, n_shards; with `carry` also `cuts`, the pieces
    (first, n) of its words that the unfinished pass takes, and the input row as struct `row`.

    `taken` counts the words the mix takes of the row, repeats counted; n_shards says in how many shards they are, first_shard is the
    first of them (null if none). Each source's taken words are its blocks, within a block of the target as a rule.
    Null, empty and blank texts have size 0 and nothing taken; a null source is a source; repeated ids and rows each
    have their own place on the line; other columns are ignored, or carried. Very long texts are cut by the shards they reach
    into. An empty table gives no rows.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    base = checkpointed(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"),
        F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("seeded"),
        F.xxhash64(text_col).alias("tie"), F.monotonically_increasing_id().alias("uid"), *row), "sizes")
    goals = checkpointed(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), most), "targets")
    stretches = checkpointed(runs(awards(goals, block_words, shard_blocks, most), goals, block_words, most), "runs")
    known = (base.select("uid", "source", "size", "seeded", "tie")
             .join(goals.select(F.col("source").alias("_source"), "rank", "source_size"), F.col("source").eqNullSafe(F.col("_source"))))
    line = running_sums(known.withColumn("chunk", F.substring("seeded", 1, 3)), "rank", "chunk", ["seeded", "size", "tie"], "size", "start")
    cuts = F.array_sort(F.collect_list(F.when(F.col("last"), F.struct("first", "n")))).alias("cuts")
    taken = (placements(line, stretches).groupBy("uid")
             .agg(F.sum("n").alias("taken"), F.min("shard").alias("first_shard"), F.count_distinct("shard").alias("n_shards") if not carry
                  else F.size(F.collect_set("shard")).cast("long").alias("n_shards"), *([cuts] if carry else [])))
    out = (base.drop("seeded", "tie").join(taken, "uid", "left")
           .join(goals.select(F.col("source").alias("_source"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_source"))))
    none = F.array().cast("array<struct<first:bigint,n:bigint>>")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
                      "first_shard", F.coalesce("n_shards", F.lit(0)).cast("long").alias("n_shards"),
                      *([F.coalesce("cuts", none).alias("cuts"), "row"] if carry else []))


def taken_texts(mixed: DataFrame, text: str | Column) -> Column:
    """For rows of mix(carry=True): the texts a row adds to the mix, itself for every whole pass, and the pieces of the last one."""
    text = F.col(text) if isinstance(text, str) else text
    times = F.floor((F.col("taken") - F.aggregate("cuts", F.lit(0).cast("long"), lambda a, c: a + c["n"])) / F.greatest("size", F.lit(1))).cast("int")
    pieces = let(words(text), lambda w: F.transform("cuts", lambda c: F.when(c["n"] == F.col("size"), text).otherwise(
        F.array_join(F.slice(w, (c["first"] + 1).cast("int"), c["n"].cast("int")), " "))))
    return F.concat(F.array_repeat(text, times), F.when(F.size("cuts") > 0, pieces).otherwise(F.array().cast("array<string>")))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH base AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                     md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS seeded FROM documents),
sized AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM base GROUP BY source),
weighed AS (SELECT *, 3 * source_size AS cap, (rank - 1) % 3 + 1 AS w, (sum(source_size) OVER ())::BIGINT AS total,
                   count(*) OVER () AS sources, (sum((rank - 1) % 3 + 1) OVER ())::BIGINT AS all_w FROM sized),
filling AS (SELECT *, coalesce(sum(w) OVER b, 0) AS w_before, coalesce(sum(cap) OVER b, 0) AS cap_before FROM weighed
            WINDOW b AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, cap * (all_w - w_before) <= w * (total - cap_before) AS is_full FROM filling),
rest AS (SELECT coalesce(sum(cap) FILTER (is_full), 0)::BIGINT AS cap_full, coalesce(sum(w) FILTER (is_full), 0)::BIGINT AS w_full FROM marked),
goals AS (SELECT m.*, CASE WHEN is_full THEN cap::DOUBLE ELSE (w * (total - cap_full))::DOUBLE / (all_w - w_full) END AS target FROM marked m, rest),
seats AS (SELECT rank, total, target / (2 * j - 1) AS quotient FROM goals,
          unnest(generate_series(1, least(ceil(target / 32) + ceil(sources / 2) + 1, ceil(cap / 32))::BIGINT)) AS s(j) WHERE target > 0),
awarded AS (SELECT rank, place // 4096 AS shard, count(*) AS blocks
            FROM (SELECT rank, total, row_number() OVER (ORDER BY quotient DESC, rank) - 1 AS place FROM seats)
            WHERE place < (2 * total + 32) // 64 GROUP BY 1, 2),
passed AS (SELECT a.rank, shard, source_size AS size_,
                  least(32 * (sum(blocks) OVER o - blocks), cap)::BIGINT AS lo_word, least(32 * sum(blocks) OVER o, cap)::BIGINT AS hi_word,
                  least(32 * sum(blocks) OVER (PARTITION BY a.rank), cap)::BIGINT AS words
           FROM awarded a JOIN goals g ON a.rank = g.rank WINDOW o AS (PARTITION BY a.rank ORDER BY shard)),
pools AS (SELECT *, words - words % size_ AS whole, greatest(lo_word, words - words % size_) AS rest, greatest(words % size_, 1)::HUGEINT AS part FROM passed),
drawn AS (SELECT *, whole + (rest - whole) * size_ // part AS pool,
                 (hi_word - whole) * size_ // part - (rest - whole) * size_ // part - (hi_word - rest) AS slack,
                 ('0x' || md5('mix:' || rank || ':' || shard)[1:8])::BIGINT AS number FROM pools),
begun AS (SELECT *, pool + 32 * (number % (CASE WHEN hi_word > rest THEN slack // 32 ELSE 0 END + 1)) AS start FROM drawn),
runs AS (SELECT rank, shard, lo_word AS lo, least(hi_word, whole) AS hi FROM begun WHERE lo_word < whole
         UNION ALL SELECT rank, shard, start, start + hi_word - rest FROM begun WHERE hi_word > rest),
line AS (SELECT row_number() OVER () AS uid, b.doc_id, b.size, g.source_size, g.target, g.rank,
                coalesce(sum(b.size) OVER (PARTITION BY g.rank ORDER BY seeded, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
         FROM base b JOIN goals g ON b.source IS NOT DISTINCT FROM g.source),
copies AS (SELECT uid, rank, start + pass * source_size AS a, start + pass * source_size + size AS b
           FROM line, (SELECT unnest([0, 1, 2]) AS pass) WHERE size > 0),
found AS (SELECT uid, sum(least(b, hi) - greatest(a, lo))::BIGINT AS taken, min(shard) AS first_shard, count(DISTINCT shard) AS n_shards
          FROM copies c JOIN runs r ON c.rank = r.rank AND a < hi AND lo < b GROUP BY uid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_shard, coalesce(n_shards, 0) AS n_shards
FROM line LEFT JOIN found USING (uid)
"""
