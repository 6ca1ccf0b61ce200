"""Extendible hashing: documents to shards of at most so many bytes, by as few hash-prefix bits as that takes.

A shard is a prefix of the documents' hash bits. The directory is found level by level from byte counts alone: a
prefix that fits is a shard, only one that doesn't splits on its next bit. Counts are gathered once for the
cells of a whole stretch of levels, a little deeper than shards of even size would need; the cells still too
large, if any, go to the next stretch.

The hash takes id and text, so only equal rows share all its bits; where those alone exceed the limit, they are dealt
to pages of the shard by count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.native import running_sums
from tidewatch.sources.storage import checkpointed

#: Bits of the hash that are used; levels that a further stretch adds.
BITS, STRETCH = 60, 8


def _cell(depth: int):
    return F.shiftright("h", BITS - depth)


def directory(light: DataFrame, byte_limit: int) -> tuple[list[tuple[int, DataFrame]], DataFrame | None]:
    """From (h, n_bytes): for each stretch its deepest level and (cell, depth) of the cells whose shard is found, and the
    hashes whose rows exceed the limit at the last bit, if any."""
    total = light.agg(F.sum("n_bytes")).first()[0] or 0
    top, bottom, found, rest = 0, min(BITS, max(1, (total // byte_limit).bit_length() + 4)), [], light
    while True:
        cells = checkpointed(rest.groupBy(_cell(bottom).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes")), "cells")
        levels = (cells.select("cell", "n_bytes", F.explode(F.sequence(F.lit(top), F.lit(bottom))).alias("depth"))
                  .withColumn("prefix", F.expr(f"shiftright(cell, {bottom} - depth)")))
        fits = levels.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("b")).where(F.col("b") <= byte_limit).select("depth", "prefix")
        placed = checkpointed(levels.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth")), "directory")
        found.append((bottom, placed))
        over = cells.join(placed, "cell", "left_anti").select("cell")
        if over.isEmpty():
            return found, None
        rest = checkpointed(rest.withColumn("cell", _cell(bottom)).join(over, "cell", "left_semi").drop("cell"), "oversized")
        if bottom == BITS:
            return found, rest.groupBy("h").agg(F.max("n_bytes").alias("widest"))
        top, bottom = bottom + 1, min(BITS, bottom + STRETCH)


def shard(docs: DataFrame, byte_limit: int, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per row of `docs`: id, n_bytes, depth, shard, and with `carry` the input row as struct `row`.

    `shard` is the prefix as 0s and 1s, `depth` its length. The bytes of a row are its text's in UTF-8, 0 for a null text. A
    shard exceeds `byte_limit` only if it is one row that does. Equal rows are dealt to pages
    (`shard` then ends in /0, /1, ...) where together they exceed it; a null id hashes like an empty one; other columns
    are ignored, or carried. An empty table has no shards; if all fits one shard, its prefix is empty.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text_col, F.lit("")))))
    hashed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
                         F.conv(F.substring(key, 1, BITS // 4), 16, 10).cast("long").alias("h"), *row)
    if not carry:
        hashed = checkpointed(hashed, "hashed")
    found, stuck = directory(checkpointed(hashed.select("h", "n_bytes"), "hashes") if carry else hashed.select("h", "n_bytes"), byte_limit)
    out = hashed.withColumn("depth", F.lit(None).cast("int"))
    for bottom, placed in found:
        placed = placed.select(F.col("cell").alias("_cell"), F.col("depth").alias("_depth"))
        out = (out.withColumn("_own", _cell(bottom)).join(placed, F.col("_own") == F.col("_cell"), "left")
               .withColumn("depth", F.coalesce("depth", "_depth")).drop("_own", "_cell", "_depth"))
    name = F.when(F.col("depth") > 0, F.lpad(F.bin(F.expr(f"shiftright(h, {BITS} - depth)")), F.col("depth"), F.lit("0"))).otherwise("")
    if stuck is not None:
        equal = checkpointed(hashed.join(stuck, "h").withColumn("at", F.monotonically_increasing_id()), "pages")
        equal = running_sums(equal.withColumn("one", F.lit(1)).withColumn("chunk", F.shiftright("at", 16)), "h", "chunk", ["at"], "one", "before")
        page = F.floor(F.col("before") / F.greatest(F.lit(1), F.floor(F.lit(byte_limit) / F.greatest("widest", F.lit(1)))))
        equal = equal.select("id", "n_bytes", F.lit(BITS).alias("depth"), F.concat(F.lpad(F.bin("h"), F.lit(BITS), F.lit("0")), F.lit("/"), page.cast("string")).alias("shard"), *(["row"] if carry else []))
        out = out.where("depth IS NOT NULL")
    out = out.select("id", "n_bytes", "depth", name.alias("shard"), *(["row"] if carry else []))
    return (out if stuck is None else out.unionByName(equal)).withColumnRenamed("id", id_col)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes the carried rows of shard(carry=True), one folder and one file per shard."""
    (sharded.select(F.concat(F.lit("s"), F.replace("shard", F.lit("/"), F.lit("-"))).alias("shard"), "row.*")
     .repartition("shard").write.partitionBy("shard").parquet(path))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """Shards of at most 1 MiB of text."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 1 << 20)


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
levels AS (SELECT depth, h >> (60 - depth) AS prefix FROM d, range(0, 61) AS r(depth) GROUP BY ALL HAVING sum(n_bytes) <= 1048576),
found AS (SELECT h, min(depth) AS depth FROM (SELECT DISTINCT h FROM d) JOIN levels ON prefix = h >> (60 - levels.depth) GROUP BY h)
SELECT doc_id, n_bytes, depth::INTEGER AS depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> (60 - depth)), depth::INTEGER, '0') END AS shard
FROM d JOIN found USING (h)
"""
