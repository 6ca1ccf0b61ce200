"""Finds benchmark items inside documents: size-partitioned MinHash containment search, verified exactly.

An item is contaminated by a document that holds at least `percent` of the item's distinct word shingles.

1. Items are partitioned by size, each class holding items of 2**p up to 2**(p+1) - 1 shingles. An item's sketch is the
   MinHash of its shingles: as many of the smallest hash values as an item of the class's upper bound u may miss, plus
   one. A document that misses fewer shingles than that holds one of them, so no match is lost whatever the hash does.
2. A document is a candidate for an item if it holds a value of the sketch and has enough shingles for the
   item's class. The document's side keeps all its values: its own MinHash would be dominated by the rest of a long
   text (a 40-shingle item is 0.4 % of a 10,000-shingle document), and short items would be lost.
3. Candidates are verified by counting common shingles as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.native import let, lower_ascii, words
from tidewatch.sources.storage import checkpointed

#: Sketch values that may be broadcast (16 bytes each); beyond that the join is shuffled.
BROADCAST_ROWS = 1_000_000


def _hashes(hashed: Column, lengths: list[int]) -> Column:
    """Hashes of n consecutive elements of an array of word hashes, for every n of `lengths`."""
    def of(h, n):
        starts = F.sequence(F.lit(0), F.size(h) - n)
        return F.when(F.size(h) >= n, F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))
    return let(hashed, lambda h: F.concat(*[of(h, n) for n in lengths]))


def _texts(found: Column, lengths: list[int]) -> Column:
    """n consecutive words each, joined by a space, for every n of `lengths`."""
    def of(w, n):
        starts = F.sequence(F.lit(1), F.size(w) - n + 1)
        return F.when(F.size(w) >= n, F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return let(found, lambda w: F.concat(*[of(w, n) for n in lengths]))


def _word_hashes(text: str) -> Column:
    return F.transform(words(lower_ascii(text)), lambda w: F.xxhash64(w))


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, n_shared, n_item, text_hash): which rows of `docs` hold at least `percent` of which item's shingles.

    Shingles are k words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; an item of fewer words is one shingle of all of them,
    looked for as such. Null, empty and blank items match nothing, such documents hold nothing. Rows of equal id and
    text give one result, of equal id and other text one each (text_hash is xxhash64 of the text); null ids are kept; equal
    items and items of equal id match each as they stand. Other columns are ignored.
    """
    item_words = words(lower_ascii("text"))
    items = checkpointed(
        benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).distinct()
        .select("item", item_words.alias("w"), F.least(F.size(item_words), F.lit(k)).alias("m")).where("m > 0"), "items")
    sizes = sorted(r[0] for r in items.select("m").distinct().collect())  # at most k
    hashed = F.transform("w", lambda w: F.xxhash64(w))
    pick = lambda make, of: F.array_distinct(F.coalesce(*[F.when(F.col("m") == n, make(of, [n])) for n in sizes] or [make(of, [k])]))
    items = (items.select("item", "m", pick(_texts, F.col("w")).alias("shingles"), pick(_hashes, hashed).alias("values"))
             .withColumn("n_item", F.size("shingles")).withColumn("key", F.xxhash64("item", "shingles"))
             .withColumn("class", F.floor(F.log2("n_item"))).withColumn("least", F.pow(F.lit(2), "class").cast("int")))
    upper = F.col("least") * 2 - 1
    may_miss = upper - F.ceil(upper * percent / 100)
    sketch = checkpointed(items.select("item", "key", F.ceil(F.col("least") * percent / 100).alias("enough"),
                                       F.explode(F.slice(F.array_sort("values"), 1, (may_miss + 1).cast("int"))).alias("value")), "sketch")
    if sketch.count() <= BROADCAST_ROWS:
        sketch = F.broadcast(sketch)

    lengths = sorted({k, *sizes})
    ids = [F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash")]
    held = (docs.select(*ids, _word_hashes(text_col).alias("hashed"))
            .select("id", "text_hash", _hashes(F.col("hashed"), lengths).alias("values"))
            .select("id", "text_hash", F.size("values").alias("size"), "values")
            .select("id", "text_hash", "size", F.explode("values").alias("value")))
    candidates = checkpointed(held.join(sketch, "value").where("size >= enough").select("id", "text_hash", "item", "key").distinct(), "candidates")

    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    some = candidates.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    found = F.col("found")
    texts = (docs.select(*ids, F.col(f"`{text_col}`").alias("text")).join(some, same, "left_semi").dropDuplicates(["id", "text_hash"])
             .select("id", "text_hash", words(lower_ascii("text")).alias("found"))
             .select("id", "text_hash", F.explode(F.array_distinct(_texts(found, lengths))).alias("shingle")))
    wanted = items.select("item", "key", "n_item", F.explode("shingles").alias("shingle"))
    shared = texts.join(wanted, "shingle").groupBy("id", "text_hash", "item", "key", "n_item").agg(F.count("*").alias("n_shared"))
    proved = shared.where(F.col("n_shared") * 100 >= F.col("n_item") * percent).alias("p").join(
        candidates.alias("c"), F.col("p.id").eqNullSafe(F.col("c.id")) & (F.col("p.text_hash") == F.col("c.text_hash"))
        & F.col("p.item").eqNullSafe(F.col("c.item")) & (F.col("p.key") == F.col("c.key")), "left_semi")
    return proved.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_shared", F.col("n_item").cast("long").alias("n_item"), "text_hash").distinct()


def clean(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that hold no item, with all their columns, whatever their names."""
    found = contaminated(docs, benchmark, k, percent, id_col, text_col).select(F.col(id_col).alias("id"), F.col("text_hash").alias("hash")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("own_id"), F.xxhash64(f"`{text_col}`").alias("own_hash"))
    kept = rows.join(found, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash")), "left_anti")
    return kept.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return contaminated(read("documents"), read("benchmark")).drop("text_hash")


ORACLE = r"""
WITH w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
item AS (SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS s
         FROM (SELECT item_id, w, least(len(w), 5) AS m FROM i WHERE len(w) > 0), unnest(range(1, len(w) - m + 2)) AS r(p)),
sizes AS (SELECT DISTINCT m FROM item),
doc AS (SELECT DISTINCT id, array_to_string(w[p:p + m - 1], ' ') AS s FROM (SELECT * FROM w, sizes WHERE len(w) >= m), unnest(range(1, len(w) - m + 2)) AS r(p)),
n AS (SELECT item_id, count(*) AS n_item FROM item GROUP BY item_id)
SELECT id AS doc_id, item_id, count(*) AS n_shared, n_item FROM doc JOIN item USING (s) JOIN n USING (item_id)
GROUP BY id, item_id, n_item HAVING count(*) * 100 >= n_item * 80
"""
