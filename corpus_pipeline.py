"""From raw documents to mixed shards, each stage by one of the training-data operators.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on all rows it gets and returns the
rows that go on with the columns of documents (the last adds the shard). run() writes every stage and
reads it again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm import decontaminate, jaccard_join, mixing, sharding, toxicity
from tidewatch.sources.storage import checkpointed

#: Bytes of text of a shard at most.
SHARD_BYTES = 1 << 20


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier chain calls toxic go; those without words are never called so."""
    chain = toxicity.fitted(spark, sf_dir, docs)
    return toxicity.predict(docs, chain, carry=True).where("NOT toxic").select("row.*")


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a Jaccard similarity of 0.8 or more the smallest doc_id stays."""
    return jaccard_join.keep_one(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths or more of a benchmark item's five-word shingles go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; where a shard's blocks begin or end inside one, these words as a row of their own."""
    mixed = mixing.mix(docs, carry=True)
    rows = mixed.select("row", F.explode(mixing.taken_texts(mixed, F.col("row.text"))).alias("taken_text"))
    cut = F.col("taken_text") != F.col("row.text")
    new = {"text": F.col("taken_text"), "n_chars": F.when(cut, F.length("taken_text")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard, in place of an input column of that name; equal rows of one document may lie in several pages of a shard."""
    return sharding.shard(docs.drop("shard"), SHARD_BYTES, carry=True).select("row.*", "shard")


STAGES = [("toxicity", reject_toxic), ("near_duplicates", keep_one_of_near_duplicates), ("decontamination", drop_contaminated),
          ("mixing", mix_sources), ("sharding", assign_shards)]

#: The classifier chain is not SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
