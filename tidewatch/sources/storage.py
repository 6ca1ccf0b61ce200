"""Tables on shared storage: checkpoints, upserts, idempotent appends."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Where that is unset, as in local tests, a temporary folder takes its place, but only if
    the master is local: elsewhere executors would each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidewatch-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a stored step that no later read needs."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes the rows as a parquet table in the shared folder and reads them back.

    Cuts the lineage and survives the loss of executors. Unlike an RDD checkpoint the
    table is columnar, is read with column pruning, and has a known size, by which
    Spark decides on broadcasting it.
    """
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert_latest(current: DataFrame, updates: DataFrame, keys: list, order_col: str) -> DataFrame:
    """Keyed latest-wins merge; on equal order the update wins, of equal updates the one with the greatest values.

    An aggregate, not a window: each task first reduces a key to its newest row, so a
    key with very many updates is shuffled as one row per task.
    """
    rows = (current.withColumn("_from", F.lit(0))
            .unionByName(updates.select(*current.columns).withColumn("_from", F.lit(1))))
    rest = [c for c in current.columns if c not in keys]
    ties = [c for c in rest if not isinstance(current.schema[c].dataType, T.MapType)]
    return (rows.groupBy(*keys)
            .agg(F.max_by(F.struct(*rest), F.struct(order_col, "_from", *ties)).alias("r"))
            .select(*keys, "r.*").select(*current.columns))


def append_history(df: DataFrame, path: str, batch_id: int) -> None:
    """Append for `foreachBatch`: a replayed batch replaces its own rows, nothing doubles."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def read_history(spark: SparkSession, path: str, schema) -> DataFrame:
    """All appended batches; empty when nothing was written yet. A lost file is an error."""
    if not list_folder(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in store.listStatus(target)] if store.exists(target) else []
