"""Profiling of big tables into signals: one pass per table."""

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.keys import stable_id
from tidewatch.sources.storage import checkpointed


def _text(columns: list) -> Column:
    """Row content as text; NULL is spelled out so that it cannot move between columns."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str)
                                         else c.cast("string"), F.lit("\\N"))
                              for c in columns])


def checksum(columns: list) -> Column:
    """Aggregate: content checksum that does not depend on row order.

    Two 24-bit slices of each row's MD5 are summed on their own, so a sum stays in
    a BIGINT up to 2^39 rows, and duplicates still count.
    """
    digest = F.md5(_text(columns))
    half = [F.sum(F.conv(F.substring(digest, pos, 6), 16, 10).cast("bigint"))
            for pos in (1, 7)]
    return F.concat_ws("-", half[0].cast("string"), half[1].cast("string"))


def profile_partitions(
    table: DataFrame, source: Column, partition: Column,
    checksum_columns: list | None = None, null_columns: list | None = None,
) -> DataFrame:
    """Row count, checksum and per-column null counts of every partition, in one scan.

    Callers select what they need; Catalyst drops the other aggregates and their
    input columns from the scan.
    """
    aggregates = [F.count(F.lit(1)).alias("row_count")]
    if checksum_columns:
        aggregates.append(checksum(checksum_columns).alias("checksum"))
    for c in null_columns or []:
        aggregates.append(F.count_if(F.col(c).isNull()).alias(f"nulls_{c}"))
    return table.groupBy(source.alias("source"), partition.alias("partition")).agg(*aggregates)


def calendar_spine(counts: DataFrame, step: str) -> DataFrame:
    """Every (source, partition) between the first and last partition of the table."""
    span = counts.agg(F.struct(F.min("partition").alias("lo"),
                               F.max("partition").alias("hi")).alias("span"))
    return (counts.select("source").distinct()
            .withColumn("span", span.scalar())
            .select("source", F.explode(F.sequence(
                "span.lo", "span.hi", F.expr(f"INTERVAL {step}"))).alias("partition")))


def fill_calendar(counts: DataFrame, step: str) -> DataFrame:
    """Adds the missing partitions with 0 rows. Reads `counts` three times: pass a stored one."""
    return (calendar_spine(counts, step)
            .join(counts.select("source", "partition", "row_count"), ["source", "partition"], "left")
            .select("source", "partition", F.coalesce("row_count", F.lit(0)).alias("row_count")))


def partition_row_count(
    table: DataFrame, source: Column, partition: Column, step: str | None = None,
) -> DataFrame:
    """Rows per partition; with `step` ('1 HOUR'), missing partitions count 0."""
    counts = profile_partitions(table, source, partition)
    return counts if step is None else fill_calendar(checkpointed(counts, "profile"), step)


def partition_checksum(table: DataFrame, source: Column, partition: Column, columns: list) -> DataFrame:
    return (profile_partitions(table, source, partition, checksum_columns=columns)
            .select("source", "partition", "checksum"))


def partition_null_rate(table: DataFrame, source: Column, partition: Column, columns: list) -> DataFrame:
    """One row per partition and column with the share of NULLs."""
    wide = profile_partitions(table, source, partition, null_columns=columns)
    rates = F.array(*[F.struct(F.lit(c).alias("column_name"),
                               (F.col(f"nulls_{c}") / F.col("row_count")).alias("null_rate"))
                      for c in columns])
    return wide.select("source", "partition", F.inline(rates))


def column_summary(table: DataFrame, columns: list, exact_distinct: bool = False) -> DataFrame:
    """Moments, range, null rate and distinct count of numeric columns, in one pass.

    `exact_distinct` makes Spark expand the rows once per column; the default keeps a
    mergeable sketch instead.
    """
    distinct = F.count_distinct if exact_distinct else F.approx_count_distinct
    wide = table.agg(F.count(F.lit(1)).alias("n"), *[
        F.struct(
            F.avg(c).alias("mean"), F.stddev_samp(c).alias("std_dev"),
            F.min(F.col(c).cast("double")).alias("min"),
            F.max(F.col(c).cast("double")).alias("max"),
            F.count_if(F.col(c).isNull()).alias("nulls"),
            distinct(c).alias("n_distinct")).alias(f"s_{c}") for c in columns])
    rows = F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col("n"), F.col(f"s_{c}.mean"), F.col(f"s_{c}.std_dev"),
        F.col(f"s_{c}.min"), F.col(f"s_{c}.max"),
        (F.col(f"s_{c}.nulls") / F.nullif(F.col("n"), F.lit(0))).alias("null_rate"),
        F.col(f"s_{c}.n_distinct")) for c in columns])
    return wide.select(F.inline(rows))


def summary_sketches(table: DataFrame, source: Column, partition: Column, columns: list, lg_k: int = 12) -> DataFrame:
    """One row per (source, partition, column) to store: counts, moments, range and an HLL sketch of the distinct values.

    One scan for all columns. `merged_summary` makes the summary of any set of partitions from these rows alone, so a new or
    replaced partition costs a scan of that partition only. A sketch holds 2^lg_k buckets at most.
    """
    wide = table.groupBy(source.alias("source"), partition.alias("partition")).agg(F.count(F.lit(1)).alias("n"), *[
        F.struct(
            F.count(c).alias("n_values"), F.avg(c).alias("mean"), (F.var_pop(c) * F.count(c)).alias("m2"),
            F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max"),
            F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias("distinct_values")).alias(f"s_{c}") for c in columns])
    return wide.select("source", "partition", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col("n"), F.col(f"s_{c}.*")) for c in columns])))


def merged_summary(sketches: DataFrame, by: list) -> DataFrame:
    """Summaries of the stored partitions per `by` columns and column name, without a look at the table.

    `by` may be empty, ["source"], or any columns of `sketches` that tell groups apart. All but n_distinct are exact up
    to rounding: squared deviations are moved from the partitions' means to the common one rather than got as the difference of
    two large sums. n_distinct has a relative standard error of about 1.04 / sqrt(2^lg_k), 1.6 % for 12. Sketches of
    different sizes merge into the smaller one. Reads `sketches` twice: pass a stored table.
    """
    keys = [*by, "column_name"]
    common = sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("n_values").alias("n_values"),
        (F.sum(F.col("mean") * F.col("n_values")) / F.nullif(F.sum("n_values"), F.lit(0))).alias("mean"),
        F.min("min").alias("min"), F.max("max").alias("max"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_values", True)).alias("n_distinct"))
    means = common.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("mean").alias("_mean"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    apart = F.col("mean") - F.col("_mean")
    spread = (sketches.select(*keys, "mean", "m2", "n_values").join(means, same)
              .groupBy(*[f"_{k}" for k in keys]).agg(F.sum(F.col("m2") + F.col("n_values") * apart * apart).alias("_m2")))
    return (common.join(spread, same)
            .select(*keys, "n", "mean",
                    F.when(F.col("n_values") > 1, F.sqrt(F.col("_m2") / (F.col("n_values") - 1))).alias("std_dev"), "min", "max",
                    ((F.col("n") - F.col("n_values")) / F.nullif(F.col("n"), F.lit(0))).alias("null_rate"), "n_distinct"))


def schema_snapshot(table: DataFrame, source: str) -> DataFrame:
    """The table's schema as rows; only metadata is touched, no data is read."""
    spark = table.sparkSession
    rows = [(source, i, f.name, f.dataType.simpleString().upper(), f.nullable)
            for i, f in enumerate(table.schema.fields)]
    return spark.createDataFrame(
        rows, "source string, position int, column_name string, dtype string, nullable boolean")


def build_signals(
    counts: DataFrame, profile: DataFrame, stage: str = "ingestion",
    null_columns: list | None = None,
) -> DataFrame:
    """Signal rows from the (spined) counts and the partition profile.

    null_rate is the share of NULL cells over `null_columns`; checksum and null_rate
    stay NULL for empty partitions.
    """
    names = null_columns or []
    cells = sum((F.col(f"nulls_{c}") for c in names), F.lit(0))
    measured = profile.select(
        "source", "partition",
        F.col("checksum") if "checksum" in profile.columns
        else F.lit(None).cast("string").alias("checksum"),
        (cells / (F.col("row_count") * len(names)) if names
         else F.lit(None).cast("double")).alias("null_rate"))
    run_id = F.concat_ws("@", "source", F.date_format("partition", "yyyyMMddHHmm"))
    return (counts.join(measured, ["source", "partition"], "left")
            .select(
                stable_id(F.lit("signal"), run_id).alias("event_id"),
                F.lit(stage).alias("stage"), "source", run_id.alias("run_id"),
                F.col("partition").alias("ts"), "row_count", "checksum", "null_rate",
                F.lit(None).cast("bigint").alias("duration_ms")))
