"""Ordered per-key computations that survive a hot key.

A window over `partitionBy(key)` runs one task per key, so a key with a third
of all rows would hold the job up. The helpers here cut every key into time
chunks, do the row-level work inside (key, chunk) and carry only one summary
row per chunk across chunks. The chunk-level window sees (time span / chunk)
rows per key, whatever the number of rows. Keys must not be NULL.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

DAY = 86400
CHUNK = "_chunk"


def chunk_of(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000))


def running_stats(
    df: DataFrame,
    keys: list,
    ts: str,
    tie: str,
    value: Column,
    chunk_seconds: int = DAY,
    stored: DataFrame | None = None,
) -> DataFrame:
    """Adds n, mean and sample standard deviation of `value` over all earlier rows.

    Earlier means before (ts, tie) within the keys; NULL values do not count. Adds
    baseline_n, baseline_mean (NULL when n=0) and baseline_std (0 when n=1 or all
    values are equal). `stored` (keys, mean, std_dev, sample_count) is history that
    precedes every row of `df`.
    """
    part = [*keys, CHUNK]
    base = (df.withColumn("_v", value.cast("double"))
              .withColumn(CHUNK, chunk_of(F.col(ts), chunk_seconds)))

    # within the chunk: Spark's own moment aggregates over the growing frame
    w = (Window.partitionBy(*part).orderBy(ts, tie)
         .rowsBetween(Window.unboundedPreceding, -1))
    rows = (base
            .withColumn("_n", F.count("_v").over(w))
            .withColumn("_sum", F.sum("_v").over(w))
            .withColumn("_var", F.var_pop("_v").over(w))
            .withColumn("_lo", F.min("_v").over(w))
            .withColumn("_hi", F.max("_v").over(w)))

    # one summary row per chunk, combined over the earlier chunks of the key
    chunks = base.groupBy(*part).agg(
        F.count("_v").alias("n"), F.sum("_v").alias("sum"),
        (F.var_pop("_v") * F.count("_v")).alias("m2"),
        F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    if stored is not None:
        flat = F.col("std_dev") == 0
        history = stored.join(base.select(*keys).distinct(), keys, "left_semi")
        chunks = chunks.unionByName(history.select(
            *keys, F.lit(-(2 ** 62)).cast("long").alias(CHUNK),
            F.col("sample_count").cast("long").alias("n"),
            (F.col("mean") * F.col("sample_count")).alias("sum"),
            (F.col("std_dev") ** 2 * (F.col("sample_count") - 1)).alias("m2"),
            # stored moments carry no extremes; unequal bounds mark "not constant"
            F.when(flat, F.col("mean")).otherwise(F.col("mean") - 1).alias("lo"),
            F.when(flat, F.col("mean")).otherwise(F.col("mean") + 1).alias("hi")))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    # sums are taken around the key's overall mean, which keeps them small
    carried = (chunks
               .withColumn("_c", F.sum("sum").over(whole) / F.nullif(F.sum("n").over(whole), F.lit(0)))
               .withColumn("_d", F.col("sum") / F.nullif(F.col("n"), F.lit(0)) - F.col("_c"))
               .select(
                   *part, "_c",
                   F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_pn"),
                   F.sum("sum").over(before).alias("_psum"),
                   F.sum(F.col("n") * F.col("_d")).over(before).alias("_p1"),
                   F.sum(F.col("m2") + F.col("n") * F.col("_d") * F.col("_d"))
                   .over(before).alias("_p2"),
                   F.min("lo").over(before).alias("_plo"),
                   F.max("hi").over(before).alias("_phi")))

    joined = rows.join(carried, part, "left")
    pn, n = F.col("_pn"), F.col("_n")
    pm2 = F.greatest(F.col("_p2") - F.col("_p1") * F.col("_p1") / F.nullif(pn, F.lit(0)), F.lit(0.0))
    total = pn + n
    mean = ((F.coalesce("_psum", F.lit(0.0)) + F.coalesce("_sum", F.lit(0.0)))
            / F.nullif(total, F.lit(0)))
    m2 = F.col("_var") * n
    delta = F.col("_sum") / F.nullif(n, F.lit(0)) - F.col("_psum") / F.nullif(pn, F.lit(0))
    all_m2 = (F.when(n == 0, pm2).when(pn == 0, m2)
              .otherwise(pm2 + m2 + delta * delta * pn * n / total))
    constant = F.least("_lo", "_plo") == F.greatest("_hi", "_phi")
    std = (F.when(total == 0, F.lit(None).cast("double"))
           .when(constant | (total == 1), 0.0)
           .otherwise(F.sqrt(all_m2 / F.nullif(total - 1, F.lit(0)))))
    return joined.select(
        *df.columns, total.alias("baseline_n"), mean.alias("baseline_mean"),
        std.alias("baseline_std"))


def previous_value(
    df: DataFrame, keys: list, ts: str, tie: str, value: str, out: str,
    chunk_seconds: int = DAY,
) -> DataFrame:
    """Adds the value of the previous row of the key (a `lag` that splits hot keys)."""
    part = [*keys, CHUNK]
    base = df.withColumn(CHUNK, chunk_of(F.col(ts), chunk_seconds))
    rows = base.withColumn(out, F.lag(value).over(Window.partitionBy(*part).orderBy(ts, tie)))
    lasts = base.groupBy(*part).agg(F.max_by(value, F.struct(ts, tie)).alias("_last"))
    carried = lasts.select(*part, F.lag("_last").over(
        Window.partitionBy(*keys).orderBy(CHUNK)).alias("_carried"))
    # only a chunk's first row has no lag inside its chunk; values are never NULL
    return (rows.join(carried, part, "left")
            .withColumn(out, F.coalesce(out, "_carried"))
            .select(*df.columns, out))


def running_sums(
    df: DataFrame, keys: list, at: str, order: list, columns: list, chunk: int,
) -> DataFrame:
    """Adds `<c>_run`, the sum of each (exact) column up to and including the row.

    `at` is an integer clock column, the first ordering key; `order` are the rest.
    """
    part = [*keys, CHUNK]
    base = df.withColumn(CHUNK, F.floor(F.col(at) / chunk))
    w = (Window.partitionBy(*part).orderBy(at, *order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = base
    for c in columns:
        rows = rows.withColumn(f"{c}_run", F.sum(c).over(w))
    before = (Window.partitionBy(*keys).orderBy(CHUNK)
              .rowsBetween(Window.unboundedPreceding, -1))
    carried = base.groupBy(*part).agg(*[F.sum(c).alias(f"_s_{c}") for c in columns])
    carried = carried.select(*part, *[
        F.sum(f"_s_{c}").over(before).alias(f"_p_{c}") for c in columns])
    joined = rows.join(carried, part, "left")
    for c in columns:
        joined = joined.withColumn(
            f"{c}_run", F.coalesce(f"{c}_run", F.lit(0)) + F.coalesce(f"_p_{c}", F.lit(0)))
    return joined.select(*df.columns, *[f"{c}_run" for c in columns])
