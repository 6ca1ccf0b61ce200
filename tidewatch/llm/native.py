"""Column expressions and prefix sums that the DataFrame-only operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(text: str | Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | Column) -> Column:
    """The words of a text in order; of a null text an empty array."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def let(value: Column, make) -> Column:
    """make(value) with `value` computed once a row, also where make uses it for each element of an array."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_sums(rows: DataFrame, by: str, chunk: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds the sum of `value` over the rows of the same `by` that stand before, in the order (chunk, *order).

    Two steps, so that one large group is many tasks: sums of chunks, then a window inside each chunk. `chunk` has
    a fixed number of values in each group, in the order of the rows.
    """
    sums = rows.groupBy(by, chunk).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(by, chunk, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(by, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(starts, [by, chunk])
            .withColumn(out, (F.col("_start") + F.col("_inside")).cast("long")).drop("_start", "_inside"))
