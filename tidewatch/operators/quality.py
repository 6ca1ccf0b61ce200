"""Data tests on tables, and scoring of test results.

Test rows are (run_id, run_at, position, unique_id, test_name, model_name, column_name,
status, failures, execution_time, message, agent_severity, blast_radius, oncall_team).
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.keys import stable_id
from tidewatch.functions.severity import failure_count_severity, max_severity
from tidewatch.operators import running


# ---- running tests on tables ------------------------------------------------

def not_null_check(column: str) -> tuple:
    return ("not_null", column, F.col(column).isNull())


def accepted_values_check(column: str, values: list) -> tuple:
    return ("accepted_values", column, ~F.col(column).isin(values))


def between_check(column: str, lo=None, hi=None) -> tuple:
    outside = F.lit(False)
    if lo is not None:
        outside = outside | (F.col(column) < lo)
    if hi is not None:
        outside = outside | (F.col(column) > hi)
    return ("between", column, outside)


def _status(failures: Column) -> Column:
    return F.when(failures > 0, "fail").otherwise("pass")


def run_checks(table: DataFrame, run: Column, checks: list) -> DataFrame:
    """Any number of row-level checks in one pass over the table, one row per run and check.

    A check is (test name, column, condition of a failing row); an unknown condition
    (NULL value) passes.
    """
    wide = table.groupBy(run.alias("run_id")).agg(
        *[F.count_if(failing).alias(f"f{i}") for i, (_, _, failing) in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(name).alias("test_name"), F.lit(column).alias("column_name"),
                              F.col(f"f{i}").alias("failures"))
                     for i, (name, column, _) in enumerate(checks)])
    return (wide.select("run_id", F.inline(rows))
            .withColumn("status", _status(F.col("failures"))))


def test_not_null(table: DataFrame, run: Column, column: str) -> DataFrame:
    return run_checks(table, run, [not_null_check(column)])


def test_accepted_values(table: DataFrame, run: Column, column: str, values: list) -> DataFrame:
    return run_checks(table, run, [accepted_values_check(column, values)])


def test_between(table: DataFrame, run: Column, column: str, lo=None, hi=None) -> DataFrame:
    return run_checks(table, run, [between_check(column, lo, hi)])


def test_unique(table: DataFrame, run: Column, key_columns: list) -> DataFrame:
    """Key values that occur more than once in a run; keys with a NULL are ignored.

    Copies of a key are counted on the map side first, so a key with a third of all
    rows reaches its reducer as one partial count per task.
    """
    name = ",".join(key_columns)
    whole = F.lit(True)
    for c in key_columns:
        whole = whole & F.col(c).isNotNull()
    keyed = table.groupBy(run.alias("run_id"), *key_columns).agg(F.count(F.lit(1)).alias("copies"))
    return (keyed.groupBy("run_id")
            .agg(F.count_if(whole & (F.col("copies") > 1)).alias("failures"))
            .select("run_id", F.lit("unique").alias("test_name"),
                    F.lit(name).alias("column_name"), "failures")
            .withColumn("status", _status(F.col("failures"))))


# keep pytest from collecting the public test_* operators when they are imported
for _f in (test_not_null, test_accepted_values, test_between, test_unique):
    _f.__test__ = False


# ---- scoring results --------------------------------------------------------

def failed_tests(tests: DataFrame) -> DataFrame:
    """Results that failed or broke; a warning counts as passed."""
    return tests.filter(F.col("status").isin("fail", "error"))


def per_column(tests: DataFrame) -> DataFrame:
    """Names every test after its column too, so that equal tests of two columns of a model
    keep separate histories (by default they share one)."""
    return tests.withColumn("test_name", F.concat_ws(":", "test_name", "column_name"))


def test_history(tests: DataFrame) -> DataFrame:
    """History rows of all results, passed or not."""
    failed = F.col("status").isin("fail", "error")
    return tests.select(
        "model_name", "test_name", "run_id", (~failed).alias("passed"),
        F.col("failures").cast("double").alias("failure_rate"), "run_at", "position")


test_history.__test__ = False


def flakiness(history: DataFrame, window: int = 20, threshold: float = 0.20, min_runs: int = 5,
              chunk_seconds: int = 7 * running.DAY) -> DataFrame:
    """Per (run, model, test): failures among the last `window` results, this run included.

    A window frame over (model, test) would put one test's whole history in one task.
    The history is cut into time chunks; each chunk receives the last `window`-1 flags
    before it, which are found from the tails of at most `window`-1 earlier chunks.
    """
    keys = ["model_name", "test_name"]
    part = [*keys, running.CHUNK]
    rows = history.select(
        *keys, "run_id", "run_at", "position", (~F.col("passed")).cast("int").alias("failed"),
        running.chunk_of(F.col("run_at"), chunk_seconds).alias(running.CHUNK))
    order = ["run_at", "position"]

    newest = Window.partitionBy(*part).orderBy(*[F.desc(c) for c in order])
    tails = (rows.withColumn("_r", F.row_number().over(newest))
             .filter(F.col("_r") <= window - 1)
             .groupBy(*part)
             .agg(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("_r"), "failed"))),
                              lambda e: e["failed"]).alias("tail")))
    earlier = Window.partitionBy(*keys).orderBy(running.CHUNK).rowsBetween(-(window - 1), -1)
    carried = tails.select(*part, F.flatten(F.collect_list("tail").over(earlier)).alias("before"))

    ordered = Window.partitionBy(*part).orderBy(*order)
    recent = ordered.rowsBetween(-(window - 1), Window.currentRow)
    counted = (rows.withColumn("_i", F.row_number().over(ordered))
               .withColumn("_fails", F.sum("failed").over(recent))
               .join(carried, part, "left"))
    # results still missing to a full window come from the end of the carried flags
    size = F.size("before")
    missing = F.least(F.greatest(F.lit(window) - F.col("_i"), F.lit(0)), size)
    taken = F.slice("before", size - missing + 1, missing)
    counted = (counted
               .withColumn("_total", F.least("_i", F.lit(window)) + missing)
               .withColumn("_all", F.col("_fails") + F.when(missing > 0, F.aggregate(
                   taken, F.lit(0).cast("bigint"), lambda a, x: a + x)).otherwise(0)))
    last = (counted.groupBy("run_id", *keys)
            .agg(F.max(F.struct(*order, F.col("_total"), F.col("_all"))).alias("l")))
    return flaky_flags(last.select("run_id", *keys, F.col("l._total").cast("bigint").alias("total_runs"),
                                   F.col("l._all").alias("failure_count")), threshold, min_runs)


def flaky_flags(counted: DataFrame, threshold: float = 0.20, min_runs: int = 5) -> DataFrame:
    """Adds the rate and the flags to rows with total_runs and failure_count."""
    return (counted.withColumn("flakiness_rate", F.col("failure_count") / F.col("total_runs"))
            .withColumn("is_flaky", (F.col("total_runs") >= min_runs)
                        & (F.col("flakiness_rate") > threshold))
            .withColumn("is_new_test", F.col("total_runs") < min_runs))


def test_severity(failed: DataFrame, scores: DataFrame) -> DataFrame:
    """Severity of failed tests: the owner's label, else by failure count; flaky ones are capped."""
    return graded(failed.join(
        scores.select("run_id", "model_name", "test_name", "is_flaky", "is_new_test"),
        ["run_id", "model_name", "test_name"], "left"))


def graded(scored: DataFrame) -> DataFrame:
    """Severity of failed tests that carry their flags."""
    label = F.col("agent_severity")
    base = (F.when(label.isin("critical", "high", "medium", "low"), F.upper(label))
            .otherwise(failure_count_severity(F.col("failures"))))
    flaky = F.coalesce("is_flaky", F.lit(False))
    return (scored
            .withColumn("severity", F.when(flaky & base.isin("HIGH", "CRITICAL"), "MEDIUM").otherwise(base))
            .withColumn("is_flaky", flaky)
            .withColumn("is_new_test", F.coalesce("is_new_test", F.lit(True))))


test_severity.__test__ = False


def quality_anomalies(scored: DataFrame) -> DataFrame:
    """One anomaly per (run, model) with failures.

    The list of its tests is not packed into the row: `quality_anomaly_tests` has them
    as rows under the same signal_id, so a model with very many failing tests does not
    become one huge value.
    """
    grouped = scored.groupBy("run_id", "model_name").agg(
        F.max("run_at").alias("ts"), max_severity(F.col("severity")).alias("severity"),
        F.count(F.lit(1)).alias("total_failed_tests"),
        F.count_if(~F.col("is_flaky")).alias("genuine_failures"),
        F.count_if(F.col("is_flaky")).alias("flaky_failures"))
    return grouped.select(
        _quality_id().alias("signal_id"), F.lit("quality_failure").alias("anomaly_type"),
        F.lit("quality_auditor").alias("source_agent"), "run_id", "model_name", "severity",
        F.when(F.col("genuine_failures") > 0, 0.95).otherwise(0.5).alias("confidence"), "ts",
        F.to_json(F.struct("total_failed_tests", "genuine_failures", "flaky_failures")).alias("details"),
        "total_failed_tests", "genuine_failures", "flaky_failures")


def _quality_id() -> Column:
    return stable_id(F.lit("quality"), "run_id", "model_name")


def quality_anomaly_tests(scored: DataFrame) -> DataFrame:
    """The failing tests behind each quality anomaly, one row per test."""
    return scored.select(
        _quality_id().alias("signal_id"), "run_id", "model_name", "test_name", "column_name",
        "failures", "severity", "is_flaky", "is_new_test", "blast_radius", "oncall_team", "message")


def with_test_lists(anomalies: DataFrame, tests: DataFrame) -> DataFrame:
    """Anomalies as a sink sends them: the rows of `quality_anomaly_tests` as the list `tests` in details.

    A message holds all failing tests of its run and model; steps in between use the rows.
    """
    entry = F.struct("test_name", F.col("column_name").alias("column"), "failures", "severity", "is_flaky", "is_new_test",
                     "blast_radius", "oncall_team", "message")
    lists = tests.groupBy("signal_id").agg(F.sort_array(F.collect_list(entry)).alias("tests"))
    return (anomalies.join(lists, "signal_id", "left")
            .withColumn("details", F.to_json(F.struct("total_failed_tests", "genuine_failures", "flaky_failures", "tests"))).drop("tests"))


def run_summary(tests: DataFrame) -> DataFrame:
    failed = F.col("status").isin("fail", "error")
    return tests.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_tests"), F.count_if(failed).alias("failed_tests"),
        F.count_distinct(F.when(failed, F.col("model_name"))).alias("n_signals"))
