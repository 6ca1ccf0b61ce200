"""Operational reports."""

from pyspark.sql import Column, DataFrame, functions as F


def feedback_report(feedback: DataFrame, incidents: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Verdicts on alerts of the last days, counted per root cause."""
    recent = feedback.filter(F.col("created_at") > as_of - F.expr(f"INTERVAL {days} DAYS"))
    return (recent.select("incident_id", "feedback")
            .join(incidents.select("incident_id", "root_cause"), "incident_id")
            .groupBy("root_cause", "feedback").agg(F.count(F.lit(1)).alias("n")))


def open_incidents(incidents: DataFrame) -> DataFrame:
    return (incidents.filter(F.col("status") == "open")
            .select("incident_id", "root_cause", "severity", "status", "created_at"))


def recent_actions(log: DataFrame, n: int = 20) -> DataFrame:
    """The latest actions; a top-n, never a full sort."""
    return (log.orderBy(F.desc("executed_at"), "action_id").limit(n)
            .select("action_type", "target", "success", "executed_at"))


def agent_status(heartbeats: DataFrame) -> DataFrame:
    """Latest heartbeat of each agent."""
    return (heartbeats.groupBy("agent_name").agg(F.max(F.struct("ts", "status")).alias("h"))
            .select("agent_name", F.col("h.ts").alias("last_seen"), F.col("h.status").alias("status")))


def missing_agents(heartbeats: DataFrame, expected: DataFrame, since: Column) -> DataFrame:
    """Expected agents without a heartbeat since the given time."""
    alive = heartbeats.filter(F.col("ts") >= since).select("agent_name").distinct()
    return expected.select("agent_name").distinct().join(alive, "agent_name", "left_anti")


def stage_counters(signals: DataFrame, anomalies: DataFrame, buckets: DataFrame, actions: DataFrame) -> DataFrame:
    """How many rows each stage took in, found, suppressed, executed or skipped.

    `buckets` has a suppressed flag, `actions` a disposition.
    """
    def rows(df, stage, counter):
        return df.groupBy().agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(stage).alias("stage"), F.lit(counter).alias("counter"), F.col("n"))

    buckets_by = buckets.groupBy("suppressed").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("correlation").alias("stage"),
        F.when(F.col("suppressed"), "suppressed").otherwise("emitted").alias("counter"), "n")
    actions_by = actions.groupBy("disposition").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("remediation").alias("stage"), F.col("disposition").alias("counter"), "n")
    return (rows(signals, "ingestion", "processed")
            .unionByName(rows(anomalies, "ingestion", "detected"))
            .unionByName(buckets_by).unionByName(actions_by))


OBSERVED = "_counters"


def observed(df: DataFrame, stage: str, **counters: Column) -> DataFrame:
    """Counts the rows passing a stage while the job runs: all as `processed`, and those that meet each given condition.

    The counts come with the metrics of the job or micro-batch, so they cost no pass of their own; `streaming.counters` sums
    them up for streams. A condition that is NULL is not met.
    """
    return df.observe(stage + OBSERVED, F.count(F.lit(1)).alias("processed"),
                      *[F.count_if(condition).alias(name) for name, condition in counters.items()])


def reconcile_partitions(left: DataFrame, right: DataFrame, keys: list) -> DataFrame:
    """Compares row counts and checksums of two copies per partition.

    Both sides are partition profiles with row_count and checksum.
    """
    a = left.select(*keys, F.col("row_count").alias("left_count"), F.col("checksum").alias("_lc"))
    b = right.select(*keys, F.col("row_count").alias("right_count"), F.col("checksum").alias("_rc"))
    joined = (a.join(b, keys, "full_outer")
              .withColumn("left_count", F.coalesce("left_count", F.lit(0)))
              .withColumn("right_count", F.coalesce("right_count", F.lit(0))))
    return joined.select(*keys, "left_count", "right_count",
                         (F.col("left_count") - F.col("right_count")).alias("diff"),
                         F.col("_lc").eqNullSafe(F.col("_rc")).alias("checksum_equal"))
