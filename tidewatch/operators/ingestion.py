"""Ingestion checks over signal history: empty loads, z-scores, checksums, freshness.

Signals are rows (event_id, stage, source, run_id, ts, row_count, checksum, null_rate,
duration_ms). A detector returns Anomaly rows (signal_id, anomaly_type, source_agent,
run_id, model_name, severity, confidence, ts, details) plus its own columns.
"""

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.keys import details_json, stable_id
from tidewatch.functions.severity import zscore_severity
from tidewatch.operators import running

AGENT = "ingestion_monitor"
ANOMALY_COLUMNS = ["signal_id", "anomaly_type", "source_agent", "run_id", "model_name",
                   "severity", "confidence", "ts", "details"]


def ingestion_stage_only(signals: DataFrame) -> DataFrame:
    return signals.filter(F.col("stage") == "ingestion")


def _anomaly(df: DataFrame, kind: str, tag: str, severity: Column, confidence: Column,
             details: Column, extra: list) -> DataFrame:
    return df.select(
        stable_id(F.lit(tag), "event_id").alias("signal_id"),
        F.lit(kind).alias("anomaly_type"), F.lit(AGENT).alias("source_agent"),
        "run_id", F.col("source").alias("model_name"), severity.alias("severity"),
        confidence.cast("double").alias("confidence"), "ts", details.alias("details"), *extra)


# The explanations that messages carry.
ZERO_ROWS = ("Zero rows ingested. Pipeline completed without error but produced no data. Possible API failure, empty feed, "
             "or upstream source outage.")
OTHER_CHECKSUM = ("Same source and partition produced different checksums. Possible causes: duplicate ingestion, data mutation, "
                  "idempotency failure.")


def zero_row_anomalies(signals: DataFrame) -> DataFrame:
    """A finished load without rows is CRITICAL; an unknown count is not checked."""
    return _anomaly(signals.filter(F.col("row_count") == 0), "row_count_anomaly", "zero",
                    F.lit("CRITICAL"), F.lit(1.0), details_json(
                        row_count=F.col("row_count"), interpretation=F.lit(ZERO_ROWS)), [])


def _counted() -> Column:
    return F.when(F.col("row_count") > 0, F.col("row_count"))


def running_baseline(
    signals: DataFrame, chunk_seconds: int = running.DAY, stored: DataFrame | None = None,
) -> DataFrame:
    """Per signal: n, mean and sample deviation of the source's earlier positive counts."""
    return running.running_stats(signals, ["source"], "ts", "event_id", _counted(),
                                 chunk_seconds, stored)


def baseline_table(signals: DataFrame) -> DataFrame:
    """Current baseline per (model, source, metric); a single value has deviation 0."""
    return (signals.filter(F.col("row_count") > 0)
            .groupBy("source")
            .agg(F.avg("row_count").alias("mean"),
                 F.coalesce(F.stddev_samp("row_count"), F.lit(0.0)).alias("std_dev"),
                 F.count(F.lit(1)).alias("sample_count"))
            .select(F.col("source").alias("model_name"), "source",
                    F.lit("row_count").alias("metric"), "mean", "std_dev", "sample_count"))


def merge_baselines(stored: DataFrame, signals: DataFrame) -> DataFrame:
    """Folds new signals into stored baselines without reading the old signals again."""
    keys = ["model_name", "source", "metric"]
    new = baseline_table(signals).select(
        *keys, F.col("mean").alias("_bm"), F.col("std_dev").alias("_bs"),
        F.col("sample_count").alias("_bn"))
    both = stored.join(new, keys, "full_outer")
    na = F.coalesce("sample_count", F.lit(0))
    nb = F.coalesce("_bn", F.lit(0))
    ma, mb = F.coalesce("mean", F.lit(0.0)), F.coalesce("_bm", F.lit(0.0))
    n = na + nb
    delta = mb - ma
    m2 = (F.coalesce("std_dev", F.lit(0.0)) ** 2 * F.greatest(na - 1, F.lit(0))
          + F.coalesce("_bs", F.lit(0.0)) ** 2 * F.greatest(nb - 1, F.lit(0))
          + delta * delta * na * nb / n)
    return both.select(
        *keys, ((ma * na + mb * nb) / n).alias("mean"),
        F.when(n > 1, F.sqrt(m2 / F.nullif(n - 1, F.lit(0)))).otherwise(0.0).alias("std_dev"),
        n.alias("sample_count"))


def z_scores(baselined: DataFrame, value: str = "row_count", threshold: float = 2.5) -> DataFrame:
    """z of the value against its baseline; no score when the baseline does not vary."""
    z = F.when(F.col("baseline_std") != 0,
               (F.col(value) - F.col("baseline_mean")) / F.nullif(F.col("baseline_std"), F.lit(0.0)))
    return (baselined.withColumn("z_score", z)
            .withColumn("is_anomalous", F.coalesce(F.abs("z_score") > threshold, F.lit(False))))


def _scored_anomalies(scored: DataFrame, value: str, kind: str, tag: str,
                      threshold: float, min_samples: int, extra: list) -> DataFrame:
    z = F.col("z_score")
    confidence = F.round(F.least(F.lit(1.0), F.abs(z) / (2 * threshold)), 4)
    details = details_json(
        **{value: F.col(value)}, baseline_mean=F.round("baseline_mean", 2),
        baseline_std_dev=F.round("baseline_std", 2), z_score=F.round(z, 4),
        threshold=F.lit(float(threshold)), sample_count=F.col("baseline_n"))
    hits = scored.filter((F.col("baseline_n") >= min_samples) & F.col("is_anomalous"))
    return _anomaly(hits, kind, tag, zscore_severity(z), confidence, details, [
        *extra, F.col(value), "baseline_mean", F.col("baseline_std").alias("baseline_std_dev"),
        "z_score", F.col("baseline_n").alias("sample_count")])


def row_count_anomalies(
    signals: DataFrame, threshold: float = 2.5, min_samples: int = 3,
    chunk_seconds: int = running.DAY, stored: DataFrame | None = None,
) -> DataFrame:
    """Counts more than `threshold` deviations off the source's own history."""
    scored = z_scores(running_baseline(signals, chunk_seconds, stored), threshold=threshold)
    return _scored_anomalies(scored.filter(F.col("row_count") != 0), "row_count",
                             "row_count_anomaly", "rows", threshold, min_samples, [])


def checksum_mismatches(signals: DataFrame, chunk_seconds: int = 3600,
                        last_seen: DataFrame | None = None) -> DataFrame:
    """A source publishing the same day again with another checksum.

    Compared with the previous known checksum of (source, day). `last_seen` (source,
    partition_date, checksum, ts) holds reference points from before these signals.
    """
    known = (signals.filter(F.col("checksum").isNotNull())
             .withColumn("partition_date", F.date_format("ts", "yyyy-MM-dd")))
    keys = ["source", "partition_date"]
    compared = running.previous_value(known, keys, "ts", "event_id", "checksum",
                                      "previous_checksum", chunk_seconds)
    if last_seen is not None:
        compared = (compared.join(
            last_seen.select(*keys, F.col("checksum").alias("_seen")), keys, "left")
            .withColumn("previous_checksum", F.coalesce("previous_checksum", "_seen")))
    return _mismatches(compared)


def _mismatches(compared: DataFrame) -> DataFrame:
    hits = compared.filter(F.col("previous_checksum") != F.col("checksum"))
    return _anomaly(hits, "checksum_mismatch", "checksum", F.lit("HIGH"), F.lit(1.0), details_json(
        source=F.col("source"), partition_date=F.col("partition_date"),
        previous_checksum=F.col("previous_checksum"), current_checksum=F.col("checksum"),
        interpretation=F.lit(OTHER_CHECKSUM)),
        ["partition_date", "previous_checksum", F.col("checksum").alias("current_checksum")])


def ingestion_anomalies(
    signals: DataFrame, threshold: float = 2.5, chunk_seconds: int = running.DAY,
    stored: DataFrame | None = None, last_seen: DataFrame | None = None,
) -> DataFrame:
    """All checks of finished loads; one signal may give a count and a checksum row."""
    checks = [zero_row_anomalies(signals),
              row_count_anomalies(signals, threshold, chunk_seconds=chunk_seconds, stored=stored),
              checksum_mismatches(signals, last_seen=last_seen)]
    first, *rest = [c.select(*ANOMALY_COLUMNS) for c in checks]
    for other in rest:
        first = first.unionByName(other)
    return first


def loaded_anomalies(known: DataFrame, threshold: float = 2.5, min_samples: int = 3) -> DataFrame:
    """The same checks of signals that carry what was known before each: baseline_n, baseline_mean, baseline_std, partition_date
    and previous_checksum."""
    scored = z_scores(known, threshold=threshold).filter(F.col("row_count") != 0)
    return (zero_row_anomalies(known).select(*ANOMALY_COLUMNS)
            .unionByName(_scored_anomalies(scored, "row_count", "row_count_anomaly", "rows", threshold, min_samples, []).select(*ANOMALY_COLUMNS))
            .unionByName(_mismatches(known).select(*ANOMALY_COLUMNS)))


def rolling_baseline(signals: DataFrame, days: int = 7, chunk_seconds: int = running.DAY) -> DataFrame:
    """Like running_baseline, over the previous `days` days only.

    Each counted signal enters the running sums one second after its time and leaves
    them `days` later, so a window moves in O(1) per row however many rows it holds.
    Sums of whole numbers are exact: no drift, and deviation 0 is exactly 0.
    """
    width = days * running.DAY
    at = F.unix_seconds("ts")
    amount = _counted()
    big = "decimal(38,0)"

    def delta(when, sign):
        return (signals.filter(F.col("row_count") > 0).select(
            F.lit(None).cast("struct<" + ",".join(
                f"{f.name}:{f.dataType.simpleString()}" for f in signals.schema.fields) + ">").alias("_row"),
            F.col("source").alias("_source"), when.alias("_at"), F.lit(0).alias("_kind"),
            F.lit(sign).cast("bigint").alias("_dn"),
            (amount * sign).cast(big).alias("_dx"),
            (amount.cast("decimal(19,0)") * amount.cast("decimal(19,0)") * sign).cast(big).alias("_dxx")))

    asks = signals.select(
        F.struct(*signals.columns).alias("_row"), F.col("source").alias("_source"),
        at.alias("_at"), F.lit(1).alias("_kind"), F.lit(0).cast("bigint").alias("_dn"),
        F.lit(0).cast(big).alias("_dx"), F.lit(0).cast(big).alias("_dxx"))
    clock = asks.unionByName(delta(at + 1, 1)).unionByName(delta(at + width + 1, -1))
    summed = running.running_sums(clock, ["_source"], "_at", ["_kind"],
                                  ["_dn", "_dx", "_dxx"], chunk_seconds)
    n, x, xx = F.col("_dn_run"), F.col("_dx_run"), F.col("_dxx_run")
    spread = (n.cast("decimal(12,0)") * xx - x * x).cast("double")
    std = (F.when(n == 1, 0.0)
           .when(n > 1, F.sqrt(spread / F.nullif(n * (n - 1), F.lit(0)).cast("double"))))
    return summed.filter(F.col("_kind") == 1).select(
        "_row.*", n.alias("baseline_n"),
        (x.cast("double") / F.nullif(n, F.lit(0))).alias("baseline_mean"), std.alias("baseline_std"))


def to_long_metrics(signals: DataFrame, metrics: list) -> DataFrame:
    """(event_id, source, run_id, ts, metric, value), one row per non-NULL metric."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                      for m in metrics])
    return (signals.select("event_id", "source", "run_id", "ts", F.inline(pairs))
            .filter(F.col("value").isNotNull()))


def metric_anomalies(long: DataFrame, threshold: float = 2.5, min_samples: int = 3,
                     chunk_seconds: int = running.DAY) -> DataFrame:
    """The z-score check for any metric, each with its own baseline per source.

    Of `row_count` only positive values are counted, and zero, which `zero_row_anomalies` reports, is not scored.
    """
    empty = (F.col("metric") == "row_count") & (F.col("value") <= 0)
    based = running.running_stats(long, ["source", "metric"], "ts", "event_id",
                                  F.when(~empty, F.col("value")), chunk_seconds)
    scored = z_scores(based, "value", threshold).filter(~((F.col("metric") == "row_count") & (F.col("value") == 0)))
    found = _scored_anomalies(scored, "value", "row_count_anomaly", "metric",
                              threshold, min_samples, ["metric"])
    return found.withColumn("signal_id", stable_id("signal_id", "metric"))


def freshness_violations(signals: DataFrame, as_of: Column, max_age_seconds: int) -> DataFrame:
    """Sources whose latest signal is older than allowed at `as_of`."""
    latest = signals.groupBy("source").agg(
        F.max(F.struct("ts", "event_id", "run_id")).alias("last"))
    aged = (latest.select("source", "last.*")
            .withColumn("age_seconds", F.unix_seconds(as_of) - F.unix_seconds("ts"))
            .filter(F.col("age_seconds") > max_age_seconds))
    severity = F.when(F.col("age_seconds") >= 2 * max_age_seconds, "HIGH").otherwise("MEDIUM")
    return _anomaly(aged, "freshness_violation", "fresh", severity, F.lit(1.0),
                    details_json(age_seconds=F.col("age_seconds"),
                                 max_age_seconds=F.lit(max_age_seconds)), ["age_seconds"])


def arrival_latency(signals: DataFrame, factor: float = 3.0, min_gaps: int = 3,
                    chunk_seconds: int = running.DAY) -> DataFrame:
    """Signals that came later than `factor` times the source's mean earlier gap."""
    seen = running.previous_value(signals, ["source"], "ts", "event_id", "ts", "_before", chunk_seconds)
    gaps = seen.withColumn("gap_seconds", F.unix_seconds("ts") - F.unix_seconds("_before"))
    based = running.running_stats(gaps, ["source"], "ts", "event_id", F.col("gap_seconds"), chunk_seconds)
    late = based.filter((F.col("baseline_n") >= min_gaps)
                        & (F.col("gap_seconds") > factor * F.col("baseline_mean")))
    severity = (F.when(F.col("gap_seconds") >= 2 * factor * F.col("baseline_mean"), "HIGH")
                .otherwise("MEDIUM"))
    return _anomaly(late, "freshness_violation", "late", severity, F.lit(1.0),
                    details_json(gap_seconds=F.col("gap_seconds"),
                                 mean_gap_seconds=F.round("baseline_mean", 2)),
                    ["gap_seconds", F.col("baseline_mean").alias("mean_gap_seconds")])
