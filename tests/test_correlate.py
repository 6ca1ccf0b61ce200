import datetime as dt
import random

import pytest

from tidewatch.operators import correlate

T0 = dt.datetime(2026, 4, 22, 3)
ROW = ("signal_id string, anomaly_type string, source_agent string, run_id string, model_name string, "
       "severity string, confidence double, ts timestamp, details string")


def anomalies(spark, rows):
    """rows of (run, seconds, type, severity, confidence, model)"""
    return spark.createDataFrame(
        [(f"s{i:05d}", t, "x", run, model, sev, conf, T0 + dt.timedelta(seconds=sec), "{}")
         for i, (run, sec, t, sev, conf, model) in enumerate(rows)], ROW)


def simple(run, sec, kind="row_count_anomaly", sev="HIGH", conf=0.9, model="tide_daily"):
    return (run, sec, kind, sev, conf, model)


def brute(rows):
    """Bucket start of each row, one pass per run in time order."""
    opened, out = {}, {}
    for i, row in sorted(enumerate(rows), key=lambda e: (e[1][0], e[1][1])):
        run, sec = row[:2]
        if run not in opened or sec >= opened[run] + 300:
            opened[run] = sec
        out[f"s{i:05d}"] = opened[run]
    return out


def test_buckets_equal_a_plain_loop(spark):
    rnd = random.Random(1)
    rows = [simple("golden", s) for s in (0, 100, 299, 300, 310, 700)]
    for run, span, n in (("dense", 9000, 400), ("sparse", 90000, 120), ("burst", 200, 60), ("micro", 4000, 50),
                         ("one", 1, 1), ("empty-block", 3000, 8)):
        rows += [simple(run, rnd.randrange(span) + (rnd.randrange(1000000) / 1e6 if run == "micro" else 0))
                 for _ in range(n)]
    rows += [simple("edge", 300 * k) for k in range(40)] + [simple("edge2", 299 * k) for k in range(40)]
    got = {r.signal_id: (r.opened_at - T0).total_seconds() for r in
           correlate.signal_buckets(anomalies(spark, rows)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_runs_spread_over_many_partitions(spark, partitions):
    rnd = random.Random(partitions)
    rows = [simple("hot", rnd.randrange(40_000)) for _ in range(1500)] + [simple("hot", 50_000 + rnd.randrange(290)) for _ in range(700)]
    rows += [simple(f"r{i % 7}", rnd.randrange(2000)) for i in range(200)] + [simple("aa", s) for s in (0, 299, 300, 599, 601)]
    rows += [simple("zz", 100_000 * k) for k in range(30)] + [simple(None, 5)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r.signal_id: (r.opened_at - T0).total_seconds() for r in correlate.signal_buckets(anomalies(spark, rows)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute([r for r in rows if r[0] is not None])


def one_bucket(spark, kinds, sev="HIGH", conf=0.9):
    rows = [simple("r", i, k, sev, conf, f"m{i}") for i, k in enumerate(kinds)]
    return correlate.signal_buckets(anomalies(spark, rows))


@pytest.mark.parametrize("kinds, expected", [
    (["checksum_mismatch"], ("checksum_mismatch", 0.9, False)),
    (["schema_drift", "row_count_anomaly"], ("schema_drift", 0.95, False)),
    (["schema_drift", "quality_failure"], ("schema_drift", 0.92, False)),
    (["schema_drift", "row_count_anomaly", "quality_failure"], ("schema_drift", 0.95, False)),
    (["checksum_mismatch", "quality_failure"], ("checksum_mismatch", 0.99, False)),
    (["freshness_violation", "row_count_anomaly"], ("freshness_violation", 0.90, False)),
    (["quality_failure", "freshness_violation"], ("unknown", 0.5, True)),
    (["row_count_anomaly", "row_count_anomaly"], ("unknown", 0.5, True)),
])
def test_rules(spark, kinds, expected):
    got = correlate.correlate(one_bucket(spark, kinds)).collect()
    assert [(r.root_cause, r.confidence, r.needs_llm) for r in got] == [expected]


def test_summary_suppression_and_incidents(spark):
    rows = [simple("a", 0, "schema_drift", "LOW", 0.5, "m"),
            simple("b", 0, "schema_drift", "LOW", 0.5, "m"), simple("b", 9, "quality_failure", "LOW", 0.4, None),
            simple("c", 0, "schema_drift", "LOW", 0.9, "m"),
            simple("d", 0, "quality_failure", "CRITICAL", 0.3, None),
            simple("e", 5, "schema_drift", "LOW", 0.3, ""), simple("e", 7, "row_count_anomaly", "HIGH", 0.95, "k")]
    bucketed = correlate.signal_buckets(anomalies(spark, rows))
    dropped = {r.run_id: r.suppressed for r in correlate.bucket_facts(bucketed).collect()}
    assert dropped == {"a": True, "b": True, "c": False, "d": False, "e": False}
    e = correlate.bucket_summary(bucketed).filter("run_id = 'e'").first()
    assert (e.anomaly_types, e.severity, e.models, e.n_signals) == (
        ["row_count_anomaly", "schema_drift"], "HIGH", ["k"], 2)
    incidents = {r.run_id: (r.root_cause, r.severity, r.primary_model) for r in
                 correlate.confirmed_incidents(bucketed).collect()}
    assert incidents == {"c": ("schema_drift", "LOW", "m"), "d": ("quality_failure", "CRITICAL", "unknown"),
                         "e": ("schema_drift", "HIGH", "unknown")}


@pytest.mark.parametrize("size", [2, 499, 501, 1200])
def test_hypothesis_requests_have_every_signal(spark, size):
    import json
    bucketed = one_bucket(spark, ["row_count_anomaly"] * size) if size < 300 else correlate.signal_buckets(
        anomalies(spark, [simple("r", i / 10, model=f"m{i}") for i in range(size)]))
    rows = correlate.hypothesis_requests(bucketed, correlate.correlate(bucketed))
    assert rows.count() == size and rows.select("bucket_id").distinct().count() == 1
    packed = correlate.packed_requests(rows).collect()
    listed = json.loads(packed[0].signals_json)
    assert (len(packed), packed[0].n_signals, [s["model_name"] for s in listed]) == (1, size, [f"m{i}" for i in range(size)])
    assert all(s["details"] == {} for s in listed)


def test_clock_buckets(spark):
    got = correlate.clock_buckets(anomalies(spark, [simple("r", 299), simple("r", 300)])).orderBy("ts").collect()
    assert [(r.window_start - T0).total_seconds() for r in got] == [0, 300]


def test_enrichment_unites_the_models(spark):
    rows = [simple("r", 0, "schema_drift", "HIGH", 0.9, "a"), simple("r", 1, "row_count_anomaly", "LOW", 0.9, "b")]
    members = spark.createDataFrame(
        [("a", "affected_model", f"x{i}") for i in range(8)] + [("b", "affected_model", "x1"), ("b", "dashboard", "d"),
                                                               ("a", "dashboard", "d"), ("a", "sla_breach", "d (1h)")],
        "model_name string, kind string, member string")
    incidents = correlate.confirmed_incidents(correlate.signal_buckets(anomalies(spark, rows)))
    enriched = correlate.enriched_incidents(incidents, members)
    got = correlate.with_pause_targets(enriched, members).first()
    assert (got.n_downstream, got.n_dashboards, got.n_sla, got.severity_multiplier) == (8, 1, 1, 2.5)
    assert got.severity == "CRITICAL" and got.sla_impact == "SLA at risk: d (1h)"
    assert got.pause_targets == ["x0", "x1", "x2", "x3", "x4"]
    assert correlate.incident_members(incidents, members).count() == 10
