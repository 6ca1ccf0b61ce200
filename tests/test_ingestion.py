import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.severity import zscore_severity
from tidewatch.operators import ingestion, running

SIGNAL = ("event_id string, stage string, source string, run_id string, ts timestamp, row_count bigint, "
          "checksum string, null_rate double, duration_ms bigint")
BASELINE = "model_name string, source string, metric string, mean double, std_dev double, sample_count bigint"
START = dt.datetime(2026, 4, 22, 3)


def signals(spark, rows):
    """rows of (source, minutes, row_count, checksum)"""
    return spark.createDataFrame(
        [(f"e{i:06d}", "ingestion", s, f"run-{i:03d}", START + dt.timedelta(minutes=m), n, c, None, 1200)
         for i, (s, m, n, c) in enumerate(rows)], SIGNAL)


def stored(spark, mean=100000.0, std=5000.0, n=10):
    return spark.createDataFrame([("orders_api", "orders_api", "row_count", mean, std, n)], BASELINE)


@pytest.mark.parametrize("count, baseline, expected", [
    (102000, (100000.0, 5000.0, 10), None),
    (80000, (100000.0, 5000.0, 10), ("HIGH", -4.0, 0.8)),
    (70000, (100000.0, 5000.0, 10), ("CRITICAL", -6.0, 1.0)),
    (86000, (100000.0, 5000.0, 10), ("MEDIUM", -2.8, 0.56)),
    (50000, (100000.0, 5000.0, 2), None),
    (99000, (100000.0, 0.0, 10), None),
])
def test_count_against_a_stored_baseline(spark, count, baseline, expected):
    found = ingestion.row_count_anomalies(
        signals(spark, [("orders_api", 0, count, None)]), stored=stored(spark, *baseline)).collect()
    if expected is None:
        assert found == []
    else:
        assert [(a.severity, round(a.z_score, 4), a.confidence) for a in found] == [expected]
        assert found[0].model_name == "orders_api" and found[0].anomaly_type == "row_count_anomaly"


def test_no_baseline_no_anomaly(spark):
    assert ingestion.row_count_anomalies(signals(spark, [("a", 0, 50000, None)])).count() == 0


def test_zero_rows_are_critical_and_leave_the_baseline_alone(spark):
    df = signals(spark, [("a", i, n, None) for i, n in enumerate([100, 102, 98, 0, 150, 101])] + [("a", 9, None, None)])
    zero = ingestion.zero_row_anomalies(df).collect()
    assert [(z.severity, z.confidence, z.run_id) for z in zero] == [("CRITICAL", 1.0, "run-003")]
    based = {r.run_id: r for r in ingestion.running_baseline(df).collect()}
    assert [based[f"run-{i:03d}"].baseline_n for i in range(7)] == [0, 1, 2, 3, 3, 4, 5]
    assert based["run-001"].baseline_std == 0.0
    assert based["run-004"].baseline_std == pytest.approx(2.0)
    # an unknown count is neither zero nor scored
    assert ingestion.ingestion_anomalies(df).filter("run_id = 'run-006'").count() == 0


def test_negative_counts_are_scored_but_not_learned(spark):
    df = signals(spark, [("a", i, n, None) for i, n in enumerate([100, 102, 98, -50, 100])])
    found = {r.run_id for r in ingestion.row_count_anomalies(df).collect()}
    assert "run-003" in found
    assert {r.run_id: r.baseline_n for r in ingestion.running_baseline(df).collect()}["run-004"] == 3


@pytest.mark.parametrize("chunk", [60, 3600, 86400 * 30])
def test_running_baseline_equals_one_pass_statistics(spark, chunk):
    rng = np.random.default_rng(7)
    rows, expected = [], {}
    for source, scale in (("hot", 1e9), ("cold", 50), ("flat", 0)):
        minutes = np.sort(rng.integers(0, 4000, 150))
        values = (np.full(150, 7) if source == "flat" else rng.integers(-5, 100, 150) + int(scale))
        values[rng.integers(0, 150, 20)] = 0
        rows += [(source, int(m), int(v), None) for m, v in zip(minutes, values)]
    df = signals(spark, rows)
    seen = {}
    for i, (source, _, value, _) in enumerate(rows):
        past = seen.setdefault(source, [])
        expected[f"e{i:06d}"] = (len(past), np.mean(past) if past else None,
                                 None if not past else 0.0 if len(past) == 1 else np.std(past, ddof=1))
        if value > 0:
            past.append(value)
    for r in ingestion.running_baseline(df, chunk).collect():
        n, mean, std = expected[r.event_id]
        assert r.baseline_n == n
        assert r.baseline_mean == (None if mean is None else pytest.approx(mean, rel=1e-12))
        assert r.baseline_std == (None if std is None else pytest.approx(std, rel=1e-6, abs=1e-9))
        if r.source == "flat" and n > 0:
            assert r.baseline_std == 0.0  # exactly: a constant history must give no score


def test_merge_equals_one_pass(spark):
    values = [10, 20, 30, 40, 50, 0, 61]
    df = signals(spark, [("a", i, v, None) for i, v in enumerate(values)] + [("b", 1, 5, None)])
    whole = {r.source: r for r in ingestion.baseline_table(df).collect()}
    old = ingestion.baseline_table(df.filter("run_id < 'run-003'"))
    merged = {r.source: r for r in ingestion.merge_baselines(old, df.filter("run_id >= 'run-003'")).collect()}
    assert set(merged) == {"a", "b"}
    for key in merged:
        assert merged[key].sample_count == whole[key].sample_count
        assert merged[key].mean == pytest.approx(whole[key].mean)
        assert merged[key].std_dev == pytest.approx(whole[key].std_dev)
    first_five = ingestion.baseline_table(df.filter("run_id < 'run-005'")).filter("source = 'a'").first()
    assert (first_five.mean, first_five.sample_count) == (30.0, 5)
    assert first_five.std_dev == pytest.approx(np.std([10, 20, 30, 40, 50], ddof=1))


@pytest.mark.parametrize("z, expected", [
    (2.6, "MEDIUM"), (-2.6, "MEDIUM"), (3.6, "HIGH"), (-3.6, "HIGH"), (5.1, "CRITICAL"), (-5.1, "CRITICAL"),
    (2.0, "LOW"), (2.5, "MEDIUM"), (3.5, "HIGH"), (5.0, "CRITICAL")])
def test_severity_by_z(spark, z, expected):
    assert spark.range(1).select(zscore_severity(F.lit(z))).first()[0] == expected


@pytest.mark.parametrize("chunk", [60, 86400])
def test_checksums(spark, chunk):
    day = 24 * 60
    df = signals(spark, [
        ("a", 0, 1, "abc123"), ("a", 60, 1, "abc123"), ("a", 120, 1, None), ("a", 180, 1, "xyz999"),
        ("a", 200, 1, "xyz999"), ("a", day, 1, "other"), ("b", 0, 1, "q"), ("b", 1, 1, "r"), ("b", 2, 1, "q")])
    found = {(r.run_id, r.previous_checksum, r.current_checksum, r.severity, r.confidence)
             for r in ingestion.checksum_mismatches(df, chunk).collect()}
    assert found == {("run-003", "abc123", "xyz999", "HIGH", 1.0), ("run-007", "q", "r", "HIGH", 1.0),
                     ("run-008", "r", "q", "HIGH", 1.0)}


@pytest.mark.parametrize("chunk", [3600, 86400])
def test_rolling_baseline_equals_brute_force(spark, chunk):
    rng = np.random.default_rng(3)
    rows = [(s, int(m), int(v), None) for s in ("x", "y")
            for m, v in zip(np.sort(rng.integers(0, 20 * 24 * 60, 120)), rng.integers(0, 1000, 120))]
    df = signals(spark, rows)
    for r in ingestion.rolling_baseline(df, 2, chunk).collect():
        i = int(r.event_id[1:])
        source, minute = rows[i][:2]
        past = [v for s, m, v, _ in rows if s == source and v > 0 and 0 < minute - m <= 2 * 24 * 60]
        assert r.baseline_n == len(past)
        if past:
            assert r.baseline_mean == pytest.approx(np.mean(past))
            assert r.baseline_std == pytest.approx(np.std(past, ddof=1) if len(past) > 1 else 0.0)


def test_previous_value_crosses_chunks(spark):
    df = signals(spark, [("a", m, m, None) for m in (0, 1, 90, 5000, 5001)])
    got = running.previous_value(df, ["source"], "ts", "event_id", "row_count", "prev", 3600).orderBy("ts")
    assert [r.prev for r in got.collect()] == [None, 0, 1, 90, 5000]


def test_freshness_and_latency(spark):
    df = signals(spark, [("a", 0, 1, None), ("b", 600, 1, None), ("c", 700, 1, None)])
    as_of = F.lit(START + dt.timedelta(minutes=720)).cast("timestamp")
    found = {r.model_name: (r.severity, r.age_seconds) for r in
             ingestion.freshness_violations(df, as_of, 3600).collect()}
    assert found == {"a": ("HIGH", 43200), "b": ("HIGH", 7200)}
    late = ingestion.arrival_latency(signals(spark, [("a", m, 1, None) for m in (0, 10, 20, 30, 61, 71)]), 3.0)
    assert [(r.run_id, r.gap_seconds, r.mean_gap_seconds) for r in late.collect()] == [("run-004", 1860, 600.0)]


def test_details_have_the_keys_of_the_messages(spark):
    import json
    df = signals(spark, [("a", i, n, c) for i, (n, c) in enumerate([(10, "x"), (11, "x"), (9, "x"), (10, "x"), (90, "x"), (0, "y")])])
    keys = lambda found: [sorted(json.loads(r.details)) for r in found.collect()]
    assert keys(ingestion.row_count_anomalies(df)) == [
        ["baseline_mean", "baseline_std_dev", "row_count", "sample_count", "threshold", "z_score"]]
    assert keys(ingestion.zero_row_anomalies(df)) == [["interpretation", "row_count"]]
    assert keys(ingestion.checksum_mismatches(df)) == [
        ["current_checksum", "interpretation", "partition_date", "previous_checksum", "source"]]
