import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.severity import failure_count_severity
from tidewatch.operators import quality
from tidewatch.sources import artifacts

T0 = dt.datetime(2026, 1, 1)
HISTORY = ("model_name string, test_name string, run_id string, passed boolean, failure_rate double, "
           "run_at timestamp, position int")


def result(name, model, column, status, failures, severity=None):
    return {"unique_id": f"test.shop.{name}_{model}_{column}", "status": status, "failures": failures,
            "execution_time": 0.1, "message": None, "node": {
                "name": f"{name}_{model}_{column}", "resource_type": "test",
                "depends_on": {"nodes": ["source.shop.raw", f"model.shop.{model}"]},
                "test_metadata": {"name": name, "kwargs": {"column_name": column}},
                "config": {"severity": "error", "meta": {"agent_severity": severity, "oncall_team": "x"}}}}


@pytest.fixture(scope="module")
def tests(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("artifact")
    document = {"metadata": {"dbt_version": "1.7", "generated_at": "2025-11-30T21:05:09Z"}, "results": [
        result("in_range", "tide_daily", "height", "fail", 77, "critical"),
        result("in_range", "tide_daily", "gauge", "pass", 0),
        result("relationships", "port_calls", "berth", "fail", 23456),
        {"unique_id": "model.shop.tide_daily", "status": "success", "failures": None},
        {"unique_id": "test.shop.bare", "status": "warn", "failures": None}]}
    (folder / "run_results.json").write_text(json.dumps(document, indent=2))
    return artifacts.read_test_results(spark, str(folder))


def test_artifact_rows(tests):
    got = {(r.test_name, r.model_name, r.column_name, r.status, r.failures, r.agent_severity) for r in tests.collect()}
    assert got == {("in_range", "tide_daily", "gauge", "pass", 0, None),
                   ("in_range", "tide_daily", "height", "fail", 77, "critical"),
                   ("relationships", "port_calls", "berth", "fail", 23456, None),
                   ("unknown", "unknown", None, "warn", 0, None)}
    assert {r.run_id for r in tests.collect()} == {"dbt-run-20251130210509"}


def test_scoring_of_an_artifact(tests):
    scores = quality.flakiness(quality.test_history(tests))
    scored = quality.test_severity(quality.failed_tests(tests), scores)
    found = {r.model_name: (r.severity, r.confidence, r.total_failed_tests) for r in
             quality.quality_anomalies(scored).collect()}
    assert found == {"tide_daily": ("CRITICAL", 0.95, 1), "port_calls": ("HIGH", 0.95, 1)}
    summary = quality.run_summary(tests).first()
    assert (summary.total_tests, summary.failed_tests, summary.n_signals) == (4, 2, 2)


# fixed values: the limits of the failure counts
@pytest.mark.parametrize("failures, expected", [
    (1, "LOW"), (99, "LOW"), (100, "MEDIUM"), (9999, "MEDIUM"), (10000, "HIGH"), (99999, "HIGH"), (100000, "CRITICAL")])
def test_severity_by_count(spark, failures, expected):
    assert spark.range(1).select(failure_count_severity(F.lit(failures))).first()[0] == expected


def history(spark, flags):
    return spark.createDataFrame(
        [("m", "t", f"r{i:03d}", p, 0.0, T0 + dt.timedelta(days=i), 0) for i, p in enumerate(flags)], HISTORY)


@pytest.mark.parametrize("runs, fails, rate, flaky, new", [
    (15, 0, 0.0, False, False), (10, 2, 0.2, False, False), (10, 3, 0.3, True, False), (3, 2, 2 / 3, False, True)])
def test_flakiness_limits(spark, runs, fails, rate, flaky, new):
    last = (quality.flakiness(history(spark, [i >= fails for i in range(runs)])).orderBy(F.desc("run_id")).first())
    assert (last.total_runs, last.failure_count, last.is_flaky, last.is_new_test) == (runs, fails, flaky, new)
    assert last.flakiness_rate == pytest.approx(rate)


@pytest.mark.parametrize("chunk_days", [1, 3, 30, 1000])
def test_flakiness_equals_last_twenty(spark, chunk_days):
    rng = np.random.default_rng(5)
    rows = []
    for key in ("a", "b"):
        for run, day in enumerate(np.sort(rng.integers(0, 200, 60))):
            for position in range(rng.integers(1, 4)):
                rows.append(("m", key, f"r{run:03d}", bool(rng.random() > 0.3), 0.0,
                             T0 + dt.timedelta(days=int(day), seconds=run), position))
    df = spark.createDataFrame(rows, HISTORY)
    got = {(r.test_name, r.run_id): (r.total_runs, r.failure_count) for r in
           quality.flakiness(df, chunk_seconds=chunk_days * 86400).collect()}
    want = {}
    for key in ("a", "b"):
        ordered = sorted((r for r in rows if r[1] == key), key=lambda r: (r[5], r[6]))
        for i, r in enumerate(ordered):
            recent = ordered[max(0, i - 19):i + 1]
            want[(key, r[2])] = (len(recent), sum(not x[3] for x in recent))
    assert got == want


def test_flaky_tests_are_capped_at_medium(spark):
    failed = spark.createDataFrame(
        [("r", "m", f"t{i}", n, label) for i, (n, label) in enumerate(
            [(10000, None), (1, None), (5, "critical"), (5, "Critical"), (10000, None), (10000, None)])],
        "run_id string, model_name string, test_name string, failures bigint, agent_severity string")
    scores = spark.createDataFrame(
        [("r", "m", f"t{i}", i in (0, 1, 2, 3), i == 4) for i in range(5)],
        "run_id string, model_name string, test_name string, is_flaky boolean, is_new_test boolean")
    got = {r.test_name: (r.severity, r.is_flaky, r.is_new_test) for r in quality.test_severity(failed, scores).collect()}
    assert got == {"t0": ("MEDIUM", True, False), "t1": ("LOW", True, False), "t2": ("MEDIUM", True, False),
                   "t3": ("LOW", True, False), "t4": ("HIGH", False, True), "t5": ("HIGH", False, True)}


def test_all_flaky_lowers_confidence(spark):
    scored = spark.createDataFrame(
        [("r", T0, "m", "LOW", True), ("r", T0, "k", "HIGH", False), ("r", T0, "k", "LOW", True)],
        "run_id string, run_at timestamp, model_name string, severity string, is_flaky boolean")
    got = {r.model_name: (r.confidence, r.severity, r.genuine_failures, r.flaky_failures)
           for r in quality.quality_anomalies(scored).collect()}
    assert got == {"m": (0.5, "LOW", 0, 1), "k": (0.95, "HIGH", 1, 1)}


def test_table_tests(spark):
    df = spark.createDataFrame(
        [("r", 1, "a", 5.0), ("r", 1, None, 11.0), ("r", None, "b", None), ("r", None, "z", -1.0), ("q", 1, "a", 0.0)],
        "run string, k int, s string, v double")
    run = F.col("run")
    one = lambda out: {r.run_id: (r.failures, r.status) for r in out.collect()}
    assert one(quality.test_not_null(df, run, "s")) == {"r": (1, "fail"), "q": (0, "pass")}
    assert one(quality.test_unique(df, run, ["k"])) == {"r": (1, "fail"), "q": (0, "pass")}
    assert one(quality.test_accepted_values(df, run, "s", ["a", "b"])) == {"r": (1, "fail"), "q": (0, "pass")}
    assert one(quality.test_between(df, run, "v", 0, 10)) == {"r": (2, "fail"), "q": (0, "pass")}
    assert one(quality.test_between(df, run, "v", lo=0)) == {"r": (1, "fail"), "q": (0, "pass")}


def test_bare_results_find_their_model_in_the_lineage(spark, tests):
    edges = spark.createDataFrame([("model.shop.b", "test.shop.bare"), ("model.shop.a", "test.shop.bare"),
                                   ("snapshot.shop.x", "test.shop.bare")], "parent string, child string")
    got = {r.unique_id: r.model_name for r in artifacts.resolve_test_models(tests, edges).collect()}
    assert got["test.shop.bare"] == "a"
    assert got["test.shop.relationships_port_calls_berth"] == "port_calls"


def test_histories_can_be_split_by_column(tests):
    names = {r.test_name for r in quality.per_column(tests).collect()}
    assert {"in_range:gauge", "in_range:height"} <= names


def test_messages_list_the_failing_tests(tests):
    scored = quality.test_severity(quality.failed_tests(tests), quality.flakiness(quality.test_history(tests)))
    packed = quality.with_test_lists(quality.quality_anomalies(scored), quality.quality_anomaly_tests(scored))
    details = {r.model_name: json.loads(r.details) for r in packed.collect()}
    assert details["tide_daily"]["total_failed_tests"] == 1
    assert {k: details["tide_daily"]["tests"][0][k] for k in ("test_name", "column", "failures", "severity", "is_flaky", "is_new_test")} == {
        "test_name": "in_range", "column": "height", "failures": 77, "severity": "CRITICAL", "is_flaky": False, "is_new_test": True}
