import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import remediate, reports

SCHEMA = ("incident_id string, run_id string, severity string, root_cause string, primary_model string, "
          "pause_targets array<string>, n_downstream bigint, n_dashboards bigint, sla_impact string, llm_hypothesis string")


def incident(spark, severity, cause="row_count_anomaly", targets=(), **more):
    return spark.createDataFrame(
        [("i1", "run-1", severity, cause, "tide_daily", list(targets), more.get("down", 0), more.get("dash", 0),
          more.get("sla"), more.get("hypothesis"))], SCHEMA)


def plan(spark, severity, cause="row_count_anomaly", targets=(), mode="supervised"):
    rows = remediate.plan_actions(incident(spark, severity, cause, targets), mode).orderBy("action_seq").collect()
    assert [r.action_seq for r in rows] == list(range(len(rows)))
    return rows


@pytest.mark.parametrize("severity", ["LOW", "MEDIUM"])
def test_small_incidents_only_notify(spark, severity):
    assert [r.action_type for r in plan(spark, severity)] == ["notify_slack"]


@pytest.mark.parametrize("mode, approval", [("supervised", True), ("full_autonomy", False)])
def test_high_quarantines(spark, mode, approval):
    rows = plan(spark, "HIGH", mode=mode)
    assert [(r.action_type, r.requires_approval) for r in rows] == [
        ("notify_slack", False), ("quarantine_partition", approval)]
    assert rows[1].reason == "row_count_anomaly detected — severity HIGH" and rows[1].target == "tide_daily"


def test_critical(spark):
    rows = plan(spark, "CRITICAL")
    assert [(r.action_type, r.requires_approval, r.full_refresh) for r in rows] == [
        ("notify_slack", False, None), ("quarantine_partition", True, None), ("trigger_backfill", True, False),
        ("create_pagerduty", False, None)]
    assert plan(spark, "CRITICAL", "checksum_mismatch")[2].full_refresh is True


def test_critical_drift_pauses_at_most_five(spark):
    rows = plan(spark, "CRITICAL", "schema_drift", ["a", "b"])
    assert [r.action_type for r in rows] == ["notify_slack", "quarantine_partition", "pause_downstream_dags",
                                             "pause_downstream_dags", "trigger_backfill", "create_pagerduty"]
    assert [r.target for r in rows[2:4]] == ["a", "b"] and rows[4].full_refresh is True
    many = plan(spark, "CRITICAL", "schema_drift", [f"m{i}" for i in range(10)])
    assert sum(r.action_type == "pause_downstream_dags" for r in many) == 5


@pytest.mark.parametrize("mode, expected", [
    ("shadow", ["logged"] * 4), ("alert_only", ["executed", "skipped", "skipped", "skipped"]),
    ("supervised", ["executed", "skipped", "skipped", "executed"]), ("full_autonomy", ["executed"] * 4)])
def test_dispositions(spark, mode, expected):
    actions = remediate.plan_actions(incident(spark, "CRITICAL"), mode)
    got = remediate.action_disposition(actions, mode).orderBy("action_seq").collect()
    assert [r.disposition for r in got] == expected


def test_incident_text(spark):
    df = incident(spark, "HIGH", down=3, dash=1, sla="SLA at risk: d (1h)", hypothesis="x" * 400)
    row = remediate.incident_fields(df).first()
    assert row.blast_summary == "3 models, 1 dashboards, SLA: SLA at risk: d (1h)"
    assert row.alert_text == (
        "🔴 *[HIGH] Data Pipeline Incident*\n*Root cause:* `row_count_anomaly`\n*Model:* `tide_daily` | *Run:* `run-1`\n"
        "*Blast radius:* 3 models, 1 dashboards, SLA: SLA at risk: d (1h)\n*Hypothesis:* " + "x" * 300 + "\n")
    bare = remediate.incident_fields(df.drop("n_downstream", "llm_hypothesis")).first()
    assert bare.blast_summary == "blast radius unknown" and "Hypothesis" not in bare.alert_text


def test_quarantine_keeps_every_row(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "k string, v int")
    clean, held = remediate.quarantine_split(df, ["k"], spark.createDataFrame([("a",), ("a",)], "k string"))
    assert {(r.k, r.v) for r in held.collect()} == {("a", 1), ("a", 2)}
    assert {(r.k, r.v) for r in clean.collect()} == {("b", 1), (None, 1)}


def test_log_and_reports(spark):
    disposed = remediate.action_disposition(
        remediate.plan_actions(incident(spark, "CRITICAL"), "full_autonomy"), "full_autonomy")
    at = dt.datetime(2026, 1, 1)
    results = spark.createDataFrame([("i1", 0, True, None), ("i1", 1, False, "boom")],
                                    "incident_id string, action_seq int, success boolean, error_message string")
    log = remediate.action_log(disposed, results, F.lit(at).cast("timestamp"))
    got = {r.action_type: (r.success, r.error_message) for r in remediate.incident_actions(log, "i1").collect()}
    assert got == {"notify_slack": (True, None), "quarantine_partition": (False, "boom"),
                   "trigger_backfill": (False, None), "create_pagerduty": (False, None)}
    assert reports.recent_actions(log, 2).count() == 2


def test_reports(spark):
    t = lambda d: dt.datetime(2026, 1, d)
    incidents = spark.createDataFrame(
        [("i1", "schema_drift", "HIGH", "open", t(1)), ("i2", "unknown", "LOW", "resolved", t(2))],
        "incident_id string, root_cause string, severity string, status string, created_at timestamp")
    feedback = spark.createDataFrame(
        [("i1", "tp", t(9)), ("i1", "tp", t(10)), ("i2", "fp", t(1)), ("ix", "fp", t(10))],
        "incident_id string, feedback string, created_at timestamp")
    as_of = F.lit(t(10)).cast("timestamp")
    assert [tuple(r) for r in reports.feedback_report(feedback, incidents, as_of).collect()] == [("schema_drift", "tp", 2)]
    assert [r.incident_id for r in reports.open_incidents(incidents).collect()] == ["i1"]
    beats = spark.createDataFrame([("a", t(1), "alive"), ("a", t(3), "degraded"), ("b", t(1), "alive")],
                                  "agent_name string, ts timestamp, status string")
    assert {r.agent_name: r.status for r in reports.agent_status(beats).collect()} == {"a": "degraded", "b": "alive"}
    expected = spark.createDataFrame([("a",), ("b",), ("c",)], "agent_name string")
    gone = reports.missing_agents(beats, expected, F.lit(t(2)).cast("timestamp"))
    assert {r.agent_name for r in gone.collect()} == {"b", "c"}
    side = lambda rows: spark.createDataFrame(rows, "p string, row_count bigint, checksum string")
    got = reports.reconcile_partitions(side([("x", 3, "1"), ("y", 2, "2")]), side([("x", 3, "1"), ("z", 1, "3")]), ["p"])
    assert {r.p: (r["diff"], r.checksum_equal) for r in got.collect()} == {"x": (0, True), "y": (2, False), "z": (-1, False)}
