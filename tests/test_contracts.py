import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import contracts

SNAP = ("source string, run_id string, ts timestamp, position int, column_name string, dtype string, "
        "nullable boolean, criticality string, version_hash string")
CONTRACT = "source string, column_name string, dtype string, nullable boolean, criticality string"
T0 = dt.datetime(2026, 1, 1)


def column(name, dtype="VARCHAR", nullable=True, criticality="standard"):
    return (name, dtype, nullable, criticality)


def snapshot(spark, columns, run="r1", source="s"):
    return spark.createDataFrame(
        [(source, run, T0, i, *c, "h") for i, c in enumerate(columns)], SNAP)


def contract(spark, columns, source="s"):
    return spark.createDataFrame([(source, *c) for c in columns], CONTRACT)


@pytest.mark.parametrize("old, new, expected", [
    ([column("order_id"), column("amount"), column("status")], [column("order_id"), column("amount")],
     {("status", "dropped_column", "CRITICAL")}),
    ([column(c) for c in "abcd"], [column("a")],
     {(c, "dropped_column", "CRITICAL") for c in "bcd"}),
    ([column("amount", "INTEGER")], [column("amount", "VARCHAR")], {("amount", "type_changed", "HIGH")}),
    ([column("name", "VARCHAR")], [column("name", " varchar ")], set()),
    ([column("revenue_usd", "FLOAT", True, "critical")], [column("revenue_usd", "INTEGER")],
     {("revenue_usd", "type_changed", "CRITICAL")}),
    ([column("order_id", nullable=False)], [column("order_id")], {("order_id", "nullable_changed", "MEDIUM")}),
    ([column("order_id")], [column("order_id", nullable=False)], set()),
    ([column("user_id", "VARCHAR", False, "critical")], [column("user_id")],
     {("user_id", "nullable_changed", "CRITICAL")}),
    ([column("a", "INT", False)], [column("a", "TEXT", True)], {("a", "type_changed", "HIGH")}),
    ([column("a")], [column("a"), column("b")], {("b", "new_column", "LOW")}),
    ([column("a"), column("b")], [column("b"), column("a")], set()),
])
def test_changes(spark, old, new, expected):
    got = contracts.column_changes(snapshot(spark, new), contract(spark, old))
    assert {(r.column_name, r.change_type, r.severity) for r in got.collect()} == expected


def test_drift_anomaly_lists_changes_in_report_order(spark):
    old = [column("z"), column("a", "INT"), column("b", nullable=False)]
    new = [column("a", "TEXT"), column("b"), column("n1"), column("n2")]
    diff = contracts.schema_diff(snapshot(spark, new), contract(spark, old))
    row = contracts.schema_drift_anomalies(diff, snapshot(spark, new)).first()
    assert row.severity == "CRITICAL" and row.total_changes == 5 and row.ts == T0
    assert row.summary == "Schema drift in 's': 1 dropped column, 1 type changed, 1 nullable changed, 2 new column"
    changes = json.loads(row.details)["changes"]
    assert [c["column"] for c in changes] == ["z", "a", "b", "n1", "n2"]
    assert [set(c) - {"column", "change_type", "severity", "impact"} for c in changes[:4]] == [
        {"contract_type", "criticality"}, {"contract_type", "incoming_type", "criticality"},
        {"contract_nullable", "incoming_nullable", "criticality"}, {"incoming_type", "incoming_nullable"}]
    assert all(c["impact"] == contracts.IMPACT[c["change_type"]] for c in changes)
    one = {"dropped_column": contracts.dropped_columns, "type_changed": contracts.type_changes,
           "nullable_changed": contracts.nullable_changes, "new_column": contracts.new_columns}
    for kind, operator in one.items():
        want = contracts.column_changes(snapshot(spark, new), contract(spark, old)).filter(F.col("change_type") == kind)
        assert sorted(map(str, operator(snapshot(spark, new), contract(spark, old)).collect())) == sorted(map(str, want.collect()))


def test_sources_without_contract_are_not_diffed(spark):
    assert contracts.schema_diff(snapshot(spark, [column("a")], source="new"), contract(spark, [column("a")])).count() == 0


def test_hash_is_that_of_the_json_column_list(spark):
    columns = [column("order_id", "INTEGER", False), column('we"ird\\', "VARCHAR", True, "critical")]
    text = json.dumps([{"name": n, "dtype": d, "nullable": u} for n, d, u, _ in columns], sort_keys=True)
    got = contracts.schema_hash(snapshot(spark, columns)).first().computed_hash
    assert got == hashlib.sha256(text.encode()).hexdigest()[:16]


def test_normalize_defaults_and_last_wins(spark):
    signals = spark.createDataFrame(
        [("s", "r", T0, [("a", "INT", None, False, None), ("b", None, "TEXT", None, "critical"),
                         ("a", None, None, None, None), (None, "X", None, None, None)], "h"),
         ("s", "r2", T0, None, None)],
        "source string, run_id string, ts timestamp, columns array<struct<name:string,type:string,dtype:string,"
        "nullable:boolean,criticality:string>>, version_hash string")
    got = {r.column_name: (r.position, r.dtype, r.nullable, r.criticality)
           for r in contracts.normalize_snapshot(signals).collect()}
    assert got == {"a": (2, "VARCHAR", True, "standard"), "b": (1, "TEXT", True, "critical"),
                   "": (3, "X", True, "standard")}


def test_bootstrap_history_accept_and_gate(spark):
    first = snapshot(spark, [column("a"), column("b")], "r1")
    later = snapshot(spark, [column("a")], "r2")
    rows = first.unionByName(later)
    current = contracts.bootstrap_contracts(rows)
    assert {r.column_name for r in current.collect()} == {"a", "b"}
    assert [r.first_run_id for r in contracts.schema_history(rows).collect()] == ["r1"]
    accepted = contracts.accept_contract(
        current.unionByName(contract(spark, [column("k")], "other")), later.select(*contracts.CONTRACT_COLUMNS))
    assert {(r.source, r.column_name) for r in accepted.collect()} == {("s", "a"), ("other", "k")}
    declared = contracts.contract_hash(current).first().contract_hash
    from pyspark.sql import functions as F
    gated = contracts.hash_gate(rows.withColumn("version_hash", F.when(F.col("run_id") == "r2", declared)
                                                .otherwise("x")), current)
    assert {r.run_id for r in gated.collect()} == {"r1"}


def test_packed_snapshots_give_the_changes_of_their_rows(spark):
    old = [column("z"), column("a", "INT", False), column("b", nullable=False), column("k", criticality="critical")]
    rows = snapshot(spark, [column("a", "TEXT"), column("b"), column("n1")], "r1").unionByName(snapshot(spark, [column("z")], "r2"))
    packed = rows.groupBy("source", "run_id", "ts", "version_hash").agg(F.collect_list(F.struct(
        "column_name", "position", "dtype", "nullable", "criticality")).alias("columns"))
    diff = contracts.schema_diff(rows, contract(spark, old))
    assert sorted(map(str, contracts.schema_diff(packed, contract(spark, old)).collect())) == sorted(map(str, diff.collect()))
    want = contracts.schema_drift_anomalies(diff, rows).collect()
    assert len(want) == 2 and sorted(map(str, contracts.packed_drift_anomalies(packed, contract(spark, old)).collect())) == sorted(map(str, want))


def test_comparison_shuffles_a_snapshot_once_and_never_its_columns(spark):
    rows = snapshot(spark, [column("a"), column("b")])
    packed = rows.groupBy("source", "run_id", "ts", "version_hash").agg(F.collect_list(F.struct(
        "column_name", "position", "dtype", "nullable", "criticality")).alias("columns")).localCheckpoint()
    plan = contracts.schema_diff(packed, contract(spark, [column("a")]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Window" not in plan


def test_last_of_equal_names_also_across_signals_of_a_run(spark):
    signals = spark.createDataFrame(
        [("s", "r", T0, [("a", "INT"), ("b", "INT"), ("a", "TEXT")], "h"), ("s", "r", T0, [("b", "DATE"), ("c", "INT")], "i"),
         ("s", "q", T0, [("a", "X"), ("a", "Y")], "j")],
        "source string, run_id string, ts timestamp, columns array<struct<name:string,type:string>>, version_hash string").withColumn(
        "columns", F.transform("columns", lambda c: F.struct(
            c["name"].alias("name"), c["type"].alias("type"), F.lit(None).cast("string").alias("dtype"),
            F.lit(None).cast("boolean").alias("nullable"), F.lit(None).cast("string").alias("criticality"))))
    got = {(r.run_id, r.column_name): (r.dtype, r.position, r.version_hash) for r in contracts.normalize_snapshot(signals).collect()}
    assert got == {("r", "a"): ("TEXT", 2, "h"), ("r", "b"): ("INT", 1, "h"), ("r", "c"): ("INT", 1, "i"), ("q", "a"): ("Y", 1, "j")}
