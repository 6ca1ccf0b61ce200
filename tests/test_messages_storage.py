import json

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import profile
from tidewatch.sources import messages, storage
from tidewatch.streaming import live

GOOD = {"stage": "ingestion", "source": "tide_gauge", "metrics": {"row_count": 5, "extra": [1]},
        "pipeline_run_id": "run-1", "ts": "2026-04-22T03:00:00+02:00"}


def raw(spark, documents):
    return spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in documents], "value string")


def without(key):
    return {k: v for k, v in GOOD.items() if k != key}


@pytest.mark.parametrize("document, reason", [
    ("no json", "not json"), ('{"stage": "inges', "not json"), ("{}", "no known field"), (without("source"), "missing source"), (without("metrics"), "missing metrics"),
    (without("pipeline_run_id"), "missing pipeline_run_id"), ({**GOOD, "stage": "archive"}, "unknown stage"),
    ({**GOOD, "ts": "yesterday"}, "bad ts"),
    ({**GOOD, "schema_snapshot": {"columns": []}}, "incomplete snapshot")])
def test_bad_signals_go_to_the_dead_letters(spark, document, reason):
    df = raw(spark, [document, GOOD])
    assert messages.decode_signals(df).count() == 1
    bad = messages.split_malformed(df).collect()
    assert [b.reason for b in bad] == [reason]
    text = document if isinstance(document, str) else json.dumps(document)
    assert (bad[0].value, bad[0].value_head) == (text, text[:200])


def test_good_signal_and_defaults(spark):
    snapshot = {"columns": [{"name": "a", "type": "INT"}], "version_hash": "h"}
    row = messages.decode_signals(raw(spark, [{**GOOD, "schema_snapshot": snapshot}])).first()
    assert (row.event_type, row.stage, row.source, row.run_id, row.row_count) == (
        "pipeline.stage.completed", "ingestion", "tide_gauge", "run-1", 5)
    assert str(row.ts) == "2026-04-22 01:00:00" and len(row.event_id) == 64
    assert row.columns[0]["name"] == "a" and row.version_hash == "h"
    untimed = messages.decode_signals(raw(spark, [without("ts")]), F.timestamp_seconds(F.lit(0))).first()
    assert untimed.ts.year == 1970


ANOMALY = {"anomaly_type": "schema_drift", "source_agent": "a", "pipeline_run_id": "r", "severity": "LOW",
           "confidence": 1.0, "details": {"x": 1}, "ts": "2026-04-22T03:00:00Z"}


def test_anomalies(spark):
    df = raw(spark, [ANOMALY, {**ANOMALY, "confidence": 1.01}, {**ANOMALY, "confidence": -0.1},
                     {**ANOMALY, "severity": "SEVERE"}, {**ANOMALY, "anomaly_type": "x"}, {**ANOMALY, "details": None}])
    rows = messages.decode_anomalies(df).collect()
    assert [(r.severity, r.details, r.model_name) for r in rows] == [("LOW", '{"x":1}', None)]


def test_incidents_round_trip(spark):
    incident = {"root_cause": "schema_drift", "severity": "HIGH", "pipeline_run_id": "r", "incident_id": "i",
                "correlated_signals": [ANOMALY], "blast_radius": {"affected_models": ["m"]}}
    broken = {**incident, "correlated_signals": [{**ANOMALY, "confidence": 7}]}
    got = messages.decode_incidents(raw(spark, [incident, broken])).collect()
    assert [(r.incident_id, r.n_signals, r.blast_radius.affected_models, r.primary_model) for r in got] == [
        ("i", 1, ["m"], "unknown")]
    sent = messages.encode_messages(messages.decode_incidents(raw(spark, [incident])), "incident_id").first()
    assert sent.key == "i" and json.loads(sent.value)["root_cause"] == "schema_drift"


def test_messages_are_written(spark, tmp_path):
    df = messages.decode_signals(raw(spark, [GOOD])).select("run_id", "row_count")
    messages.write_messages(messages.encode_messages(df, "run_id"), "json", path=str(tmp_path / "batch"))
    df.write.parquet(str(tmp_path / "in"))
    for mode in ("shadow", "alert_only"):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        live.stream_messages(stream, "run_id", "json", str(tmp_path / f"cp-{mode}"), mode,
                             path=str(tmp_path / mode)).awaitTermination()
    read = lambda name: spark.read.schema("key string, value string").json(str(tmp_path / name)).collect()
    assert [(r.key, r.value) for r in read("batch")] == [("run-1", '{"run_id":"run-1","row_count":5}')]
    assert read("alert_only") == read("batch") and read("shadow") == []


def test_upsert_latest(spark):
    schema = "k int, v string, at int"
    now = spark.createDataFrame([(1, "old", 5), (2, "keep", 5), (3, "tie", 5)], schema)
    new = spark.createDataFrame([(1, "new", 6), (2, "late", 4), (3, "won", 5), (4, "first", 1), (4, "last", 2)], schema)
    got = {r.k: r.v for r in storage.upsert_latest(now, new, ["k"], "at").collect()}
    assert got == {1: "new", 2: "keep", 3: "won", 4: "last"}


def test_append_is_idempotent_per_batch(spark, tmp_path):
    df = spark.range(5)
    for batch in (0, 1, 1):
        storage.append_history(df, str(tmp_path / "h"), batch)
    assert storage.read_history(spark, str(tmp_path / "h"), df.schema).count() == 10


def test_profile(spark):
    df = spark.createDataFrame(
        [("a", 1, "x", None), ("a", 1, "y", 2.0), ("a", 3, "z", None), ("b", 1, "x", 1.0)],
        "source string, day int, s string, v double")
    part = F.timestamp_seconds(F.col("day") * 86400)
    counts = profile.partition_row_count(df, F.col("source"), part, "1 DAY")
    assert sorted((r.source, r.partition.day, r.row_count) for r in counts.collect()) == [
        ("a", 2, 2), ("a", 3, 0), ("a", 4, 1), ("b", 2, 1), ("b", 3, 0), ("b", 4, 0)]
    sums = lambda d: {(r.source, r.partition): r.checksum for r in profile.partition_checksum(
        d, F.col("source"), part, ["s", "v"]).collect()}
    assert sums(df) == sums(df.orderBy(F.desc("s")))
    assert sums(df) != sums(df.unionByName(df.limit(1)))
    rates = profile.partition_null_rate(df, F.col("source"), part, ["v"])
    assert {(r.source, r.partition.day): r.null_rate for r in rates.collect()} == {
        ("a", 2): 0.5, ("a", 4): 1.0, ("b", 2): 0.0}
    summary = profile.column_summary(df, ["v", "day"], exact_distinct=True).filter("column_name = 'v'").first()
    assert (summary.n, summary.mean, summary.null_rate, summary.n_distinct) == (4, 1.5, 0.5, 2)
    assert [(r.column_name, r.dtype) for r in profile.schema_snapshot(df, "t").orderBy("position").collect()] == [
        ("source", "STRING"), ("day", "INT"), ("s", "STRING"), ("v", "DOUBLE")]


def test_stored_sketches_merge_to_the_summary_of_the_whole(spark):
    df = spark.range(40000).select(
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("source"), (F.col("id") % 7).alias("day"),
        F.when(F.col("id") % 5 > 0, F.col("id") + 1e9).alias("v"), F.lit(None).cast("int").alias("none"))
    stored = profile.summary_sketches(df, F.col("source"), F.col("day"), ["v", "none"])
    assert stored.count() == 3 * 7 * 2
    got = {(r.source, r.column_name): r for r in profile.merged_summary(stored, ["source"]).collect()}
    assert set(got) == {(s, c) for s in (None, "s1", "s2") for c in ("v", "none")}
    for source in (None, "s1", "s2"):
        want = profile.column_summary(df.filter(F.col("source").eqNullSafe(F.lit(source))), ["v"], exact_distinct=True).first()
        r = got[source, "v"]
        assert (r.n, r.min, r.max, r.null_rate) == (want.n, want.min, want.max, want.null_rate)
        assert abs(r["mean"] - want["mean"]) < 1e-4 and abs(r.std_dev / want.std_dev - 1) < 1e-9
        assert abs(r.n_distinct / want.n_distinct - 1) < 4 * 1.04 / 64
        empty = got[source, "none"]
        assert (empty["mean"], empty.std_dev, empty["min"], empty.null_rate, empty.n_distinct) == (None, None, None, 1.0, 0)
    days = profile.merged_summary(stored.filter("day < 3"), []).filter("column_name = 'v'").first()
    want = profile.column_summary(df.filter("day < 3"), ["v"], exact_distinct=True).first()
    assert days.n == want.n and abs(days.std_dev / want.std_dev - 1) < 1e-9
    assert profile.merged_summary(stored.filter("false"), ["source"]).collect() == []


def test_checksum_tells_nulls_apart(spark):
    df = spark.createDataFrame([("l", "a", None), ("r", None, "a")], "source string, x string, y string")
    got = [r.checksum for r in profile.partition_checksum(df, F.col("source"), F.lit(1), ["x", "y"]).collect()]
    assert got[0] != got[1]


def test_messages_are_parsed_once_per_row(spark):
    raw = spark.createDataFrame([("{}",)], "value string")
    for decode in (messages.decode_signals, messages.decode_anomalies, messages.decode_incidents):
        plan = decode(raw)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("from_json") + plan.lower().count("jsontostructs") == 1
