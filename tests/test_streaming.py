import datetime
import json
import time

import numpy as np
from pyspark.sql import functions as F

from tidewatch.operators import correlate, ingestion, reports
from tidewatch.sources import artifacts, storage
from tidewatch.streaming import counters, live
from tidewatch.types import RUN_RESULTS
from test_correlate import ROW, anomalies, simple
from test_ingestion import SIGNAL, signals

ANOMALY = ROW


def feed(spark, folder, parts, start):
    """Writes each part as new files and runs the stream to its end, from the same checkpoint."""
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        start(spark.readStream.schema(part.schema).parquet(f"{folder}/in")).awaitTermination()


def test_ingestion_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(11)
    rows = [(s, int(m), int(v), f"c{v % 3}") for s in ("a", "b", "c")
            for m, v in zip(np.sort(rng.integers(0, 3000, 60)), rng.integers(0, 40, 60) ** 3)]
    df = signals(spark, rows)
    cut = F.lit("2026-04-23 00:00:00").cast("timestamp")
    base = str(tmp_path)
    feed(spark, base, [df.filter(F.col("ts") < cut), df.filter(F.col("ts") >= cut)],
         lambda s: live.stream_ingestion_anomalies(s, f"{base}/out", f"{base}/cp"))
    got = storage.read_history(spark, f"{base}/out", ANOMALY).select("signal_id", "severity", F.round("confidence", 4))
    want = ingestion.ingestion_anomalies(df).select("signal_id", "severity", F.round("confidence", 4))
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 20


def test_shadow_mode_publishes_nothing_but_learns(spark, tmp_path):
    base = str(tmp_path)
    df = signals(spark, [("a", i, n, None) for i, n in enumerate([10, 11, 9, 0])])
    feed(spark, base, [df], lambda s: live.stream_ingestion_anomalies(
        s, f"{base}/out", f"{base}/cp", mode="shadow"))
    assert storage.read_history(spark, f"{base}/out", ANOMALY).count() == 0
    state = live.stored_baselines(spark, f"{base}/cp").first()
    assert (state.source, state.mean, state.std_dev, state.sample_count) == ("a", 10.0, 1.0, 3)


INCIDENT = ("incident_id string, bucket_id string, run_id string, opened_at timestamp, root_cause string, "
            "severity string, confidence double, needs_llm boolean, n_signals bigint, models array<string>, "
            "primary_model string")


def test_bucket_stream_equals_batch_and_joins_late_signals(spark, tmp_path):
    base = str(tmp_path)
    rng = np.random.default_rng(2)
    kinds = ["row_count_anomaly", "schema_drift", "quality_failure", "checksum_mismatch"]
    rows = sorted((simple(f"r{rng.integers(3)}", float(s), kinds[rng.integers(4)], "HIGH", 0.8, f"m{rng.integers(5)}")
                   for s in rng.integers(0, 6000, 200)), key=lambda r: r[1])
    df = anomalies(spark, rows)
    bounds = [df.filter("signal_id < 's00070'"), df.filter("signal_id >= 's00070' and signal_id < 's00071'"),
              df.filter("signal_id >= 's00071'")]
    feed(spark, base, bounds, lambda s: live.stream_buckets(s, f"{base}/out", f"{base}/cp"))
    emitted = storage.read_history(spark, f"{base}/out", INCIDENT)
    got = emitted.unionByName(live.flush_buckets(spark, f"{base}/cp")).drop("bucket_id")
    want = correlate.confirmed_incidents(correlate.signal_buckets(df)).drop("bucket_id")
    assert sorted(got.collect()) == sorted(want.collect())

    # a signal older than the open bucket of its run joins that bucket
    late = str(tmp_path / "late")
    feed(spark, late, [anomalies(spark, [simple("x", 1000), simple("x", 1100)]), anomalies(spark, [simple("x", 900)])],
         lambda s: live.stream_buckets(s, f"{late}/out", f"{late}/cp"))
    flushed = live.flush_buckets(spark, f"{late}/cp").collect()
    assert [(r.n_signals, r.run_id) for r in flushed] == [(3, "x")]


def test_quality_stream_reads_each_artifact_once(spark, tmp_path):
    from test_quality import result
    base = tmp_path

    def publish(i, status):
        folder = base / "runs" / f"{i:02d}"
        folder.mkdir(parents=True)
        (folder / "run_results.json").write_text(json.dumps({
            "metadata": {"generated_at": f"2026-04-{i:02d}T00:00:00Z"},
            "results": [result("unique", "m", "id", status, 20000)]}))

    def run():
        stream = artifacts.new_artifacts(spark, f"{base}/runs/*/", RUN_RESULTS)
        live.stream_quality(stream, f"{base}/out", f"{base}/cp").awaitTermination()

    for i in range(1, 5):
        publish(i, "pass")
    run()
    publish(5, "fail")
    run()
    publish(6, "fail")
    run()
    run()  # nothing new
    got = storage.read_history(spark, f"{base}/out", ANOMALY + ", genuine_failures bigint").orderBy("ts").collect()
    # first failure: 1 of 5 is not over 20 %; second: 2 of 6 is, so it is flaky
    assert [(r.severity, r.confidence, r.genuine_failures) for r in got] == [("HIGH", 0.95, 1), ("MEDIUM", 0.5, 0)]


def test_an_artifact_is_read_once_per_content(spark, tmp_path):
    from test_quality import result

    def publish(folder, failures):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "run_results.json").write_text(json.dumps({
            "metadata": {"generated_at": "2026-04-01T00:00:00Z"}, "results": [result("unique", "m", "id", "fail", failures)]}))

    def rows():
        stream = artifacts.new_artifacts(spark, f"{tmp_path}/in/*/", RUN_RESULTS, once_within="7 days")
        live.start(stream, lambda batch, n: storage.append_history(batch.select(F.explode("results.failures").alias("n")), f"{tmp_path}/out", n),
                   f"{tmp_path}/cp").awaitTermination()
        return sorted(r.n for r in storage.read_history(spark, f"{tmp_path}/out", "n bigint").collect())

    publish("1", 5)
    assert rows() == [5]
    publish("2", 5)
    assert rows() == [5]
    publish("3", 6)
    assert rows() == [5, 6]


def test_silent_sources_are_reported_by_timers(spark, tmp_path):
    base = str(tmp_path)
    def run(rows):
        feed(spark, base, [signals(spark, rows)], lambda s: live.stream_freshness(s, 3600, f"{base}/out", f"{base}/cp"))
    reported = lambda: sorted((r.source, r.event_id) for r in storage.read_history(spark, f"{base}/out", live.SILENCE).collect())
    run([("a", 0, 1, None), ("b", 0, 1, None)])
    run([("a", 59, 1, None), ("b", 60, 1, None)])
    assert reported() == []
    run([("a", 121, 1, None)])
    assert [s for s, _ in reported()] == ["b"]  # it said nothing
    run([("b", 122, 1, None)])
    as_of = lambda minutes: F.lit("2026-04-22 03:00:00").cast("timestamp") + F.make_interval(mins=F.lit(minutes))
    assert live.open_violations(spark, f"{base}/out", f"{base}/cp", as_of(122), 3600).count() == 0
    run([("b", 200, 1, None)])
    assert [s for s, _ in reported()] == ["a", "b"]


def test_late_signals_are_flagged_and_kept(spark, tmp_path):
    base = str(tmp_path)
    feed(spark, base, [signals(spark, [("a", 0, 1, None), ("a", 600, 1, None)]),
                       signals(spark, [("a", 500, 1, None), ("a", 590, 1, None), ("a", 700, 1, None)])],
         lambda s: live.late_signals(s, 1800, f"{base}/out", f"{base}/cp"))
    rows = [r for part in ("on_time", "late") for r in storage.read_history(spark, f"{base}/out/{part}", SIGNAL + ", is_late boolean").collect()]
    assert [r.is_late for r in rows] == [False] * 4 + [True]
    assert [tuple(r) for r in live.late_counts(spark, f"{base}/cp").collect()] == [("a", 5, 1)]
    assert sorted((r.ts.hour * 60 + r.ts.minute - 180, r.is_late) for r in rows) == [
        (0, False), (500, True), (590, False), (600, False), (700, False)]


def test_a_checksum_day_expires_by_its_time_to_live(spark, tmp_path):
    first, again = signals(spark, [("a", 0, 1, "c")]), signals(spark, [("a", 60, 1, "d")])
    for name, keep, wait in (("short", 1 / 86_400, 1.5), ("long", 35, 0)):
        base = str(tmp_path / name)
        run = lambda s: live.stream_ingestion_anomalies(s, f"{base}/out", f"{base}/cp", keep_days=keep)  # noqa: E731, B023
        feed(spark, base, [first], run)
        time.sleep(wait)
        feed(spark, base, [again], run)
        kinds = [r.anomaly_type for r in storage.read_history(spark, f"{base}/out", ANOMALY).collect()]
        assert kinds == ([] if name == "short" else ["checksum_mismatch"])


def test_an_idle_run_is_emitted_by_its_timer(spark, tmp_path):
    base = str(tmp_path)
    feed(spark, base, [anomalies(spark, [simple("idle", 0, model="m1"), simple("idle", 200, model="m2")]), anomalies(spark, [simple("busy", 250)])],
         lambda s: live.stream_buckets(s, f"{base}/out", f"{base}/cp"))
    emitted = lambda: sorted((r.run_id, r.n_signals, r.models) for r in storage.read_history(spark, f"{base}/out", INCIDENT).collect())
    assert emitted() == []
    feed(spark, base, [anomalies(spark, [simple("busy", 301)])], lambda s: live.stream_buckets(s, f"{base}/out", f"{base}/cp"))
    assert emitted() == [("idle", 2, ["m1", "m2"])]  # no row of its own came
    assert [r.run_id for r in live.flush_buckets(spark, f"{base}/cp").collect()] == ["busy"]
    # after it was emitted, an old signal opens a new bucket
    feed(spark, base, [anomalies(spark, [simple("idle", 100, model="m3")])], lambda s: live.stream_buckets(s, f"{base}/out", f"{base}/cp"))
    assert emitted() == [("idle", 2, ["m1", "m2"])]
    assert sorted((r.run_id, r.models) for r in live.flush_buckets(spark, f"{base}/cp").collect()) == [("busy", ["tide_daily"]), ("idle", ["m3"])]


def test_contracts_are_handed_in_and_read_back(spark, tmp_path):
    base = str(tmp_path)
    schema = "source string, run_id string, ts timestamp, version_hash string, columns array<struct<name:string,type:string,dtype:string,nullable:boolean,criticality:string>>"
    column = lambda name, kind: (name, kind, None, True, None)
    signal = lambda run, *columns: spark.createDataFrame([("s", run, datetime.datetime(2026, 4, int(run)), "h", list(columns))], schema)
    known = spark.createDataFrame([("s", "a", "INT", True, "critical"), ("s", "b", "INT", True, "standard")],
                                  "source string, column_name string, dtype string, nullable boolean, criticality string")
    parts = [signal("1", column("a", "INT"), column("b", "INT")), signal("2", column("a", "INT")), signal("3", column("b", "TEXT"))]
    for part in parts:  # each time from the state alone
        feed(spark, base, [part], lambda s: live.stream_schema_drift(s, f"{base}/out", f"{base}/cp", known=known))
    found = storage.read_history(spark, f"{base}/out", ANOMALY).collect()
    assert sorted((r.run_id, r.severity) for r in found) == [("2", "CRITICAL"), ("3", "CRITICAL")]
    held = live.stored_contracts(spark, f"{base}/cp").collect()
    assert sorted((r.column_name, r.dtype, r.criticality) for r in held) == [("a", "INT", "critical"), ("b", "INT", "standard")]


def test_lineage_stream_follows_new_manifests(spark, tmp_path):
    from test_lineage import EXPOSURES, SEA, manifest
    base = str(tmp_path)
    (tmp_path / "m").mkdir()

    def publish(children):
        (tmp_path / "m" / "manifest.json").write_text(json.dumps(manifest("sea", children, EXPOSURES)))
        return live.publish_blast(spark, f"{base}/m", f"{base}/blast")

    found = []
    for i, children in enumerate((SEA, {**SEA, "model.sea.tide_daily": []}, SEA)):
        assert publish(children) == i + 1
        feed(spark, base, [anomalies(spark, [simple(f"r{i}", i, model="tide_daily")])],
             lambda s: live.stream_lineage(s, f"{base}/blast", f"{base}/out", f"{base}/cp"))
        rows = storage.read_history(spark, f"{base}/out", "run_id string, n_downstream bigint").collect()
        found = sorted((r.run_id, r.n_downstream) for r in rows)
    assert found == [("r0", 2), ("r1", 0), ("r2", 2)]
    assert sorted(storage.list_folder(spark, f"{base}/blast")) == ["graph=2", "graph=3", "version=2", "version=3"]
    assert live.publish_blast(spark, f"{base}/m", f"{base}/blast") == 3  # the same content again


def test_live_counters_go_on_over_batches_streams_and_restarts(spark, tmp_path):
    counted = counters.StageCounters()
    spark.streams.addListener(counted)
    base, queries = str(tmp_path), []

    def start(stream):
        for name in ("one", "two"):
            rows = reports.observed(stream, name, big=F.col("v") > 5)
            queries.append(live.start(rows, lambda b, _: b.write.format("noop").mode("overwrite").save(), f"{base}/{name}"))
            queries[-1].awaitTermination()
        return queries[-1]

    try:
        parts = [spark.range(n).select(F.when(F.col("id") != 0, F.col("id")).alias("v")) for n in (10, 3, 20)]
        feed(spark, base, parts, start)
        start(spark.readStream.schema("v long").parquet(f"{base}/in"))  # nothing new
        for query in queries:
            counted.until_end(query)
    finally:
        spark.streams.removeListener(counted)
    assert sorted(map(tuple, counted.rows(spark).collect())) == [
        ("one", "big", 18), ("one", "processed", 33), ("two", "big", 18), ("two", "processed", 33)]
    assert reports.observed(parts[0], "batch").count() == 10
