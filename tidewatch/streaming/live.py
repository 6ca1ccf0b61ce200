"""Structured Streaming forms of the detectors.

What a key needs from earlier rows is in Spark's state store (`streaming.state`), next to the stream's checkpoint; the
column expressions that judge the rows are those of the batch operators. Sinks are written per batch id, so a replay after
a failure changes nothing.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, types as T

from tidewatch.functions.keys import stable_id
from tidewatch.functions.severity import severity_name, severity_rank
from tidewatch.operators import contracts, correlate, ingestion, lineage, quality
from tidewatch.sources.artifacts import manifests_from, parse_test_results, read_raw_manifests
from tidewatch.sources.messages import encode_messages
from tidewatch.sources.storage import append_history, checkpointed, list_folder, read_history, remove_folder, upsert_latest
from tidewatch.streaming import state
from tidewatch.types import ANOMALY_TYPES, COLUMN_DEF

_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _carried(df: DataFrame):
    """A whole row as one text that comes back unchanged, so that a processor need not know its columns."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), _EXACT).alias("row")


def _restored(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.withColumn("row", F.from_json("row", schema, _EXACT)).select("row.*", *[c for c in df.columns if c != "row"])


def emit_gate(df: DataFrame, mode: str) -> DataFrame:
    """Shadow mode computes but publishes nothing."""
    return df.filter(F.lit(mode != "shadow"))


def start(stream: DataFrame, each_batch: Callable, checkpoint: str, once: bool = True,
          interval: str = "30 seconds", idle_batches: bool = True):
    """Runs `each_batch(df, batch_id)` on a stream; once = all that is there, then stop.

    Event-time timers need a batch without rows after the last one; state that expires by processing time would ask for
    such batches for ever, so those streams go without (`idle_batches`).
    """
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, str(idle_batches).lower())
    writer = stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    try:  # a query has the settings of the time it starts
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
    finally:
        conf.set(name, before)


def _settled(batch: DataFrame) -> DataFrame:
    """The rows of a micro-batch, kept, all of them taken through the state: also where a mode publishes nothing of them."""
    kept = batch.persist()
    kept.write.format("noop").mode("overwrite").save()
    return kept


def stream_ingestion_anomalies(
    signals: DataFrame, out: str, checkpoint: str, mode: str = "alert_only",
    threshold: float = 2.5, keep_days: float = 35, once: bool = True,
):
    """Ingestion checks on a signal stream. State: moments per source, last checksum per (source, day); a day
    not seen again for `keep_days` is forgotten. Rows of a micro-batch are taken in (ts, event_id) order."""
    state.use_state_store(signals.sparkSession)
    loads = ingestion.ingestion_stage_only(signals).select(
        "source", "event_id", "run_id", "ts", F.col("row_count").cast("string").alias("row_count"), "checksum",
        F.date_format("ts", "yyyy-MM-dd").alias("partition_date"))
    known = loads.groupBy("source").transformWithStateInPandas(
        state.LoadHistory(int(keep_days * 86_400_000)),
        "source string, event_id string, run_id string, ts timestamp, row_count string, checksum string, partition_date string, "
        "baseline_n bigint, baseline_mean double, baseline_std double, previous_checksum string", "append", "ProcessingTime")

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        batch = _settled(batch.withColumn("row_count", F.col("row_count").cast("bigint")))
        append_history(emit_gate(ingestion.loaded_anomalies(batch, threshold), mode), out, batch_id)
        batch.unpersist()

    return start(known, each_batch, checkpoint, once, idle_batches=False)


def stream_freshness(signals: DataFrame, max_age_seconds: int, out: str, checkpoint: str, mode: str = "alert_only", once: bool = True):
    """Sources that have fallen silent, each reported by a timer when the newest time of any source is more than the age past its last
    signal. The report is that signal; a source that speaks again can be reported again."""
    state.use_state_store(signals.sparkSession)
    rows = signals.withWatermark("ts", state.TRAIL).select("source", "ts", F.unix_micros("ts").alias("us"), "event_id", "run_id")
    silent = rows.groupBy("source").transformWithStateInPandas(
        state.SilentSources(max_age_seconds), "source string, us bigint, event_id string, run_id string", "append", "EventTime")

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        batch = _settled(batch)
        append_history(emit_gate(batch.withColumn("ts", F.timestamp_micros("us")).drop("us"), mode), out, batch_id)
        batch.unpersist()

    return start(silent, each_batch, checkpoint, once)


SILENCE = "source string, event_id string, run_id string, ts timestamp"


def open_violations(spark, out: str, checkpoint: str, as_of, max_age_seconds: int) -> DataFrame:
    """Anomalies of the reported sources that have not spoken since, with their age at `as_of`."""
    newest = state.read_state(spark, checkpoint, "newest").select("key.source", "value.event_id")
    still = read_history(spark, out, SILENCE).join(newest, ["source", "event_id"], "left_semi")
    return ingestion.freshness_violations(still, as_of, max_age_seconds)


def stored_baselines(spark, checkpoint: str) -> DataFrame:
    """The baselines that a stream of ingestion checks has come to: (source, mean, std_dev, sample_count)."""
    rows = state.read_state(spark, checkpoint, "moments").select("key.source", "value.*")
    std = F.when((F.col("n") < 2) | (F.col("low") == F.col("high")), 0.0).otherwise(F.sqrt(F.col("m2") / F.nullif(F.col("n") - 1, F.lit(0))))
    return rows.select("source", "mean", std.alias("std_dev"), F.col("n").alias("sample_count"))


_COLUMNS = T.ArrayType(COLUMN_DEF)


def stream_schema_drift(
    signals: DataFrame, out: str, checkpoint: str, mode: str = "alert_only",
    gate: bool = True, once: bool = True, known: DataFrame | None = None,
):
    """Schema drift on a stream of signals with snapshots. State: the contract of each source; a source's first
    snapshot becomes its contract, unless `known` (contract rows) has one when the stream first begins.
    `gate` leaves snapshots whose declared hash is the contract's unchecked."""
    spark = signals.sparkSession
    state.use_state_store(spark)
    rows = signals.select("source", "ts", "run_id", F.to_json("columns").alias("columns_json"), _carried(signals.drop("columns")))
    initial = None
    if known is not None:
        packed = F.to_json(F.sort_array(F.collect_list(F.struct(  # the width of one table
            F.col("column_name").alias("name"), F.col("dtype").alias("type"), F.col("dtype").alias("dtype"), "nullable", "criticality"))))
        initial = known.groupBy("source").agg(packed.alias("columns_json")).groupBy("source")
    checked = rows.groupBy("source").transformWithStateInPandas(
        state.SourceContracts(), "source string, ts timestamp, run_id string, columns_json string, row string, contract string", "append", "None", initial)
    schema, columns_type = signals.drop("columns").schema, signals.schema["columns"].dataType

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        given = _restored(batch.select("row", "columns_json", "contract"), schema).withColumn("columns", F.from_json("columns_json", columns_type))
        batch = _settled(given.drop("columns_json"))
        current = _contract_rows(batch.select("source", F.col("contract").alias("columns_json")))
        gated = lambda snapshot: contracts.hash_gate(snapshot, current) if gate else snapshot
        alone, several = contracts.only_signals(batch.drop("contract"))
        packed, rows = contracts.packed_signals(alone), contracts.normalize_snapshot(several)
        drift = contracts.packed_drift_anomalies(gated(packed), current).unionByName(
            contracts.schema_drift_anomalies(contracts.schema_diff(gated(rows), current), rows))
        append_history(emit_gate(drift, mode), out, batch_id)
        batch.unpersist()

    return start(checked, each_batch, checkpoint, once)


def _contract_rows(rows: DataFrame) -> DataFrame:
    none = F.lit(None)
    packed = rows.filter(F.col("columns_json").isNotNull()).select(
        "source", F.lit("contract").alias("run_id"), none.cast("timestamp").alias("ts"), none.cast("string").alias("version_hash"),
        F.from_json("columns_json", _COLUMNS).alias("columns"))
    return contracts.as_rows(contracts.packed_signals(packed)).select(*contracts.CONTRACT_COLUMNS)


def stored_contracts(spark, checkpoint: str) -> DataFrame:
    """The contracts that a stream of schema checks holds, to be reviewed or replaced (`contracts.accept_contract`)."""
    return _contract_rows(state.read_state(spark, checkpoint, "contract").select("key.source", "value.columns_json"))


def _bucket_incidents(closed: DataFrame) -> DataFrame:
    """Incidents of buckets as `state.OpenBuckets` emits or holds them."""
    facts = closed.select(
        stable_id(F.lit("bucket"), "run_id", F.col("opened_us").cast("string")).alias("bucket_id"), "run_id",
        F.timestamp_micros("opened_us").alias("opened_at"), *[f"has_{kind}" for kind in ANOMALY_TYPES],
        severity_name(F.col("rank")).alias("severity"), "n_signals", "suppressed",
        F.struct(F.timestamp_micros("first_us").alias("ts"), F.col("first_id").alias("signal_id"), F.col("first_type").alias("anomaly_type"),
                 F.col("first_confidence").alias("confidence"), F.col("first_model").alias("model_name")).alias("first"), "models")
    return correlate.incidents_from_facts(facts)


def stream_buckets(
    anomalies: DataFrame, out: str, checkpoint: str, mode: str = "alert_only",
    seconds: int = 300, delay_seconds: int = 0, once: bool = True,
):
    """Incidents from an anomaly stream. State: the open bucket of each run, as facts of fixed size and its model names.

    A bucket is emitted by its run's timer, when the newest event time seen has passed its end by `delay_seconds`, or when its
    run moves on; runs that neither expire nor get rows are not visited. A signal older than its run's open
    bucket joins it; after the bucket was emitted it opens a new one.
    """
    state.use_state_store(anomalies.sparkSession)
    buckets = state.OpenBuckets(ANOMALY_TYPES, seconds * 1_000_000, delay_seconds * 1_000_000)
    low = (F.col("severity") == "LOW") & (F.col("confidence") < 0.6)
    rows = anomalies.withWatermark("ts", state.TRAIL).select(
        "run_id", "ts", F.unix_micros("ts").alias("us"), "signal_id", "anomaly_type", "model_name", "confidence",
        F.coalesce(severity_rank(F.col("severity")), F.lit(1)).alias("rank"), F.coalesce(low, F.lit(True)).alias("low"))
    closed = rows.groupBy("run_id").transformWithStateInPandas(buckets, buckets.result_schema(), "append", "EventTime")

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        batch = _settled(batch)
        append_history(emit_gate(_bucket_incidents(batch), mode), out, batch_id)
        batch.unpersist()

    return start(closed, each_batch, checkpoint, once)


def flush_buckets(spark, checkpoint: str) -> DataFrame:
    """Incidents of the buckets still open after the last batch, at the end of the input."""
    opened = state.read_state(spark, checkpoint, "open").select("key.run_id", "value.*")
    models = (state.read_state(spark, checkpoint, "models").groupBy("key.run_id")
              .agg(F.sort_array(F.collect_set("user_map_key.model_name")).alias("models")))
    none = F.array().cast("array<string>")
    return _bucket_incidents(opened.join(models, "run_id", "left").withColumn("models", F.coalesce("models", none)))


def stream_quality(
    artifacts: DataFrame, out: str, checkpoint: str, mode: str = "alert_only",
    window: int = 20, once: bool = True,
):
    """Quality anomalies of newly published test results. State: the last `window` results of each (model, test)."""
    state.use_state_store(artifacts.sparkSession)
    tests = parse_test_results(artifacts)
    rows = tests.select("model_name", "test_name", "run_id", F.unix_micros("run_at").alias("us"), "position",
                        F.col("status").isin("fail", "error").alias("failed"), _carried(tests))
    scored = rows.groupBy("model_name", "test_name").transformWithStateInPandas(
        state.RecentResults(window), "row string, total_runs bigint, failure_count bigint", "append", "None")
    schema = tests.schema

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        batch = _settled(batch)
        failed = quality.failed_tests(quality.flaky_flags(_restored(batch, schema)))
        append_history(emit_gate(quality.quality_anomalies(quality.graded(failed)), mode), out, batch_id)
        batch.unpersist()

    return start(scored, each_batch, checkpoint, once)


def stream_lineage(anomalies: DataFrame, blast_path: str, out: str, checkpoint: str,
                   mode: str = "alert_only", once: bool = True):
    """Lineage incidents of an anomaly stream. `blast_path` holds the versions that `publish_blast`
    writes; every micro-batch takes the newest, so a new manifest takes effect at once."""
    spark = anomalies.sparkSession

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        incidents = lineage.lineage_incidents(batch, latest_blast(spark, blast_path))
        append_history(emit_gate(incidents, mode), out, batch_id)

    return start(anomalies, each_batch, checkpoint, once)


_GRAPH = ("numbers", "edges", "words")


def publish_blast(spark, manifests: str | DataFrame, blast_path: str) -> int:
    """Brings the blast table of all models of the manifests up to date, as a new version; returns its number.

    `manifests` is a path, or rows as `artifacts.manifests_from` takes them. Manifests of the same content as
    those of the newest version make no new one. The graph and its closure lie next to each version, and a changed manifest
    only has the sets found anew that its added and removed edges reach. Running readers keep the version they have; a version
    is complete once it has its success mark, and the last two stay.
    """
    raw = checkpointed(read_raw_manifests(spark, manifests) if isinstance(manifests, str) else manifests, "manifests")
    content = raw.select(F.sha2(F.to_json(F.struct("project", "nodes", "exposures", "child_map", "parent_map")), 256).alias("h"))
    content = content.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256)).first()[0]  # a hash per manifest
    done = _versions(spark, blast_path)
    last, before = max(done, default=0), None
    if last:
        graph = f"{blast_path}/graph={last}"
        if spark.read.parquet(f"{graph}/content").first()[0] == content:
            return last
        before = tuple(spark.read.parquet(f"{graph}/{part}") for part in _GRAPH)
    version, graph = last + 1, f"{blast_path}/graph={last + 1}"
    models, exposures, edges = manifests_from(raw)
    stored, blast = lineage.update_graph(models, edges, exposures, before)
    for part, rows in zip(_GRAPH, stored):
        rows.write.mode("overwrite").parquet(f"{graph}/{part}")
    spark.createDataFrame([(content,)], "content string").write.mode("overwrite").parquet(f"{graph}/content")
    blast.write.mode("overwrite").parquet(f"{blast_path}/version={version}")  # last: its mark makes the version complete
    for old in sorted(done)[:-1]:
        remove_folder(spark, f"{blast_path}/version={old}")
        remove_folder(spark, f"{blast_path}/graph={old}")
    return version


def stream_manifests(manifests: DataFrame, blast_path: str, checkpoint: str, once: bool = True):
    """Publishes a new blast version whenever a manifest is published with other content than its project's last one.

    `manifests` is a stream of rows (project, published_at, nodes, exposures, child_map, parent_map); of each project the
    newest counts, and projects without a new manifest keep theirs.
    """
    spark, columns = manifests.sparkSession, manifests.columns

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        kept = f"{blast_path}/manifests"
        last = [b for b in (int(n.split("=")[1]) for n in list_folder(spark, kept)) if b < batch_id]
        current = batch.select(*columns)
        stored = spark.read.parquet(f"{kept}/batch={max(last)}") if last else current.limit(0)
        upsert_latest(stored, current, ["project"], "published_at").write.mode("overwrite").parquet(f"{kept}/batch={batch_id}")
        publish_blast(spark, spark.read.parquet(f"{kept}/batch={batch_id}"), blast_path)
        for old in sorted(last)[:-1]:
            remove_folder(spark, f"{kept}/batch={old}")

    return start(manifests, each_batch, checkpoint, once)


def _versions(spark, blast_path: str) -> list[int]:
    return [int(name.split("=")[1]) for name in list_folder(spark, blast_path)
            if name.startswith("version=") and "_SUCCESS" in list_folder(spark, f"{blast_path}/{name}")]


def latest_blast(spark, blast_path: str) -> DataFrame:
    """The newest complete version of the blast table."""
    return spark.read.parquet(f"{blast_path}/version={max(_versions(spark, blast_path))}")


def stream_messages(rows: DataFrame, key_column: str, format: str, checkpoint: str, mode: str,
                    once: bool = True, **options):
    """Publishes a stream as keyed JSON messages, e.g. format="kafka"."""
    writer = (encode_messages(emit_gate(rows, mode), key_column).writeStream.format(format)
              .options(**options).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if once else writer).start()


def late_signals(signals: DataFrame, delay_seconds: int, out: str, checkpoint: str, once: bool = True):
    """Parts signals that arrive more than the delay behind the newest time seen before from the others.

    Spark drops what is behind its watermark; here the watermark only is the clock, and late rows go to
    `out`/late, the others to `out`/on_time, so none is lost. Counts per source are in the state (`late_counts`).
    """
    state.use_state_store(signals.sparkSession)
    rows = signals.withWatermark("ts", state.TRAIL).select("source", "ts", F.unix_micros("ts").alias("us"), _carried(signals))
    marked = rows.groupBy("source").transformWithStateInPandas(
        state.Lateness(delay_seconds * 1000), "row string, is_late boolean", "append", "EventTime")
    schema = signals.schema

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        batch = _settled(_restored(batch, schema))
        append_history(batch.filter("NOT is_late"), f"{out}/on_time", batch_id)
        append_history(batch.filter("is_late"), f"{out}/late", batch_id)
        batch.unpersist()

    return start(marked, each_batch, checkpoint, once)


def late_counts(spark, checkpoint: str) -> DataFrame:
    """(source, n_rows, n_late) of all signals a stream of `late_signals` has seen."""
    return state.read_state(spark, checkpoint, "counts").select("key.source", "value.*")
