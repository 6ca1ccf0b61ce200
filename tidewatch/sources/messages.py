"""Message decoding and encoding.

Input is any DataFrame with a `value` text column: a Kafka source (cast to string), files
or a table. A message that does not satisfy the contract is left out by the decoders and
kept by `split_malformed`.
"""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewatch.functions.keys import once, stable_id
from tidewatch.types import (
    ANOMALY_MESSAGE, ANOMALY_TYPES, INCIDENT_MESSAGE, SEVERITIES, SIGNAL_MESSAGE, STAGES)

_JSON = {"mode": "PERMISSIVE", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]"}


def _missing(*columns: str) -> Column:
    names = [F.when(F.col(c).isNull(), F.lit(c.split(".")[-1])) for c in columns]
    return F.coalesce(*names)


def _bad_time(field: str) -> Column:
    """A time that is there but cannot be read; an absent one has a default."""
    return F.col(f"m.{field}").isNull() & F.get_json_object("value", f"$.{field}").isNotNull()


def _with_message(raw: DataFrame, schema: T.StructType, options: dict) -> DataFrame:
    """The rows with their message `m`: texts are made and read once, however many fields are checked and used."""
    texts = raw.select(*[c for c in raw.columns if c != "value"], once(F.col("value")).alias("value"))
    return texts.select("*", once(F.from_json("value", schema, options)).alias("m"))


def _parsed_signals(raw: DataFrame) -> DataFrame:
    # text that is no JSON object, or ends inside one, also fills the corrupt field
    kept = T.StructType([*SIGNAL_MESSAGE.fields, T.StructField("_corrupt", T.StringType())])
    parsed = _with_message(raw, kept, {**_JSON, "columnNameOfCorruptRecord": "_corrupt"})
    snapshot = F.col("m.schema_snapshot")
    broken = F.col("m").isNull() | (F.col("m._corrupt").isNotNull() & F.try_parse_json("value").isNull())
    reason = (
        F.when(broken, "not json")
        .when(F.coalesce("m.stage", "m.source", "m.pipeline_run_id").isNull()
              & F.col("m.metrics").isNull(), "no known field")
        .when(_missing("m.stage", "m.source", "m.metrics", "m.pipeline_run_id").isNotNull(),
              F.concat(F.lit("missing "), _missing("m.stage", "m.source", "m.metrics", "m.pipeline_run_id")))
        .when(~F.col("m.stage").isin(STAGES), "unknown stage")
        .when(snapshot.isNotNull() & (snapshot["columns"].isNull() | snapshot["version_hash"].isNull()),
              "incomplete snapshot")
        .when(_bad_time("ts"), "bad ts"))
    return parsed.withColumn("reason", reason)


def decode_signals(raw: DataFrame, received_at: Column | None = None) -> DataFrame:
    """JSON text -> signal rows with the snapshot's columns and version_hash.

    `received_at` stands in for a missing ts (default: now).
    """
    now = F.current_timestamp() if received_at is None else received_at
    return _parsed_signals(raw).filter(F.col("reason").isNull()).select(
        F.coalesce("m.event_id", stable_id("value")).alias("event_id"),
        F.coalesce("m.event_type", F.lit("pipeline.stage.completed")).alias("event_type"),
        "m.stage", "m.source", F.col("m.pipeline_run_id").alias("run_id"),
        F.coalesce("m.ts", now).alias("ts"), "m.metrics.row_count", "m.metrics.checksum",
        "m.metrics.null_rate", "m.metrics.duration_ms",
        F.col("m.schema_snapshot.columns").alias("columns"), "m.schema_snapshot.version_hash")


def split_malformed(raw: DataFrame) -> DataFrame:
    """The messages `decode_signals` leaves out: whole, so they can be sent again, their first 200 characters, and why."""
    return _parsed_signals(raw).filter(F.col("reason").isNotNull()).select(
        "value", F.substring("value", 1, 200).alias("value_head"), "reason")


def decode_anomalies(raw: DataFrame, received_at: Column | None = None) -> DataFrame:
    """JSON text -> anomaly rows; confidence must lie in [0, 1], enums must be known."""
    now = F.current_timestamp() if received_at is None else received_at
    parsed = _with_message(raw, ANOMALY_MESSAGE, _JSON)
    valid = (F.col("m.anomaly_type").isin(ANOMALY_TYPES) & F.col("m.severity").isin(SEVERITIES)
             & F.col("m.confidence").between(0.0, 1.0) & F.col("m.source_agent").isNotNull()
             & F.col("m.pipeline_run_id").isNotNull() & F.col("m.details").startswith("{")
             & ~_bad_time("ts"))
    return parsed.filter(valid).select(
        F.coalesce("m.signal_id", stable_id("value")).alias("signal_id"), "m.anomaly_type",
        "m.source_agent", F.col("m.pipeline_run_id").alias("run_id"), "m.model_name", "m.severity",
        "m.confidence", F.coalesce("m.ts", now).alias("ts"), "m.details")


def decode_incidents(raw: DataFrame, received_at: Column | None = None) -> DataFrame:
    """JSON text -> incident rows with their nested signals and blast radius."""
    now = F.current_timestamp() if received_at is None else received_at
    parsed = _with_message(raw, INCIDENT_MESSAGE, _JSON)
    sound = F.forall("m.correlated_signals", lambda s: (
        F.coalesce(s["anomaly_type"].isin(ANOMALY_TYPES) & s["severity"].isin(SEVERITIES)
                   & s["confidence"].between(0.0, 1.0) & s["source_agent"].isNotNull()
                   & s["pipeline_run_id"].isNotNull(), F.lit(False))))
    valid = (F.col("m.root_cause").isNotNull() & F.col("m.severity").isin(SEVERITIES)
             & F.col("m.pipeline_run_id").isNotNull() & sound & ~_bad_time("ts"))
    return parsed.filter(valid).select(
        F.coalesce("m.incident_id", stable_id("value")).alias("incident_id"),
        F.col("m.pipeline_run_id").alias("run_id"), F.coalesce("m.ts", now).alias("opened_at"),
        "m.root_cause", "m.severity", F.col("m.correlated_signals").alias("signals"),
        "m.blast_radius", "m.llm_hypothesis",
        F.size("m.correlated_signals").cast("bigint").alias("n_signals"),
        F.coalesce(F.nullif(F.try_element_at("m.correlated_signals", F.lit(1))["model_name"], F.lit("")),
                   F.lit("unknown")).alias("primary_model"))


def encode_messages(df: DataFrame, key_column: str) -> DataFrame:
    """Rows -> (key, value) for a message sink: anomalies are keyed by run_id, incidents
    and actions by incident_id, heartbeats by agent_name."""
    return df.select(F.col(key_column).cast("string").alias("key"),
                     F.to_json(F.struct(*df.columns)).alias("value"))


def write_messages(messages: DataFrame, format: str, **options) -> None:
    """Appends (key, value) rows to a sink: "kafka" where its connector is installed, or files."""
    messages.write.format(format).options(**options).mode("append").save()
