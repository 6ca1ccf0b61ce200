"""One query per operator, over inputs derived from the warehouse tables.

Every query runs over its whole input and returns flat rows: texts, whole numbers,
rounded doubles, booleans.
"""

import functools

from pyspark.sql import DataFrame, functions as F

from tidewatch.functions import severity as sev
from tidewatch.functions.keys import ts_text
from tidewatch.operators import (
    contracts, correlate, ingestion, lineage, profile, quality, remediate, reports)
from tidewatch.plans import inputs
from tidewatch.sources import artifacts, messages, storage
from tidewatch.streaming import counters, live
from tidewatch.types import MODES, RUN_RESULTS

MONTH = 30 * 86400  # chunk length for sources with one signal per day


def r(column, digits=4):
    return F.round(column, digits).alias(column)


def tally(df: DataFrame, *columns) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def flat_anomalies(df: DataFrame, *extra) -> DataFrame:
    return df.select("signal_id", "anomaly_type", "source_agent", "run_id",
                     F.coalesce("model_name", F.lit("")).alias("model_name"), "severity",
                     r("confidence"), ts_text("ts").alias("ts"), *extra)


# ---- A sources, sinks, decoding ------------------------------------------------

def _flat_signals(df, *extra):
    return df.select(*extra, "event_id", "stage", "source", "run_id", ts_text("ts").alias("ts"), "row_count",
                     F.coalesce("checksum", F.lit("")).alias("checksum"),
                     F.coalesce(F.round("null_rate", 6), F.lit(-1.0)).alias("null_rate"))


def decode_signals(spark, sf):
    decoded = messages.decode_signals(inputs.raw_signals(spark, sf))
    return _flat_signals(decoded, "event_type")


def split_malformed(spark, sf):
    return messages.split_malformed(inputs.raw_signals(spark, sf))


def ingestion_stage_only(spark, sf):
    both = inputs.signals(spark, sf).withColumn(
        "stage", F.when(F.col("row_count") % 2 == 0, "ingestion").otherwise("serving"))
    return _flat_signals(ingestion.ingestion_stage_only(both))


def decode_anomalies(spark, sf):
    return flat_anomalies(messages.decode_anomalies(inputs.raw_anomalies(spark, sf)),
                          F.get_json_object("details", "$.props").alias("props"))


def _incident_messages(spark, sf):
    """Lineage incidents as messages: the signal and the impact on the catalog nested inside."""
    found = inputs.anomalies(spark, sf).filter("model_name IS NOT NULL")
    blast = _catalog_blast(spark, sf, lists=True)
    signal = F.struct("signal_id", "anomaly_type", "source_agent", F.col("run_id").alias("pipeline_run_id"),
                      "model_name", "severity", "confidence", F.struct(F.col("details").alias("props")).alias("details"),
                      F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"))
    return (found.join(blast, "model_name").select(
        F.concat(F.lit("i"), "signal_id").alias("incident_id"), F.col("anomaly_type").alias("root_cause"), "severity",
        F.col("run_id").alias("pipeline_run_id"), F.array(signal).alias("correlated_signals"),
        F.struct("affected_models", "dashboards", "ml_features").alias("blast_radius"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts")))


def decode_incidents(spark, sf):
    """One message in eight is cut short or has an unknown severity, by its id, and is left out."""
    sent = messages.encode_messages(_incident_messages(spark, sf), "incident_id")
    broken = F.substring(F.md5("key"), 1, 1)
    value = (F.when(broken == "0", F.substring("value", 1, 60))
             .when(broken == "1", F.regexp_replace("value", '"severity":"[A-Z]+"', '"severity":"SEVERE"')).otherwise(F.col("value")))
    return messages.decode_incidents(sent.select(value.alias("value"))).select(
        "incident_id", "run_id", ts_text("opened_at").alias("opened_at"), "root_cause", "severity", "n_signals",
        "primary_model", F.size("blast_radius.affected_models").cast("bigint").alias("n_affected"),
        F.element_at("signals", 1)["signal_id"].alias("signal_id"))


def encode_messages(spark, sf):
    """Anomalies, incidents and test results as messages, all fields read back from the JSON text."""
    found = inputs.anomalies(spark, sf).withColumn("ts", ts_text("ts"))
    incidents = confirmed_incidents(spark, sf)
    tests = storage.checkpointed(inputs.test_results(spark, sf), "tests").withColumn("run_at", ts_text("run_at"))
    parts = []
    for kind, rows, key, fields in (
            ("anomaly", found, "run_id", ("signal_id", "anomaly_type", "source_agent", "run_id", "model_name", "severity", "confidence", "ts", "details")),
            ("incident", incidents, "incident_id", ("incident_id", "run_id", "opened_at", "root_cause", "severity", "confidence", "needs_llm", "n_signals", "models", "primary_model")),
            ("test", tests, "unique_id", ("run_id", "unique_id", "test_name", "model_name", "column_name", "status", "failures", "run_at"))):
        sent = messages.encode_messages(rows.select(*fields), key)
        texts = [F.coalesce(F.get_json_object("value", f"$.{c}"), F.lit("")) for c in fields]
        texts = [F.round(t.cast("double"), 4).cast("decimal(9,4)").cast("string") if c == "confidence" else t for t, c in zip(texts, fields)]
        parts.append(sent.select(F.lit(kind).alias("kind"), "key", F.array_join(F.array(*texts), "|").alias("fields")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _flat_tests(df):
    return df.select("run_id", ts_text("run_at").alias("run_at"), F.col("position").cast("bigint").alias("position"),
                     "unique_id", "test_name", "model_name", "column_name", "status", "failures",
                     F.coalesce("message", F.lit("")).alias("message"),
                     F.coalesce("agent_severity", F.lit("")).alias("agent_severity"), "oncall_team")


def read_test_results(spark, sf):
    folder = storage.fresh_folder(spark, "artifacts")
    (inputs.run_artifacts(spark, sf).repartition("run_id")
     .write.partitionBy("run_id").option("maxRecordsPerFile", 1).json(folder))
    return _flat_tests(artifacts.read_test_results(spark, f"{folder}/*/"))


def parse_test_results(spark, sf):
    return _flat_tests(artifacts.parse_test_results(inputs.raw_run_results(spark, sf)))


def resolve_test_models(spark, sf):
    """Test results without nodes, their models looked up in the lineage."""
    tests = storage.checkpointed(inputs.test_results(spark, sf), "tests")
    bare = tests.withColumn("model_name", F.lit("unknown"))
    links = tests.select(F.concat(F.lit("model.shop."), "model_name").alias("parent"),
                         F.col("unique_id").alias("child")).distinct()
    return artifacts.resolve_test_models(bare, links).select("run_id", "unique_id", "model_name", "failures")


def run_ids(spark, sf):
    return artifacts.run_ids(inputs.raw_run_results(spark, sf)).select(
        "run_id", ts_text("generated_at").alias("generated_at"), "dbt_version")


def read_manifest(spark, sf):
    folder = storage.fresh_folder(spark, "manifests")
    (inputs.manifests(spark, sf).repartition("project")
     .write.partitionBy("project").option("maxRecordsPerFile", 1).json(folder))
    found_models, found_exposures, found_edges = artifacts.read_manifest(spark, f"{folder}/*/")
    def rows(df, kind, item, *detail):
        return df.select(F.regexp_extract("project", "project=([^/]+)/", 1).alias("project"), F.lit(kind).alias("kind"), F.col(item).alias("item"),
                         F.array_join(F.array(*detail), "|", "").alias("detail"))

    return (rows(found_models, "model", "uid", "name", "schema", "database", "description", F.array_join("tags", ","), F.element_at("meta", "level"))
            .unionByName(rows(found_exposures, "exposure", "uid", "name", "exposure_type", "description", F.array_join("depends_on", ","), "owner", "url", "sla"))
            .unionByName(rows(found_edges, "edge", "parent", "child")))


def upsert_latest(spark, sf):
    """Latest order per customer: orders before 1999 are the table, later ones the updates."""
    orders = inputs.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    old, new = orders.filter("o_orderdate < '1999-01-01'"), orders.filter("o_orderdate >= '1999-01-01'")
    return storage.upsert_latest(old, new, ["o_custkey"], "o_orderkey").select(
        "o_custkey", "o_orderkey", "o_orderstatus", ts_text("o_orderdate").alias("o_orderdate"))


def append_history(spark, sf):
    """Test history appended in two batches, the second one replayed."""
    history = quality.test_history(storage.checkpointed(inputs.test_results(spark, sf), "tests"))
    folder = storage.fresh_folder(spark, "history")
    first, second = history.filter("run_at < '1998-01-01'"), history.filter("run_at >= '1998-01-01'")
    for batch_id, df in ((0, first), (1, second), (1, second)):
        storage.append_history(df, folder, batch_id)
    return tally(storage.read_history(spark, folder, history.schema), "model_name", "test_name")


# ---- B profiling ----------------------------------------------------------------

def _hour():
    return F.date_trunc("hour", "ts")


def partition_row_count(spark, sf):
    return (profile.partition_row_count(inputs.events(spark, sf), F.col("event_type"), _hour(), "1 HOUR")
            .withColumn("partition", ts_text("partition")))


def partition_checksum(spark, sf):
    return (profile.partition_checksum(inputs.events(spark, sf), F.col("event_type"), _hour(), inputs.EVENT_CHECKSUM)
            .withColumn("partition", ts_text("partition")))


def partition_null_rate(spark, sf):
    orders = inputs.orders_tested(spark, sf)
    return profile.partition_null_rate(
        orders, F.col("o_orderstatus"), F.date_format("o_orderdate", "yyyyMM"), ["priority", "o_custkey"]
    ).withColumn("null_rate", F.round("null_rate", 6))


def column_summary(spark, sf):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "tax"]
    return profile.column_summary(inputs.lines_tested(spark, sf), columns, exact_distinct=True).select(
        "column_name", "n", r("mean"), r("std_dev"), "min", "max", r("null_rate", 6), "n_distinct")


def merged_summary(spark, sf):
    """Three years of lineitem by return flag, from the stored sketches of its months."""
    columns = ["l_quantity", "l_extendedprice", "l_discount", "tax", "l_linenumber"]
    stored = storage.checkpointed(profile.summary_sketches(
        inputs.lines_tested(spark, sf), F.col("l_returnflag"), F.date_format("l_shipdate", "yyyyMM"), columns), "sketches")
    years = stored.filter(F.col("partition").between("199401", "199612"))
    # prices have too many values for a sketch to be exact
    distinct = F.when(F.col("column_name") != "l_extendedprice", F.col("n_distinct")).otherwise(-1)
    return profile.merged_summary(years, ["source"]).select(
        "source", "column_name", "n", r("mean"), r("std_dev"), "min", "max", r("null_rate", 6), distinct.alias("n_distinct"))


def schema_snapshot(spark, sf):
    """Declared columns of lineitem next to the NULLs measured in them."""
    line = inputs.lines_tested(spark, sf)
    declared = profile.schema_snapshot(line, "lineitem")
    rates = profile.partition_null_rate(line, F.lit("lineitem"), F.lit("all"), line.columns)
    return declared.join(rates, ["source", "column_name"]).select(
        "source", F.col("position").cast("bigint").alias("position"), "column_name", "dtype", "nullable",
        r("null_rate", 6))


def build_signals(spark, sf):
    return _flat_signals(inputs.signals(spark, sf))


# ---- C ingestion ----------------------------------------------------------------

def _flat_baseline(df, *extra):
    return df.select("source", "run_id", "row_count", "baseline_n",
                     F.coalesce(F.round("baseline_mean", 4), F.lit(-1.0)).alias("baseline_mean"),
                     F.coalesce(F.round("baseline_std", 4), F.lit(-1.0)).alias("baseline_std"), *extra)


def _scored_columns():
    return [r("baseline_mean", 2), r("baseline_std_dev", 2), r("z_score"), "sample_count"]


def zero_row_anomalies(spark, sf):
    return flat_anomalies(ingestion.zero_row_anomalies(inputs.signals(spark, sf)))


def running_baseline(spark, sf):
    return _flat_baseline(ingestion.running_baseline(inputs.signals(spark, sf)))


def running_baseline_orders(spark, sf):
    return _flat_baseline(ingestion.running_baseline(inputs.signals_orders(spark, sf), MONTH))


def baseline_table(spark, sf):
    return ingestion.baseline_table(inputs.signals_orders(spark, sf)).select(
        "model_name", "source", "metric", r("mean"), r("std_dev"), "sample_count")


def merge_baselines(spark, sf):
    """Baselines of the orders before 1999 folded with the later ones."""
    all_signals = inputs.signals_orders(spark, sf)
    stored = ingestion.baseline_table(all_signals.filter("ts < '1999-01-01'"))
    return ingestion.merge_baselines(stored, all_signals.filter("ts >= '1999-01-01'")).select(
        "model_name", "source", "metric", r("mean"), r("std_dev"), "sample_count")


def z_scores(spark, sf):
    scored = ingestion.z_scores(ingestion.running_baseline(inputs.signals_orders(spark, sf), MONTH))
    return _flat_baseline(scored, F.coalesce(F.round("z_score", 4), F.lit(-99.0)).alias("z_score"), "is_anomalous")


def row_count_anomalies(spark, sf):
    return flat_anomalies(ingestion.row_count_anomalies(inputs.signals(spark, sf)), "row_count", *_scored_columns())


def row_count_anomalies_orders(spark, sf):
    return flat_anomalies(ingestion.row_count_anomalies(inputs.signals_orders(spark, sf), chunk_seconds=MONTH),
                          "row_count", *_scored_columns())


def zscore_severity(spark, sf):
    scored = ingestion.z_scores(ingestion.running_baseline(inputs.signals_orders(spark, sf), MONTH))
    return tally(scored.filter("z_score IS NOT NULL"), sev.zscore_severity(F.col("z_score")).alias("severity"))


def checksum_mismatches(spark, sf):
    return flat_anomalies(ingestion.checksum_mismatches(inputs.signals(spark, sf)),
                          "partition_date", "previous_checksum", "current_checksum")


def ingestion_anomalies(spark, sf):
    return flat_anomalies(ingestion.ingestion_anomalies(inputs.signals(spark, sf)))


def rolling_baseline(spark, sf):
    return _flat_baseline(ingestion.rolling_baseline(inputs.signals(spark, sf)))


def metric_anomalies(spark, sf):
    long = ingestion.to_long_metrics(inputs.signals(spark, sf), ["row_count", "null_rate"])
    return flat_anomalies(ingestion.metric_anomalies(long), "metric", r("value", 6), r("baseline_mean", 4),
                          r("baseline_std_dev", 4), r("z_score"), "sample_count").drop("signal_id")


MONTH_END = "2024-01-31 00:00:00"


def _seen_users(spark, sf):
    return inputs.events(spark, sf).select(
        F.col("user_id").cast("string").alias("source"), F.col("event_id").cast("string").alias("event_id"),
        F.col("event_type").alias("run_id"), "ts")


def freshness_violations(spark, sf):
    """Users as sources: whose events have stopped for a day by the end of January."""
    return flat_anomalies(ingestion.freshness_violations(
        _seen_users(spark, sf), F.to_timestamp(F.lit(MONTH_END)), 86400), "age_seconds")


def arrival_latency(spark, sf):
    return flat_anomalies(ingestion.arrival_latency(inputs.signals_orders(spark, sf), 3.0, chunk_seconds=MONTH),
                          "gap_seconds", r("mean_gap_seconds", 2))


# ---- D schema contracts ---------------------------------------------------------

def _both(spark, sf):
    """Packed snapshots and the first contracts, each stored."""
    packed = inputs.packed_snapshots(spark, sf)
    return packed, storage.checkpointed(contracts.bootstrap_contracts(packed), "contracts")


def _flat_changes(df, *extra):
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return df.select("source", "run_id", "column_name", "change_type", "severity", text("contract_type"),
                     text("incoming_type"), text("contract_nullable"), text("incoming_nullable"),
                     text("criticality"), *extra)


def normalize_snapshot(spark, sf):
    return contracts.normalize_snapshot(inputs.snapshot_signals(spark, sf)).select(
        "source", "run_id", F.col("position").cast("bigint").alias("position"), "column_name", "dtype", "nullable",
        "criticality", "version_hash")


def schema_hash(spark, sf):
    return contracts.schema_hash(inputs.snapshots(spark, sf))


def schema_history(spark, sf):
    return contracts.schema_history(inputs.snapshots(spark, sf)).withColumn("seen_at", ts_text("seen_at"))


def bootstrap_contracts(spark, sf):
    return contracts.bootstrap_contracts(inputs.snapshots(spark, sf))


def accept_contract(spark, sf):
    packed, contract = _both(spark, sf)
    return contracts.accept_contract(contract, inputs.accepted_snapshots(spark, sf, packed))


def hash_gate(spark, sf):
    return contracts.as_rows(contracts.hash_gate(*_both(spark, sf))).select("source", "run_id", "column_name", "version_hash")


def dropped_columns(spark, sf):
    return _flat_changes(contracts.dropped_columns(*_both(spark, sf)))


def type_changes(spark, sf):
    return _flat_changes(contracts.type_changes(*_both(spark, sf)))


def nullable_changes(spark, sf):
    return _flat_changes(contracts.nullable_changes(*_both(spark, sf)))


def new_columns(spark, sf):
    return _flat_changes(contracts.new_columns(*_both(spark, sf)))


def escalate_critical(spark, sf):
    rows = inputs.snapshots(spark, sf)
    return tally(rows, "criticality", sev.escalate_critical(F.lit("HIGH"), F.col("criticality")).alias("severity"))


def schema_diff(spark, sf):
    return _flat_changes(contracts.schema_diff(*_both(spark, sf)), "overall_severity")


def schema_drift_anomalies(spark, sf, gate=True):
    """Snapshots whose declared hash is their contract's are not compared; without the gate the result is the same, later."""
    packed, contract = _both(spark, sf)
    judged = contracts.hash_gate(packed, contract) if gate else packed
    return flat_anomalies(contracts.packed_drift_anomalies(judged, contract), "total_changes", "summary")


def schema_drift_ungated(spark, sf):
    return schema_drift_anomalies(spark, sf, gate=False)


# ---- E tests and quality --------------------------------------------------------

def test_not_null(spark, sf):
    return quality.test_not_null(inputs.orders_tested(spark, sf), inputs.month_run("o_orderdate"), "priority")


def test_unique(spark, sf):
    return quality.test_unique(inputs.lines_tested(spark, sf), inputs.month_run("l_shipdate"),
                               ["l_orderkey", "l_linenumber"])


def test_accepted_values(spark, sf):
    return quality.test_accepted_values(inputs.orders_tested(spark, sf), inputs.month_run("o_orderdate"),
                                        "o_orderstatus", ["F", "O"])


def test_between(spark, sf):
    return quality.test_between(inputs.lines_tested(spark, sf), inputs.month_run("l_shipdate"), "l_discount", 0, 0.09)


def failed_tests(spark, sf):
    return _flat_tests(quality.failed_tests(inputs.test_results(spark, sf)))


def test_history(spark, sf):
    return quality.test_history(inputs.test_results(spark, sf)).select(
        "model_name", "test_name", "run_id", "passed", "failure_rate", ts_text("run_at").alias("run_at"),
        F.col("position").cast("bigint").alias("position"))


def flakiness(spark, sf):
    return quality.flakiness(quality.test_history(inputs.test_results(spark, sf))).withColumn(
        "flakiness_rate", F.round("flakiness_rate", 4))


def _scored(spark, sf):
    tests = storage.checkpointed(inputs.test_results(spark, sf), "tests")
    return quality.test_severity(quality.failed_tests(tests), quality.flakiness(quality.test_history(tests)))


def test_severity(spark, sf):
    return _scored(spark, sf).select("run_id", "model_name", "test_name", "column_name", "failures", "severity",
                                     "is_flaky", "is_new_test")


def quality_anomalies(spark, sf):
    return flat_anomalies(quality.quality_anomalies(_scored(spark, sf)),
                          "total_failed_tests", "genuine_failures", "flaky_failures")


def quality_anomaly_tests(spark, sf):
    return quality.quality_anomaly_tests(_scored(spark, sf)).drop("is_new_test")


def run_summary(spark, sf):
    return quality.run_summary(inputs.test_results(spark, sf))


# ---- F lineage ------------------------------------------------------------------

def models(spark, sf):
    return lineage.models(inputs.manifests(spark, sf)).select(
        "project", "uid", "name", "schema", "database", "description", F.array_join("tags", ",").alias("tags"),
        F.element_at("meta", "level").alias("level"))


def exposures(spark, sf):
    return lineage.exposures(inputs.manifests(spark, sf)).select(
        "project", "uid", "name", "exposure_type", "description", F.array_join("depends_on", ",").alias("depends_on"),
        "owner", "url", F.coalesce("sla", F.lit("")).alias("sla"))


def edges(spark, sf):
    return lineage.edges(inputs.manifests(spark, sf))


def invert_edges(spark, sf):
    return lineage.invert_edges(inputs.table_parents(spark, sf))


def manifest_counts(spark, sf):
    raw = inputs.manifests(spark, sf)
    return lineage.manifest_counts(lineage.models(raw), lineage.exposures(raw))


def resolve_model(spark, sf):
    names = inputs.anomalies(spark, sf).filter("model_name IS NOT NULL").select(F.col("model_name").alias("name"))
    found = lineage.resolve_model(names, lineage.models(inputs.manifests(spark, sf)))
    return found.withColumn("uid", F.coalesce("uid", F.lit("")))


def _all_starts(all_models):
    return all_models.select(F.col("uid").alias("start"))


def downstream_models(spark, sf):
    return lineage.downstream_models(_all_starts(inputs.table_models(spark, sf)), inputs.table_edges(spark, sf))


def downstream_models_tree(spark, sf):
    """Every order's descendants in the order tree: all nodes start at once, log-depth graph."""
    orders = inputs.table(spark, sf, "orders").select(
        F.concat(F.lit("model.o"), F.col("o_orderkey").cast("string")).alias("start"))
    return lineage.downstream_counts(orders, inputs.tree_edges(spark, sf))


def exposures_for_models(spark, sf):
    starts = _all_starts(inputs.table_models(spark, sf))
    down = lineage.downstream_models(starts, inputs.table_edges(spark, sf))
    affected = down.unionByName(starts.withColumn("node", F.col("start")))
    return lineage.exposures_for_models(affected, inputs.table_exposures(spark, sf)).withColumn(
        "sla", F.coalesce("sla", F.lit("")))


def _table_graph(spark, sf):
    return (inputs.table_models(spark, sf), inputs.table_edges(spark, sf), inputs.table_exposures(spark, sf))


def blast_radius(spark, sf):
    all_models, all_edges, all_exposures = _table_graph(spark, sf)
    names = all_models.select(F.col("name").alias("model_name"))
    return lineage.blast_radius(names, all_models, all_edges, all_exposures, lists=False)


def blast_members(spark, sf):
    all_models, all_edges, all_exposures = _table_graph(spark, sf)
    names = all_models.select(F.col("name").alias("model_name"))
    return lineage.blast_members(names, all_models, all_edges, all_exposures)


def _named_models(spark, sf):
    return inputs.anomalies(spark, sf).filter("model_name IS NOT NULL").select("model_name").distinct()


def _catalog(spark, sf):
    """(models, edges, exposures) of the manifests, which are read once."""
    found = artifacts.manifests_from(storage.checkpointed(inputs.manifests(spark, sf)))
    return found[0], found[2], found[1]


def _catalog_blast(spark, sf, lists=False):
    return lineage.blast_radius(_named_models(spark, sf), *_catalog(spark, sf), lists=lists)


def _catalog_members(spark, sf):
    return lineage.blast_members(_named_models(spark, sf), *_catalog(spark, sf))


def blast_radius_lists(spark, sf):
    return _catalog_blast(spark, sf, lists=True).select(
        "model_name", F.coalesce("model_uid", F.lit("")).alias("model_uid"), "n_downstream",
        *[F.array_join(c, ",").alias(c) for c in ("affected_models", "dashboards", "ml_features", "sla_breaches")],
        "severity_multiplier")


def severity_multiplier(spark, sf):
    return tally(blast_radius(spark, sf), sev.severity_multiplier(
        F.col("n_downstream"), F.col("n_dashboards"), F.col("n_sla")).alias("severity_multiplier"))


def escalate_by_blast(spark, sf):
    hit = inputs.anomalies(spark, sf).join(_catalog_blast(spark, sf), "model_name", "left").withColumn(
        "severity_multiplier", F.coalesce("severity_multiplier", F.lit(1.0)))
    return tally(hit, "severity", "severity_multiplier",
                 sev.escalate_by_blast(F.col("severity"), F.col("severity_multiplier")).alias("escalated"))


def _flat_lineage_incidents(df):
    return df.select("incident_id", "run_id", ts_text("opened_at").alias("opened_at"), "root_cause", "severity",
                     r("confidence"), "primary_model", "n_downstream", "n_dashboards", "n_ml", "n_sla",
                     "severity_multiplier")


def lineage_incidents(spark, sf):
    return _flat_lineage_incidents(
        lineage.lineage_incidents(inputs.anomalies(spark, sf), _catalog_blast(spark, sf)))


def impact_text(spark, sf):
    return lineage.impact_text(_catalog_blast(spark, sf, lists=True)).select(
        "model_name", F.coalesce("sla_impact", F.lit("")).alias("sla_impact"), "summary")


# ---- G correlation --------------------------------------------------------------

def _buckets(spark, sf):
    return correlate.signal_buckets(inputs.anomalies(spark, sf))


def signal_buckets(spark, sf):
    return _buckets(spark, sf).select("signal_id", "run_id", "bucket_id", ts_text("opened_at").alias("opened_at"))


def clock_buckets(spark, sf):
    return tally(correlate.clock_buckets(inputs.anomalies(spark, sf)), "run_id",
                 ts_text("window_start").alias("window_start"), ts_text("window_end").alias("window_end"))


def bucket_summary(spark, sf):
    return correlate.bucket_summary(_buckets(spark, sf)).select(
        "bucket_id", "run_id", ts_text("opened_at").alias("opened_at"),
        F.array_join("anomaly_types", ",").alias("anomaly_types"), "severity",
        F.array_join("models", ",").alias("models"), "n_signals")


def suppress_buckets(spark, sf):
    return correlate.suppress_buckets(_buckets(spark, sf))


def correlate_buckets(spark, sf):
    return correlate.correlate(_buckets(spark, sf)).withColumn("confidence", F.round("confidence", 4))


def _flat_incidents(df):
    return df.select("incident_id", "run_id", ts_text("opened_at").alias("opened_at"), "root_cause", "severity",
                     r("confidence"), "needs_llm", "n_signals", F.array_join("models", ",").alias("models"),
                     "primary_model")


def confirmed_incidents(spark, sf):
    return _flat_incidents(correlate.confirmed_incidents(_buckets(spark, sf)))


def incident_signals(spark, sf):
    return correlate.incident_signals(_buckets(spark, sf)).select("incident_id", "signal_id")


def hypothesis_requests(spark, sf):
    buckets = _buckets(spark, sf)
    asked = correlate.hypothesis_requests(buckets, correlate.correlate(buckets))
    detail = F.get_json_object("signal_json", "$.details")
    return asked.select("bucket_id", "signal_id", ts_text("ts").alias("ts"), "anomaly_type", F.coalesce("model_name", F.lit("")).alias("model_name"),
                        "severity", r("confidence"), F.get_json_object(detail, "$.k").alias("detail_k"),
                        *[F.coalesce(F.get_json_object("signal_json", f"$.{c}"), F.lit("")).alias(f"json_{c}") for c in ("anomaly_type", "model_name", "severity")],
                        F.round(F.get_json_object("signal_json", "$.confidence").cast("double"), 4).alias("json_confidence"))


def _members(spark, sf):
    return storage.checkpointed(_catalog_members(spark, sf), "members")


def _enriched(spark, sf, targets=True):
    """The incident table, written once for the steps that read it several times."""
    incidents = storage.checkpointed(correlate.confirmed_incidents(_buckets(spark, sf)), "incidents")
    members = _members(spark, sf)
    enriched = correlate.enriched_incidents(incidents, members)
    return storage.checkpointed(correlate.with_pause_targets(enriched, members) if targets else enriched, "enriched")


def enriched_incidents(spark, sf):
    return _enriched(spark, sf, targets=False).select(
        "incident_id", "root_cause", "severity", "n_downstream", "n_dashboards", "n_ml", "n_sla",
        "severity_multiplier", F.coalesce("sla_impact", F.lit("")).alias("sla_impact"))


def incident_members(spark, sf):
    incidents = storage.checkpointed(correlate.confirmed_incidents(_buckets(spark, sf)), "incidents")
    return correlate.incident_members(incidents, _members(spark, sf))


# ---- H remediation --------------------------------------------------------------

def _planned(spark, sf, mode="supervised"):
    return remediate.plan_actions(_enriched(spark, sf), mode)


def _flat_plan(df, *extra):
    return df.select("incident_id", F.col("action_seq").cast("bigint").alias("action_seq"), "action_type", "target",
                     F.coalesce(F.col("full_refresh").cast("string"), F.lit("")).alias("full_refresh"),
                     F.coalesce("reason", F.lit("")).alias("reason"), "requires_approval", "description", *extra)


def plan_actions(spark, sf):
    return _flat_plan(_planned(spark, sf))


def requires_approval(spark, sf):
    modes = F.explode(F.array(*[F.lit(m) for m in MODES]))
    actions = _planned(spark, sf).select("action_type", modes.alias("mode"))
    needed = sev.requires_approval(F.col("action_type"), F.col("mode"))
    return actions.groupBy("action_type", "mode").agg(
        F.count_if(needed).alias("n_approvals"), F.count(F.lit(1)).alias("n"))


def action_disposition(spark, sf):
    enriched = _enriched(spark, sf)
    parts = [tally(remediate.action_disposition(remediate.plan_actions(enriched, mode), mode), "action_type", "disposition")
             .withColumn("mode", F.lit(mode)) for mode in MODES]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


def incident_fields(spark, sf):
    return remediate.incident_fields(_enriched(spark, sf)).select(
        "incident_id", "primary_model", "blast_summary", "alert_text")


def quarantine_split(spark, sf):
    """Orders of the (priority, day) partitions with a HIGH or CRITICAL count set apart."""
    orders = inputs.table(spark, sf, "orders").withColumn("day", F.date_trunc("day", "o_orderdate"))
    found = ingestion.row_count_anomalies(inputs.signals_orders(spark, sf), chunk_seconds=MONTH)
    held = found.filter(F.col("severity").isin("HIGH", "CRITICAL")).select(
        F.col("model_name").alias("o_orderpriority"), F.col("ts").alias("day"))
    clean, quarantined = remediate.quarantine_split(orders, ["o_orderpriority", "day"], held)
    side = lambda df, name: df.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 1).alias("total")).withColumn("side", F.lit(name))
    return side(clean, "clean").unionByName(side(quarantined, "quarantined"))


def _log(spark, sf):
    incidents = _enriched(spark, sf)
    disposed = remediate.action_disposition(remediate.plan_actions(incidents, "full_autonomy"), "full_autonomy")
    ok = F.col("action_seq") % 3 != 2
    results = (disposed.join(incidents.select("incident_id", "opened_at"), "incident_id").select(
        "incident_id", "action_seq", ok.alias("success"), F.when(~ok, "timed out").alias("error_message"),
        F.timestamp_micros(F.unix_micros("opened_at") + F.col("action_seq") * 1_000_000).alias("at")))
    return storage.checkpointed(remediate.action_log(disposed, results, F.col("at")))


def _flat_log(df, *columns):
    return df.select(*columns, "action_type", "target", "success",
                     F.coalesce("error_message", F.lit("")).alias("error_message"),
                     ts_text("executed_at").alias("executed_at"))


def action_log(spark, sf):
    return _flat_log(_log(spark, sf), "action_id", "incident_id")


def incident_actions(spark, sf):
    """The actions of the incident with the greatest id."""
    log = _log(spark, sf)
    return _flat_log(remediate.incident_actions(log, log.agg(F.max("incident_id")).scalar()))


# ---- I reports ------------------------------------------------------------------

def _incident_table(spark, sf):
    return storage.checkpointed(correlate.confirmed_incidents(_buckets(spark, sf)), "incidents").select(
        "incident_id", "root_cause", "severity",
        F.when(F.col("n_signals") > 1, "open").otherwise("resolved").alias("status"),
        F.col("opened_at").alias("created_at"))


def feedback_report(spark, sf):
    incidents = _incident_table(spark, sf)
    feedback = incidents.select(
        "incident_id", F.when(F.col("severity").isin("HIGH", "CRITICAL"), "true_positive")
        .otherwise("false_positive").alias("feedback"),
        (F.col("created_at") + F.expr("INTERVAL 1 HOUR")).alias("created_at"))
    return reports.feedback_report(feedback, incidents, F.to_timestamp(F.lit("2024-01-31 00:00:00")))


def open_incidents(spark, sf):
    return reports.open_incidents(_incident_table(spark, sf)).withColumn("created_at", ts_text("created_at"))


def recent_actions(spark, sf):
    return reports.recent_actions(_log(spark, sf)).withColumn("executed_at", ts_text("executed_at"))


def agent_status(spark, sf):
    return reports.agent_status(inputs.heartbeats(spark, sf)).withColumn("last_seen", ts_text("last_seen"))


def missing_agents(spark, sf):
    expected = inputs.table(spark, sf, "customer").select(
        F.concat(F.lit("agent_"), F.col("c_custkey").cast("string")).alias("agent_name"))
    return reports.missing_agents(inputs.heartbeats(spark, sf), expected,
                                  F.to_timestamp(F.lit("2024-01-30 00:00:00")))


def stage_counters(spark, sf):
    signals = inputs.signals(spark, sf)
    buckets = _buckets(spark, sf)
    actions = remediate.action_disposition(_planned(spark, sf), "supervised")
    return reports.stage_counters(signals, ingestion.ingestion_anomalies(signals),
                                  correlate.suppress_buckets(buckets), actions)


def reconcile_partitions(spark, sf):
    """Orders against a copy that lost the most expensive ones."""
    orders = inputs.table(spark, sf, "orders")
    parts = (F.col("o_orderpriority"), F.date_format("o_orderdate", "yyyyMM"),
             ["o_orderkey", "o_custkey", "o_orderstatus"])
    return reports.reconcile_partitions(
        profile.profile_partitions(orders, *parts),
        profile.profile_partitions(orders.filter("o_totalprice <= 499000"), *parts), ["source", "partition"])


# ---- J streaming ----------------------------------------------------------------

DAYS = ("2024-01-11", "2024-01-21")


def _replayed(spark, name, df, start, bounds=DAYS, column="ts", format="parquet", schema=None, partition=None, again=False):
    """Publishes df in three parts by time, running the stream to its end after each; `again` publishes every file twice.

    Each run goes on from the checkpoint of the one before. Returns the stream's folders.
    """
    base = storage.fresh_folder(spark, name)
    df = storage.checkpointed(df)
    lo, hi = bounds
    t = F.col(column)
    for part in (t < lo, (t >= lo) & (t < hi), t >= hi):
        rows = df.filter(part)
        if partition:
            writer = rows.repartition(partition).write.partitionBy(partition).option("maxRecordsPerFile", 1)
        else:
            writer = rows.write
        writer.mode("append").format(format).save(f"{base}/in")
        if again:
            (rows.withColumn(partition, F.concat(partition, F.lit("-again"))).repartition(partition).write.partitionBy(partition)
             .option("maxRecordsPerFile", 1).mode("append").format(format).save(f"{base}/in"))
        source = (artifacts.new_artifacts(spark, f"{base}/in/*/", schema, once_within="3650 days" if again else None) if partition
                  else spark.readStream.schema(df.schema).format(format).load(f"{base}/in"))
        query = start(source, base)
        query.awaitTermination()
    return base


_ANOMALY_SCHEMA = ("signal_id string, anomaly_type string, source_agent string, run_id string, model_name string, "
                   "severity string, confidence double, ts timestamp, details string")


def stream_ingestion_anomalies(spark, sf):
    base = _replayed(spark, "ingestion", inputs.signals(spark, sf), lambda s, b: live.stream_ingestion_anomalies(
        s, f"{b}/out", f"{b}/checkpoint"))
    return flat_anomalies(storage.read_history(spark, f"{base}/out", _ANOMALY_SCHEMA))


def live_counters(spark, sf):
    """What the ingestion checks and the stage behind them count while their streams run."""
    counted = counters.StageCounters()
    spark.streams.addListener(counted)
    queries = []

    def kept(query):
        queries.append(query)
        return query

    try:
        base = _replayed(spark, "counted", inputs.signals(spark, sf), lambda s, b: kept(live.stream_ingestion_anomalies(
            reports.observed(s, "ingestion", empty=F.col("row_count") == 0), f"{b}/out", f"{b}/checkpoint")))
        found = spark.readStream.schema(_ANOMALY_SCHEMA).parquet(f"{base}/out")
        kept(live.start(reports.observed(found, "correlation", critical=F.col("severity") == "CRITICAL"),
                        lambda batch, _: batch.write.format("noop").mode("overwrite").save(), f"{base}/next"))
        for query in queries:
            counted.until_end(query)
    finally:
        spark.streams.removeListener(counted)
    return counted.rows(spark)


def stream_freshness(spark, sf):
    """Silent users as the last watermark leaves them, which a clock that is no user brings to the end of January."""
    users = _seen_users(spark, sf).filter(F.col("ts") < F.lit(MONTH_END).cast("timestamp"))
    clock = spark.createDataFrame([("clock", "clock", "clock")], "source string, event_id string, run_id string").withColumn("ts", F.lit(MONTH_END).cast("timestamp"))
    base = _replayed(spark, "fresh", users.unionByName(clock), lambda s, b: live.stream_freshness(s, 86400, f"{b}/out", f"{b}/checkpoint"))
    return flat_anomalies(live.open_violations(spark, f"{base}/out", f"{base}/checkpoint", F.to_timestamp(F.lit(MONTH_END)), 86400), "age_seconds")


def stream_schema_drift_ungated(spark, sf):
    return stream_schema_drift(spark, sf, gate=False)


def stream_schema_drift(spark, sf, gate=True):
    base = _replayed(spark, "drift", inputs.snapshot_signals(spark, sf), lambda s, b: live.stream_schema_drift(
        s, f"{b}/out", f"{b}/checkpoint", gate=gate), ("1997-01-01", "1999-01-01"))
    return flat_anomalies(storage.read_history(spark, f"{base}/out", _ANOMALY_SCHEMA + (
        ", total_changes bigint, summary string")), "total_changes", "summary")


_INCIDENT_SCHEMA = ("incident_id string, bucket_id string, run_id string, opened_at timestamp, root_cause string, "
                    "severity string, confidence double, needs_llm boolean, n_signals bigint, models array<string>, "
                    "primary_model string")


def stream_buckets(spark, sf):
    # the cuts fall inside a run, so buckets stay open from one micro-batch to the next
    base = _replayed(spark, "buckets", inputs.anomalies(spark, sf), lambda s, b: live.stream_buckets(
        s, f"{b}/out", f"{b}/checkpoint"), ("2024-01-10 06:31:00", "2024-01-20 18:42:30"))
    emitted = storage.read_history(spark, f"{base}/out", _INCIDENT_SCHEMA)
    return _flat_incidents(emitted.unionByName(live.flush_buckets(spark, f"{base}/checkpoint")))


def _replayed_runs(spark, sf, name, start, again=False):
    """Test runs published as one artifact file each, in three rounds."""
    runs = inputs.run_artifacts(spark, sf).withColumn("run", F.substring("run_id", 9, 6))
    return _replayed(spark, name, runs, start, ("199701", "199901"), "run", "json", RUN_RESULTS, "run_id", again)


def new_artifacts(spark, sf):
    """Test rows of the artifacts, each read once though every file is published twice."""
    def begin(stream, base):
        return live.start(stream, lambda batch, batch_id: storage.append_history(
            artifacts.parse_test_results(batch), f"{base}/out", batch_id), f"{base}/checkpoint")

    base = _replayed_runs(spark, sf, "published", begin, again=True)
    return _flat_tests(storage.read_history(spark, f"{base}/out", (
        "run_id string, run_at timestamp, position int, unique_id string, test_name string, model_name string, "
        "column_name string, status string, failures bigint, message string, agent_severity string, "
        "oncall_team string")))


def stream_quality(spark, sf):
    base = _replayed_runs(spark, sf, "quality", lambda s, b: live.stream_quality(
        s, f"{b}/out", f"{b}/checkpoint"))
    return flat_anomalies(storage.read_history(spark, f"{base}/out", _ANOMALY_SCHEMA + (
        ", total_failed_tests bigint, genuine_failures bigint, flaky_failures bigint")),
        "total_failed_tests", "genuine_failures", "flaky_failures")


def stream_lineage(spark, sf):
    blast = storage.fresh_folder(spark, "blast")
    _catalog_blast(spark, sf).write.parquet(f"{blast}/version=1")
    base = _replayed(spark, "lineage", inputs.anomalies(spark, sf), lambda s, b: live.stream_lineage(
        s, blast, f"{b}/out", f"{b}/checkpoint"))
    return _flat_lineage_incidents(storage.read_history(spark, f"{base}/out", (
        "incident_id string, run_id string, opened_at timestamp, root_cause string, severity string, "
        "confidence double, primary_model string, n_downstream bigint, n_dashboards bigint, n_ml bigint, "
        "n_sla bigint, severity_multiplier double")))


#: What of the customers the catalog is made of, version by version.
CATALOG_VERSIONS = ["c_nationkey % 3 <> 1 OR c_mktsegment <> 'BUILDING'", "true", "c_nationkey % 4 <> 2 AND c_mktsegment <> 'MACHINERY'"]


def stream_manifests(spark, sf):
    """Blast counts after each of three publications of the manifests, the latter two updated from the one before."""
    base = storage.fresh_folder(spark, "manifests")
    parts = None
    for n, keep in enumerate(CATALOG_VERSIONS, start=1):
        rows = inputs.manifests(spark, sf, keep).withColumn("published_at", F.lit(f"2024-01-0{n} 00:00:00").cast("timestamp"))
        rows.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        live.stream_manifests(stream, f"{base}/blast", f"{base}/checkpoint").awaitTermination()
        now = storage.checkpointed(live.latest_blast(spark, f"{base}/blast").withColumn("version", F.lit(n).cast("bigint")))
        parts = now if parts is None else parts.unionByName(now)
    return parts.select("version", "model_name", "model_uid", "n_downstream", "n_dashboards", "n_ml", "n_sla", "severity_multiplier")


def emit_gate(spark, sf):
    found = inputs.anomalies(spark, sf)
    parts = [tally(live.emit_gate(found, mode), "severity").withColumn("mode", F.lit(mode))
             for mode in MODES]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


def late_signals(spark, sf):
    """Signals of every third hour are published a round late."""
    signals = inputs.signals(spark, sf)
    shifted = F.when(F.hour("ts") % 3 == 0, F.col("ts") + F.expr("INTERVAL 10 DAYS")).otherwise(F.col("ts"))
    arrived = signals.withColumn("arrived", shifted)
    base = _replayed(spark, "late", arrived, lambda s, b: live.late_signals(
        s, 86400, f"{b}/out", f"{b}/checkpoint"), column="arrived")
    schema = "source string, ts timestamp, is_late boolean"
    rows = storage.read_history(spark, f"{base}/out/on_time", schema).unionByName(storage.read_history(spark, f"{base}/out/late", schema))
    return tally(rows, "source", "is_late")


QUERIES = {
    "decode_signals": decode_signals, "split_malformed": split_malformed,
    "ingestion_stage_only": ingestion_stage_only, "decode_anomalies": decode_anomalies,
    "decode_incidents": decode_incidents, "encode_messages": encode_messages,
    "read_test_results": read_test_results, "read_manifest": read_manifest,
    "upsert_latest": upsert_latest, "append_history": append_history,
    "partition_row_count": partition_row_count, "partition_checksum": partition_checksum,
    "partition_null_rate": partition_null_rate, "column_summary": column_summary, "merged_summary": merged_summary,
    "schema_snapshot": schema_snapshot, "build_signals": build_signals,
    "zero_row_anomalies": zero_row_anomalies, "running_baseline": running_baseline,
    "running_baseline_orders": running_baseline_orders, "baseline_table": baseline_table,
    "merge_baselines": merge_baselines, "z_scores": z_scores, "row_count_anomalies": row_count_anomalies,
    "row_count_anomalies_orders": row_count_anomalies_orders, "zscore_severity": zscore_severity,
    "checksum_mismatches": checksum_mismatches, "ingestion_anomalies": ingestion_anomalies,
    "rolling_baseline": rolling_baseline, "metric_anomalies": metric_anomalies,
    "freshness_violations": freshness_violations, "arrival_latency": arrival_latency,
    "normalize_snapshot": normalize_snapshot, "schema_hash": schema_hash, "schema_history": schema_history,
    "bootstrap_contracts": bootstrap_contracts, "accept_contract": accept_contract, "hash_gate": hash_gate,
    "dropped_columns": dropped_columns, "type_changes": type_changes, "nullable_changes": nullable_changes,
    "new_columns": new_columns, "escalate_critical": escalate_critical, "schema_diff": schema_diff,
    "schema_drift_anomalies": schema_drift_anomalies, "schema_drift_ungated": schema_drift_ungated,
    "test_not_null": test_not_null, "test_unique": test_unique, "test_accepted_values": test_accepted_values,
    "test_between": test_between, "resolve_test_models": resolve_test_models, "parse_test_results": parse_test_results, "run_ids": run_ids,
    "failed_tests": failed_tests, "test_history": test_history, "flakiness": flakiness,
    "test_severity": test_severity, "quality_anomalies": quality_anomalies,
    "quality_anomaly_tests": quality_anomaly_tests, "run_summary": run_summary,
    "models": models, "exposures": exposures, "edges": edges, "invert_edges": invert_edges,
    "resolve_model": resolve_model, "downstream_models": downstream_models,
    "downstream_models_tree": downstream_models_tree, "exposures_for_models": exposures_for_models,
    "blast_radius": blast_radius, "blast_members": blast_members, "blast_radius_lists": blast_radius_lists,
    "severity_multiplier": severity_multiplier, "escalate_by_blast": escalate_by_blast,
    "lineage_incidents": lineage_incidents, "impact_text": impact_text, "manifest_counts": manifest_counts,
    "signal_buckets": signal_buckets, "clock_buckets": clock_buckets, "bucket_summary": bucket_summary,
    "suppress_buckets": suppress_buckets, "correlate": correlate_buckets,
    "confirmed_incidents": confirmed_incidents, "incident_signals": incident_signals,
    "hypothesis_requests": hypothesis_requests, "enriched_incidents": enriched_incidents,
    "incident_members": incident_members,
    "plan_actions": plan_actions, "requires_approval": requires_approval,
    "action_disposition": action_disposition, "incident_fields": incident_fields,
    "quarantine_split": quarantine_split, "action_log": action_log, "incident_actions": incident_actions,
    "feedback_report": feedback_report, "open_incidents": open_incidents, "recent_actions": recent_actions,
    "agent_status": agent_status, "missing_agents": missing_agents, "stage_counters": stage_counters, "live_counters": live_counters,
    "reconcile_partitions": reconcile_partitions,
    "stream_ingestion_anomalies": stream_ingestion_anomalies, "stream_schema_drift": stream_schema_drift,
    "stream_schema_drift_ungated": stream_schema_drift_ungated, "stream_freshness": stream_freshness,
    "stream_buckets": stream_buckets, "stream_quality": stream_quality, "new_artifacts": new_artifacts,
    "stream_lineage": stream_lineage, "stream_manifests": stream_manifests, "emit_gate": emit_gate, "late_signals": late_signals,
}
