"""Response planning: which actions an incident calls for, and what a mode does with them."""

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.keys import stable_id
from tidewatch.functions.severity import disposition, requires_approval

ACTION = ("struct<action_type:string,target:string,full_refresh:boolean,"
          "reason:string,description:string>")


def _action(kind: str, target: Column, description: Column, full_refresh: Column | None = None,
            reason: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(kind).alias("action_type"), target.alias("target"),
        (full_refresh if full_refresh is not None else none).cast("boolean").alias("full_refresh"),
        (reason if reason is not None else none).cast("string").alias("reason"),
        description.alias("description")).cast(ACTION)


def plan_actions(incidents: DataFrame, mode: str) -> DataFrame:
    """One row per action, in the playbook's order.

    Needs incident_id, run_id, severity, root_cause, primary_model and pause_targets
    (array; the playbook pauses at most five).
    """
    severity, cause, model = F.col("severity"), F.col("root_cause"), F.col("primary_model")
    # The texts of targets, reasons and descriptions that action messages carry.
    critical = severity == "CRITICAL"
    notify = _action("notify_slack", F.lit("data-platform"),
                     F.concat(F.lit("Notify #data-platform about "), severity, F.lit(" incident")))
    hold_high = _action(
        "quarantine_partition", model,
        F.concat(F.lit("Quarantine "), model, F.lit(" partition for run "), F.col("run_id")),
        reason=F.concat(cause, F.lit(" detected — severity "), severity))
    hold_critical = _action(
        "quarantine_partition", model, F.concat(F.lit("Quarantine "), model, F.lit(" partition")),
        reason=F.concat(F.lit("CRITICAL: "), cause))
    pauses = F.transform(F.slice("pause_targets", 1, 5), lambda m: _action(
        "pause_downstream_dags", m, F.concat(F.lit("Pause DAG for downstream model "), m)))
    backfill = _action("trigger_backfill", model, F.concat(F.lit("Trigger dbt backfill for "), model),
                       full_refresh=cause.isin("schema_drift", "checksum_mismatch"))
    page = _action("create_pagerduty", F.lit("data-platform-oncall"),
                   F.lit("Create PagerDuty incident for on-call"),
                   reason=F.concat(F.lit("CRITICAL data pipeline failure: "), cause, F.lit(" in "), model))
    none = F.array().cast(f"array<{ACTION}>")
    steps = F.concat(
        F.array(notify),
        F.when(severity == "HIGH", F.array(hold_high)).when(critical, F.array(hold_critical)).otherwise(none),
        F.when(critical & (cause == "schema_drift"), pauses).otherwise(none),
        F.when(critical, F.array(backfill, page)).otherwise(none))
    return (incidents.select("incident_id", F.posexplode(steps).alias("action_seq", "a"))
            .select("incident_id", "action_seq", "a.action_type", "a.target", "a.full_refresh", "a.reason",
                    requires_approval(F.col("a.action_type"), F.lit(mode)).alias("requires_approval"),
                    "a.description"))


def action_disposition(actions: DataFrame, mode: str) -> DataFrame:
    return actions.withColumn(
        "disposition", disposition(F.col("action_type"), F.col("requires_approval"), F.lit(mode)))


def incident_fields(incidents: DataFrame) -> DataFrame:
    """Adds blast_summary and the notification text to enriched incidents.

    An incident without blast columns counts as one whose blast radius is unknown. An
    `llm_hypothesis` column, if there, is quoted up to 300 characters.
    """
    if "n_downstream" in incidents.columns:
        blast = F.concat_ws(
            ", ", F.concat(F.col("n_downstream").cast("string"), F.lit(" models")),
            F.when(F.col("n_dashboards") > 0,
                   F.concat(F.col("n_dashboards").cast("string"), F.lit(" dashboards"))),
            F.when(F.col("sla_impact").isNotNull(), F.concat(F.lit("SLA: "), F.col("sla_impact"))))
    else:
        blast = F.lit("blast radius unknown")
    # The marks of the notification.
    mark = (F.when(F.col("severity") == "CRITICAL", "🚨").when(F.col("severity") == "HIGH", "🔴")
            .when(F.col("severity") == "MEDIUM", "🟡").when(F.col("severity") == "LOW", "🟢")
            .otherwise("⚠️"))
    if "llm_hypothesis" in incidents.columns:
        hypothesis = F.when(F.col("llm_hypothesis") != "", F.concat(
            F.lit("*Hypothesis:* "), F.substring("llm_hypothesis", 1, 300), F.lit("\n")))
        quoted = F.coalesce(hypothesis, F.lit(""))
    else:
        quoted = F.lit("")
    text = F.concat(
        mark, F.lit(" *["), F.col("severity"), F.lit("] Data Pipeline Incident*\n*Root cause:* `"),
        F.col("root_cause"), F.lit("`\n*Model:* `"), F.col("primary_model"), F.lit("` | *Run:* `"),
        F.col("run_id"), F.lit("`\n*Blast radius:* "), F.col("blast_summary"), F.lit("\n"), quoted)
    return incidents.withColumn("blast_summary", blast).withColumn("alert_text", text)


def quarantine_split(table: DataFrame, partition_columns: list, quarantined: DataFrame) -> tuple:
    """(clean, quarantined) rows of a table. Nothing is deleted.

    The partition list is a semi/anti join side; Spark broadcasts it when its measured
    size allows, and otherwise shuffles.
    """
    held = quarantined.select(*partition_columns).distinct()
    return (table.join(held, partition_columns, "left_anti"),
            table.join(held, partition_columns, "left_semi"))


def action_log(disposed: DataFrame, results: DataFrame, executed_at: Column) -> DataFrame:
    """Audit rows of the attempted actions; `results` (incident_id, action_seq, success, error_message)."""
    attempted = disposed.filter(F.col("disposition") == "executed")
    return (attempted.join(results, ["incident_id", "action_seq"], "left")
            .select(stable_id(F.lit("action"), "incident_id", F.col("action_seq").cast("string")).alias("action_id"),
                    "incident_id", "action_type", "target",
                    F.to_json(F.struct("full_refresh", "reason", "description")).alias("payload"),
                    F.coalesce("success", F.lit(False)).alias("success"), "error_message",
                    executed_at.alias("executed_at")))


def incident_actions(log: DataFrame, incident_id) -> DataFrame:
    """Actions of one incident, oldest first."""
    return (log.filter(F.col("incident_id") == incident_id)
            .orderBy("executed_at", "action_id")
            .select("action_type", "target", "success", "error_message", "executed_at"))
