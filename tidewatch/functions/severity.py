"""Column expressions for severities, scores and the response policy.

All of them are `when` chains over built-in functions, so they stay inside
whole-stage code generation.
"""

from pyspark.sql import Column, functions as F

from tidewatch.types import SEVERITIES


def severity_rank(severity: Column) -> Column:
    """LOW 1 .. CRITICAL 4."""
    rank = F.when(severity == SEVERITIES[0], 1)
    for i, name in enumerate(SEVERITIES[1:], start=2):
        rank = rank.when(severity == name, i)
    return rank


def severity_name(rank: Column) -> Column:
    name = F.when(rank == 1, SEVERITIES[0])
    for i, label in enumerate(SEVERITIES[1:], start=2):
        name = name.when(rank == i, label)
    return name


def max_severity(severity: Column) -> Column:
    """Aggregate: the highest severity of a group."""
    return severity_name(F.max(severity_rank(severity)))


def zscore_severity(z: Column) -> Column:
    a = F.abs(z)
    return (F.when(a >= 5.0, "CRITICAL").when(a >= 3.5, "HIGH")
            .when(a >= 2.5, "MEDIUM").otherwise("LOW"))


def failure_count_severity(failures: Column) -> Column:
    return (F.when(failures >= 100000, "CRITICAL").when(failures >= 10000, "HIGH")
            .when(failures >= 100, "MEDIUM").otherwise("LOW"))


def escalate_critical(severity: Column, criticality: Column) -> Column:
    """A change to a column the contract calls critical is CRITICAL."""
    return F.when(criticality == "critical", "CRITICAL").otherwise(severity)


def severity_multiplier(n_downstream: Column, n_dashboards: Column, n_sla: Column) -> Column:
    score = (F.lit(1.0)
             + F.when(n_downstream >= 10, 1.0).when(n_downstream >= 3, 0.5).otherwise(0.0)
             + F.when(n_dashboards >= 1, 0.5).otherwise(0.0)
             + F.when(n_sla >= 1, 0.5).otherwise(0.0))
    return F.least(score, F.lit(3.0))


def escalate_by_blast(severity: Column, multiplier: Column) -> Column:
    """One level up when the blast multiplier is at least 2, CRITICAL at most."""
    rank = severity_rank(severity)
    return severity_name(F.when(multiplier >= 2.0, F.least(rank + 1, F.lit(4))).otherwise(rank))


def requires_approval(action_type: Column, mode: Column) -> Column:
    """Actions that touch data or schedules need a human in supervised mode."""
    touching = action_type.isin("quarantine_partition", "pause_downstream_dags",
                                "trigger_backfill")
    return touching & (mode == "supervised")


def disposition(action_type: Column, approval: Column, mode: Column) -> Column:
    """What a mode does with a planned action: executed, skipped or logged."""
    return (F.when(mode == "shadow", "logged")
            .when((mode == "alert_only") & (action_type != "notify_slack"), "skipped")
            .when((mode == "supervised") & approval, "skipped")
            .otherwise("executed"))
