"""Enumerations and Spark schemas shared by all modules."""

from pyspark.sql import types as T

# The vocabulary of the message contract.
STAGES = ["ingestion", "transformation", "serving"]
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
MODES = ["shadow", "alert_only", "supervised", "full_autonomy"]
ANOMALY_TYPES = [
    "row_count_anomaly",
    "schema_drift",
    "quality_failure",
    "freshness_violation",
    "checksum_mismatch",
]
ACTION_TYPES = [
    "quarantine_partition",
    "trigger_backfill",
    "pause_downstream_dags",
    "create_pagerduty",
    "create_jira",
    "notify_slack",
]

# ---- messages -------------------------------------------------------------

COLUMN_DEF = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("dtype", T.StringType()),
    T.StructField("nullable", T.BooleanType()),
    T.StructField("criticality", T.StringType()),
])

SIGNAL_MESSAGE = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("metrics", T.StructType([
        T.StructField("row_count", T.LongType()),
        T.StructField("checksum", T.StringType()),
        T.StructField("null_rate", T.DoubleType()),
        T.StructField("duration_ms", T.LongType()),
    ])),
    T.StructField("schema_snapshot", T.StructType([
        T.StructField("columns", T.ArrayType(COLUMN_DEF)),
        T.StructField("version_hash", T.StringType()),
    ])),
    T.StructField("pipeline_run_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])

ANOMALY_MESSAGE = T.StructType([
    T.StructField("signal_id", T.StringType()),
    T.StructField("anomaly_type", T.StringType()),
    T.StructField("source_agent", T.StringType()),
    T.StructField("pipeline_run_id", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("details", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])

BLAST_RADIUS = T.StructType([
    T.StructField("affected_models", T.ArrayType(T.StringType())),
    T.StructField("dashboards", T.ArrayType(T.StringType())),
    T.StructField("ml_features", T.ArrayType(T.StringType())),
    T.StructField("next_refresh_time", T.TimestampType()),
    T.StructField("sla_impact", T.StringType()),
])

INCIDENT_MESSAGE = T.StructType([
    T.StructField("incident_id", T.StringType()),
    T.StructField("root_cause", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("pipeline_run_id", T.StringType()),
    T.StructField("correlated_signals", T.ArrayType(ANOMALY_MESSAGE)),
    T.StructField("blast_radius", BLAST_RADIUS),
    T.StructField("llm_hypothesis", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])

# ---- JSON artifacts of a transformation tool --------------------------------

RUN_RESULTS = T.StructType([
    T.StructField("metadata", T.StructType([
        T.StructField("dbt_version", T.StringType()),
        T.StructField("generated_at", T.StringType()),
    ])),
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("unique_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("failures", T.LongType()),
        T.StructField("execution_time", T.DoubleType()),
        T.StructField("message", T.StringType()),
        T.StructField("node", T.StructType([
            T.StructField("name", T.StringType()),
            T.StructField("resource_type", T.StringType()),
            T.StructField("depends_on", T.StructType([
                T.StructField("nodes", T.ArrayType(T.StringType())),
            ])),
            T.StructField("test_metadata", T.StructType([
                T.StructField("name", T.StringType()),
                T.StructField("kwargs", T.StructType([
                    T.StructField("column_name", T.StringType()),
                    T.StructField("model", T.StringType()),
                ])),
            ])),
            T.StructField("config", T.StructType([
                T.StructField("severity", T.StringType()),
                T.StructField("meta", T.StructType([
                    T.StructField("agent_severity", T.StringType()),
                    T.StructField("blast_radius", T.StringType()),
                    T.StructField("oncall_team", T.StringType()),
                ])),
            ])),
        ])),
    ]))),
])

MANIFEST = T.StructType([
    T.StructField("nodes", T.MapType(T.StringType(), T.StructType([
        T.StructField("unique_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("resource_type", T.StringType()),
        T.StructField("schema", T.StringType()),
        T.StructField("database", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("config", T.StructType([
            T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
        ])),
    ]))),
    T.StructField("exposures", T.MapType(T.StringType(), T.StructType([
        T.StructField("unique_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("depends_on", T.StructType([
            T.StructField("nodes", T.ArrayType(T.StringType())),
        ])),
        # an object with a name, or just the name: kept as text, read in `exposures`
        T.StructField("owner", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("meta", T.StructType([T.StructField("sla", T.StringType())])),
    ]))),
    T.StructField("child_map", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("parent_map", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
])
