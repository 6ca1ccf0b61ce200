"""JSON artifacts of a transformation tool: test results and lineage manifests."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidewatch.operators import lineage
from tidewatch.types import MANIFEST, RUN_RESULTS


def run_ids(raw: DataFrame, received_at: Column | None = None) -> DataFrame:
    """Raw run results plus run_id, generated_at and dbt_version of each artifact."""
    now = F.current_timestamp() if received_at is None else received_at
    at = F.coalesce(F.try_to_timestamp(F.col("metadata.generated_at")), now)
    return raw.select(
        F.concat(F.lit("dbt-run-"), F.date_format(at, "yyyyMMddHHmmss")).alias("run_id"),
        at.alias("generated_at"), F.col("metadata.dbt_version").alias("dbt_version"),
        *[c for c in raw.columns if c != "metadata"])


def parse_test_results(raw: DataFrame, received_at: Column | None = None) -> DataFrame:
    """One row per test result; results of models and other nodes are left out."""
    rows = run_ids(raw, received_at).select("run_id", "generated_at", F.posexplode("results").alias("position", "r"))
    upstream = F.try_element_at(
        F.filter("r.node.depends_on.nodes", lambda n: n.startswith(lineage.MODEL_PREFIX)), F.lit(1))
    return rows.filter(F.col("r.unique_id").startswith("test.")).select(
        "run_id", F.col("generated_at").alias("run_at"), "position",
        F.col("r.unique_id").alias("unique_id"),
        F.coalesce("r.node.test_metadata.name", "r.node.name", F.lit("unknown")).alias("test_name"),
        F.coalesce(F.element_at(F.split(upstream, r"\."), -1), "r.node.name", F.lit("unknown")).alias("model_name"),
        F.col("r.node.test_metadata.kwargs.column_name").alias("column_name"),
        F.coalesce("r.status", F.lit("unknown")).alias("status"),
        F.coalesce("r.failures", F.lit(0)).alias("failures"),
        F.coalesce("r.execution_time", F.lit(0.0)).alias("execution_time"),
        F.col("r.message").alias("message"),
        F.col("r.node.config.meta.agent_severity").alias("agent_severity"),
        F.col("r.node.config.meta.blast_radius").alias("blast_radius"),
        F.col("r.node.config.meta.oncall_team").alias("oncall_team"))


def resolve_test_models(tests: DataFrame, edges: DataFrame) -> DataFrame:
    """Finds the model of results that came without their node, from the lineage edges.

    A test is a child of the models it checks; of several, the first by id is taken.
    """
    checked = (edges.filter(F.col("parent").startswith(lineage.MODEL_PREFIX))
               .groupBy(F.col("child").alias("unique_id")).agg(F.min("parent").alias("_uid")))
    found = F.when(F.col("model_name") == "unknown", F.element_at(F.split("_uid", r"\."), -1))
    return (tests.join(checked, "unique_id", "left")
            .withColumn("model_name", F.coalesce(found, "model_name")).select(*tests.columns))


def read_test_results(spark: SparkSession, path: str) -> DataFrame:
    """Test rows of all run-results artifacts under a path or glob."""
    return parse_test_results(spark.read.schema(RUN_RESULTS).option("multiLine", "true").json(path))


def manifests_from(raw: DataFrame) -> tuple:
    """(models, exposures, edges) of raw manifests with a project column."""
    return lineage.models(raw), lineage.exposures(raw), lineage.edges(raw)


def read_manifest(spark: SparkSession, path: str) -> tuple:
    """(models, exposures, edges) of all manifests under a path or glob; project = its file."""
    return manifests_from(read_raw_manifests(spark, path))


def read_raw_manifests(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema(MANIFEST).option("multiLine", "true").json(path)
            .withColumn("project", F.col("_metadata.file_path")))


def new_artifacts(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None, once_within: str | None = None) -> DataFrame:
    """Stream of artifacts, each file read once as it is published under `path` (a glob of run folders).

    With `once_within`, say "7 days", a file whose content was published before within that time gives no rows; one with
    changed content does. What folder it lies in doesn't matter.
    """
    reader = spark.readStream.schema(schema).option("multiLine", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    published = reader.json(path)
    if once_within is None:
        return published
    content = F.sha2(F.to_json(F.struct(*schema.fieldNames())), 256)
    marked = published.select("*", content.alias("_content"), F.col("_metadata.file_modification_time").alias("_published"))
    return marked.withWatermark("_published", once_within).dropDuplicatesWithinWatermark(["_content"]).drop("_content", "_published")
