"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores; query names on
the command line replace the default list, "all" runs every registered query.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tidewatch.plans.queries import QUERIES

HEADLINE = [
    "row_count_anomalies", "row_count_anomalies_orders", "ingestion_anomalies", "rolling_baseline",
    "checksum_mismatches", "partition_checksum", "column_summary", "test_unique", "schema_diff",
    "schema_drift_anomalies", "flakiness", "quality_anomalies", "downstream_models", "downstream_models_tree",
    "blast_radius", "signal_buckets", "confirmed_incidents", "plan_actions", "lineage_incidents",
    "quarantine_split", "reconcile_partitions", "stream_ingestion_anomalies", "stream_buckets"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        # the first run compiles the generated code; the second is timed
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
