"""Folding the anomalies of one run into incidents.

A bucket is a window of fixed length that opens with the first anomaly of a run not
covered by an earlier bucket. Neither `window` (clock-aligned) nor `session_window`
(extends with every row) gives these.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.functions.keys import stable_id
from tidewatch.functions.severity import escalate_by_blast, max_severity, severity_multiplier
from tidewatch.sources.storage import checkpointed
from tidewatch.types import ANOMALY_TYPES

# Correlation rules, first match wins (types that must be present, cause, confidence).
RULES = [
    (("schema_drift", "row_count_anomaly"), "schema_drift", 0.95),
    (("schema_drift", "quality_failure"), "schema_drift", 0.92),
    (("schema_drift", "row_count_anomaly", "quality_failure"), "schema_drift", 0.97),
    (("checksum_mismatch",), "checksum_mismatch", 0.99),
    (("freshness_violation", "row_count_anomaly"), "freshness_violation", 0.90),
]


# ---- anchored windows -------------------------------------------------------

_SCAN = "kind int, run_id string, part int, x bigint, y bigint, z bigint"
#: Kinds of scanned rows: where a run stands as its partition ends (x: window start), what becomes of a start (x: the start, y: the last one
#: that follows from it in the partition), a time (x), the window of a block (x: block, y: start in it, z: start before it).
_OPEN, _LEADS, _TIME, _BLOCK = range(4)


def _chain(times: np.ndarray, at: int, width: int) -> np.ndarray:
    """Window starts in sorted times, from the one at a place on."""
    found = []
    while at < len(times):
        found.append(times[at])
        at = int(np.searchsorted(times, times[at] + width))
    return np.array(found, dtype=np.int64)


def _leads(times: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The times that may be the first start of a part of a run, and the last start that each of them leads to.

    A window that is open as the part begins ends before the part's first time plus a width, so the first start is
    one of the times up to there or the next one.
    """
    following = np.searchsorted(times, times + width)
    last = np.where(following == len(times), np.arange(len(times)), following)
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    few = min(len(times), int(np.searchsorted(times, times[0] + width)) + 1)
    return times[:few], times[last[:few]]


def _block_rows(run: str, part: int, times: np.ndarray, starts: np.ndarray, earlier: int | None, width: int) -> pa.RecordBatch:
    """For each block with times of a run: the start in it, if any, and the one before."""
    blocks, of = np.unique(times // width), starts // width
    at = np.searchsorted(of, blocks)
    own = (at < len(of)) & (np.append(of, 0)[at] == blocks)
    before = np.where(at > 0, np.append(starts, 0)[at - 1], 0 if earlier is None else earlier)
    return _scan_rows(_BLOCK, run, part, blocks, pa.array(np.append(starts, 0)[at], mask=~own),
                      pa.array(before, mask=(at == 0) & (earlier is None)))


def _scan_rows(kind: int, run: str, part: int, x: np.ndarray, y=None, z=None) -> pa.RecordBatch:
    n = len(x)
    fill = lambda v: pa.nulls(n, pa.int64()) if v is None else v if isinstance(v, pa.Array) else pa.array(v, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.repeat(pa.scalar(run, pa.string()), n), pa.array(np.full(n, part, np.int32)),
         fill(x), fill(y), fill(z)], names=["kind", "run_id", "part", "x", "y", "z"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
    """The times of each run of a partition sorted by (run_id, us), a run at a time."""
    run, held = None, []
    for batch in batches:
        names, us = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        if not len(us):
            continue
        new = np.concatenate([[0], np.flatnonzero(pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)) + 1, [len(us)]])
        for i, j in zip(new[:-1], new[1:]):
            name = names[int(i)].as_py()
            if name != run and held:
                yield run, np.concatenate(held)
                held = []
            run = name
            held.append(us[i:j])
    if held:
        yield run, np.concatenate(held)


def _scan(width: int):
    """One pass over the sorted times of a partition. Every run but the first begins in it, so its windows are known; for the
    first one, which may go on from the partition before, the pass keeps what each possible start leads to."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, starts = TaskContext.get().partitionId(), None, None
        for n, (run, times) in enumerate(_runs(batches)):
            if n == 0:
                yield _scan_rows(_TIME, run, part, times)
                yield _scan_rows(_LEADS, run, part, *_leads(times, width))
                continue
            starts = _chain(times, 0, width)
            yield _block_rows(run, part, times, starts, None, width)
        if starts is not None:
            yield _scan_rows(_OPEN, run, part, starts[-1:])
    return scan


def _carry(width: int):
    """Follows each run over its partitions: the window start that is open as each begins. A partition is one lookup in its leads."""
    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, part, start, done = None, None, None, False
        for batch in batches:
            for kind, name, where, x, y in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if name != run:
                    run, part, start = name, None, None
                if kind == _OPEN:
                    start = x
                    continue
                if where != part:
                    part, done = where, False
                    yield _scan_rows(_OPEN, run, part, pa.array([start], pa.int64()))
                if not done and (start is None or x >= start + width):
                    start, done = y, True
    return carry


def _settle(width: int):
    """Windows of the first run of each partition, once the start is known that is open as it begins."""
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, start, held = None, None, None, []

        def settled():
            times = np.concatenate(held)
            first = 0 if start is None else int(np.searchsorted(times, start + width))
            return _block_rows(run, part, times, _chain(times, first, width), start, width)
        for batch in batches:
            parts, x = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            new = np.flatnonzero(np.diff(parts, prepend=-1 if part is None else part))
            for i, j in zip([0, *new[new > 0]], [*new[new > 0], len(parts)]):
                if i == j:
                    continue
                if parts[i] != part:  # its first row says what is open
                    if held:
                        yield settled()
                    part, run, start = int(parts[i]), batch.column(1)[int(i)].as_py(), batch.column(3)[int(i)].as_py()
                    held, i = [], i + 1
                held.append(x[i:j].astype(np.int64))
        if held:
            yield settled()
    return settle


def signal_buckets(anomalies: DataFrame, seconds: int = 300) -> DataFrame:
    """Adds bucket_id and opened_at to every anomaly.

    1. The distinct times of all runs are sorted by range, a run over as many partitions as its size asks for, and each
       partition is passed once. Runs that begin in it are done. For the one that goes on from the partition before, the pass
       keeps the window start that each possible carry leads to.
    2. Carries are followed over the partitions of a run by one lookup each, and the partitions it runs through get
       their windows.
    3. A block being a clock interval as long as a window, two starts never share one, so a row's start is that of its own
       block or the one before: one join on (run, block) places all rows. Skewed (run, block) pairs can be split by AQE.
    """
    width = seconds * 1_000_000
    rows = (anomalies.withColumn("_us", F.unix_micros("ts"))
            .withColumn("_blk", F.floor(F.col("_us") / width)))
    times = rows.filter(F.col("run_id").isNotNull()).select("run_id", F.col("_us").alias("us")).distinct()
    scanned = checkpointed(times.repartitionByRange("run_id", "us").sortWithinPartitions("run_id", "us").mapInArrow(_scan(width), _SCAN), "scan")
    open_ = F.col("kind").isin(_OPEN, _LEADS)
    carried = (scanned.filter(open_).repartition("run_id").sortWithinPartitions("run_id", "part", F.desc("kind"), "x")
               .mapInArrow(_carry(width), _SCAN))
    settled = (scanned.filter(F.col("kind") == _TIME).unionByName(carried).repartition("part").sortWithinPartitions("part", "kind", "x")
               .mapInArrow(_settle(width), _SCAN))
    # a block that two partitions share has a row of each
    placed = (scanned.filter(F.col("kind") == _BLOCK).unionByName(settled)
              .groupBy("run_id", F.col("x").alias("_blk")).agg(F.max("y").alias("start"), F.min("z").alias("earlier")))
    opened = F.when(F.col("_us") >= F.col("start"), F.col("start")).otherwise(F.col("earlier"))
    return (rows.join(placed, ["run_id", "_blk"])
            .withColumn("_opened", opened)
            .select(*anomalies.columns,
                    stable_id(F.lit("bucket"), "run_id", F.col("_opened").cast("string")).alias("bucket_id"),
                    F.timestamp_micros("_opened").alias("opened_at")))


def clock_buckets(anomalies: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Clock-aligned tumbling windows."""
    return (anomalies.withColumn("_w", F.window("ts", width))
            .select(*anomalies.columns, F.col("_w.start").alias("window_start"),
                    F.col("_w.end").alias("window_end")))


# ---- bucket facts -----------------------------------------------------------

def _has(kind: str):
    return F.bool_or(F.col("anomaly_type") == kind).alias(f"has_{kind}")


def bucket_facts(bucketed: DataFrame) -> DataFrame:
    """Everything the rules need about a bucket, in one aggregation with map-side combine.

    All parts are of fixed size but `models`, the distinct model names of the bucket.
    """
    low = (F.col("severity") == "LOW") & (F.col("confidence") < 0.6)
    return bucketed.groupBy("bucket_id", "run_id", "opened_at").agg(
        *[_has(kind) for kind in ANOMALY_TYPES],
        max_severity(F.col("severity")).alias("severity"),
        F.count(F.lit(1)).alias("n_signals"),
        F.bool_and(low).alias("suppressed"),
        F.min(F.struct("ts", "signal_id", "anomaly_type", "confidence", "model_name")).alias("first"),
        F.sort_array(F.collect_set(F.when(F.col("model_name") != "", F.col("model_name")))).alias("models"))


def _with_types(facts: DataFrame) -> DataFrame:
    kinds = F.filter(F.array(*[F.when(F.col(f"has_{k}"), F.lit(k)) for k in sorted(ANOMALY_TYPES)]),
                     lambda k: k.isNotNull())
    return facts.withColumn("anomaly_types", kinds)


def bucket_summary(bucketed: DataFrame) -> DataFrame:
    return _with_types(bucket_facts(bucketed)).select(
        "bucket_id", "run_id", "opened_at", "anomaly_types", "severity", "models", "n_signals")


def suppress_buckets(bucketed: DataFrame) -> DataFrame:
    """A bucket is noise if all its signals are LOW with confidence under 0.6."""
    return bucket_facts(bucketed).select("bucket_id", "suppressed")


def _ruled(facts: DataFrame) -> DataFrame:
    single = F.col("n_signals") == 1
    cause = F.when(single, F.col("first.anomaly_type"))
    confidence = F.when(single, F.col("first.confidence"))
    for kinds, name, value in RULES:
        present = F.lit(True)
        for kind in kinds:
            present = present & F.col(f"has_{kind}")
        cause = cause.when(present, name)
        confidence = confidence.when(present, value)
    return (facts.withColumn("root_cause", cause.otherwise("unknown"))
            .withColumn("confidence", confidence.otherwise(0.5))
            .withColumn("needs_llm", F.col("root_cause") == "unknown"))


def correlate(bucketed: DataFrame) -> DataFrame:
    """Root cause of each bucket by the fixed rules; undecided ones need a hypothesis."""
    return _ruled(bucket_facts(bucketed)).select("bucket_id", "root_cause", "confidence", "needs_llm")


def incidents_from_facts(facts: DataFrame) -> DataFrame:
    return _ruled(facts.filter(~F.col("suppressed"))).select(
        stable_id(F.lit("incident"), "bucket_id").alias("incident_id"), "bucket_id", "run_id", "opened_at",
        "root_cause", "severity", "confidence", "needs_llm", "n_signals", "models",
        F.coalesce(F.nullif(F.col("first.model_name"), F.lit("")), F.lit("unknown")).alias("primary_model"))


def confirmed_incidents(bucketed: DataFrame) -> DataFrame:
    """Incidents of all buckets that are not suppressed."""
    return incidents_from_facts(bucket_facts(bucketed))


def incident_signals(bucketed: DataFrame) -> DataFrame:
    """The signals behind each incident, as rows (incident_id, signal_id, ...)."""
    return bucketed.withColumn("incident_id", stable_id(F.lit("incident"), "bucket_id"))


def hypothesis_requests(bucketed: DataFrame, correlated: DataFrame) -> DataFrame:
    """The signals of undecided buckets, for an outside model to explain: one row each, in the order (ts, signal_id).

    `signal_json` is the signal as the request lists it, its details an object inside.
    """
    asked = correlated.filter("needs_llm").select("bucket_id")
    signal = F.struct("anomaly_type", "model_name", "severity", "confidence",
                      F.try_parse_json("details").alias("details"))
    return (bucketed.join(asked, "bucket_id", "left_semi")
            .select("bucket_id", "ts", "signal_id", "anomaly_type", "model_name", "severity", "confidence", "details",
                    F.to_json(signal).alias("signal_json")))


def packed_requests(requests: DataFrame) -> DataFrame:
    """(bucket_id, n_signals, signals_json): each bucket's request as the one list that a sink sends.

    A message holds all signals of its bucket, so this is for the sink alone; steps in between use the rows.
    """
    return (requests.groupBy("bucket_id").agg(
        F.count(F.lit(1)).alias("n_signals"),
        F.sort_array(F.collect_list(F.struct("ts", "signal_id", "signal_json"))).alias("s"))
        .select("bucket_id", "n_signals", F.concat(F.lit("["), F.array_join(
            F.transform("s", lambda e: e["signal_json"]), ","), F.lit("]")).alias("signals_json")))


def _model_sets(incidents: DataFrame) -> DataFrame:
    """The distinct sets of models of the incidents: many incidents share one."""
    return incidents.select("models").distinct().withColumn("set_id", stable_id(F.array_join("models", "\n")))


def set_members(incidents: DataFrame, members: DataFrame) -> DataFrame:
    """Blast members of each distinct set of models: (set_id, kind, member). Its size follows the catalog, not the incidents."""
    of = _model_sets(incidents).select("set_id", F.explode("models").alias("model_name"))
    return of.join(members, "model_name").select("set_id", "kind", "member").distinct()


def incident_members(incidents: DataFrame, members: DataFrame) -> DataFrame:
    """Blast members of all models of each incident, distinct: (incident_id, kind, member)."""
    sets = incidents.select("incident_id", stable_id(F.array_join("models", "\n")).alias("set_id"))
    return sets.join(set_members(incidents, members), "set_id").select("incident_id", "kind", "member")


def enriched_incidents(incidents: DataFrame, members: DataFrame) -> DataFrame:
    """Incidents with the counts of the union of their models' blast radii, and the severity it implies.

    `members` is the long-form blast radius (lineage.blast_members); `incident_members` has the members
    themselves. Everything is found once per distinct set of models and joined to the incidents.
    """
    union = set_members(incidents, members)
    kinds = union.groupBy("set_id").agg(*[
        F.count_if(F.col("kind") == kind).alias(name) for kind, name in (
            ("affected_model", "n_downstream"), ("dashboard", "n_dashboards"),
            ("ml_feature", "n_ml"), ("sla_breach", "n_sla"))],
        F.sort_array(F.collect_list(F.when(F.col("kind") == "sla_breach", F.col("member")))).alias("_sla"))
    counts = ["n_downstream", "n_dashboards", "n_ml", "n_sla"]
    joined = (incidents.withColumn("set_id", stable_id(F.array_join("models", "\n"))).join(kinds, "set_id", "left")
              .withColumn("sla_impact", F.when(F.size("_sla") > 0, F.concat(
                  F.lit("SLA at risk: "), F.array_join("_sla", ", ")))).drop("_sla", "set_id"))
    for c in counts:
        joined = joined.withColumn(c, F.coalesce(c, F.lit(0)))
    multiplier = severity_multiplier(F.col("n_downstream"), F.col("n_dashboards"), F.col("n_sla"))
    return (joined.withColumn("severity_multiplier", multiplier)
            .withColumn("severity", escalate_by_blast(F.col("severity"), F.col("severity_multiplier"))))


def with_pause_targets(incidents: DataFrame, members: DataFrame, most: int = 5) -> DataFrame:
    """Adds `pause_targets`, the first affected models by name: the playbook pauses at most five."""
    by_name = Window.partitionBy("set_id").orderBy("member")
    targets = (set_members(incidents, members).filter(F.col("kind") == "affected_model")
               .withColumn("_r", F.row_number().over(by_name)).filter(F.col("_r") <= most)
               .groupBy("set_id").agg(F.sort_array(F.collect_list("member")).alias("pause_targets")))
    return (incidents.withColumn("set_id", stable_id(F.array_join("models", "\n"))).join(targets, "set_id", "left").drop("set_id")
            .withColumn("pause_targets", F.coalesce("pause_targets", F.array().cast("array<string>"))))
