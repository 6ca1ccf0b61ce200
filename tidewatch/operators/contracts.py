"""Schema contracts and drift.

Snapshot rows are (source, run_id, ts, position, column_name, dtype, nullable,
criticality, version_hash); a contract is (source, column_name, dtype, nullable,
criticality). Both have one row per column. Snapshots may also come packed: one row per
(source, run_id) with ts, version_hash and its column rows as the array `columns`, whose size
is the width of one table.
"""

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.keys import once, stable_id
from tidewatch.functions.severity import escalate_critical, max_severity
from tidewatch.types import SEVERITIES

SNAPSHOT_KEY = ["source", "run_id", "column_name"]
ROW_COLUMNS = ["source", "run_id", "ts", "position", "column_name", "dtype", "nullable", "criticality", "version_hash"]
CONTRACT_COLUMNS = ["source", "column_name", "dtype", "nullable", "criticality"]
CHANGE_COLUMNS = ["source", "run_id", "column_name", "change_type", "severity", "contract_type",
                  "incoming_type", "contract_nullable", "incoming_nullable", "criticality"]

# Order of the changes in a report, and their base severity.
CHANGE_ORDER = {"dropped_column": 0, "type_changed": 1, "nullable_changed": 1, "new_column": 2}
CHANGE_SEVERITY = {"dropped_column": "CRITICAL", "type_changed": "HIGH",
                   "nullable_changed": "MEDIUM", "new_column": "LOW"}


def normalize_snapshot(signals: DataFrame) -> DataFrame:
    """Explodes snapshot columns into rows with defaults; the last of equal names wins.

    Equal names inside a signal are settled in its array; only runs with several signals are grouped. The
    signals are read for each of these steps, so they are better stored.
    """
    alone, several = only_signals(signals)
    return as_rows(packed_signals(alone)).unionByName(last_per_column(_exploded(several)))


def only_signals(signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signals with a snapshot that are the only such one of their run, and the others."""
    given = signals.filter(F.col("columns").isNotNull())
    repeated = (given.groupBy(F.col("source").alias("_source"), F.col("run_id").alias("_run"))
                .agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("run_id").eqNullSafe(F.col("_run"))
    return given.join(repeated, same, "left_anti"), given.join(repeated, same, "left_semi")


def _column_fields(c: Column, position: Column) -> list[Column]:
    return [F.coalesce(c["name"], F.lit("")).alias("column_name"), position.alias("position"),
            F.coalesce(c["type"], c["dtype"], F.lit("VARCHAR")).alias("dtype"),
            F.coalesce(c["nullable"], F.lit(True)).alias("nullable"),
            F.coalesce(c["criticality"], F.lit("standard")).alias("criticality")]


def _exploded(signals: DataFrame) -> DataFrame:
    return (signals.select("source", "run_id", "ts", "version_hash", F.posexplode("columns").alias("at", "c"))
            .select("source", "run_id", "ts", "version_hash", *_column_fields(F.col("c"), F.col("at")))
            .select(*ROW_COLUMNS))


def packed_signals(signals: DataFrame) -> DataFrame:
    """Signals, each the only one of its run, as packed snapshots; the last of equal names wins."""
    given = F.transform("columns", lambda c, i: F.struct(*_column_fields(c, i)))
    return last_per_name(signals.select("source", "run_id", "ts", "version_hash", given.alias("columns")))


def last_per_name(packed: DataFrame) -> DataFrame:
    """Packed snapshots by column name, with the last column of each name only."""
    after = lambda i: F.get(F.col("_sorted"), i + 1)["column_name"]
    last = F.filter("_sorted", lambda c, i: ~c["column_name"].eqNullSafe(after(i)) | (i + 1 == F.size("_sorted")))
    return (packed.withColumn("_sorted", F.sort_array("columns"))
            .select(*[c for c in packed.columns if c != "columns"], once(last).alias("columns")))


def as_rows(packed: DataFrame) -> DataFrame:
    """The column rows of packed snapshots."""
    return packed.select("source", "run_id", "ts", "version_hash", F.inline("columns")).select(*ROW_COLUMNS)


def _is_packed(snapshot: DataFrame) -> bool:
    return "columns" in snapshot.columns


def last_per_column(rows: DataFrame) -> DataFrame:
    """Keeps the last row of each (source, run, column), with map-side combine."""
    rest = [c for c in rows.columns if c not in SNAPSHOT_KEY]
    return (rows.groupBy(*SNAPSHOT_KEY)
            .agg(F.max_by(F.struct(*rest), F.col("position")).alias("r"))
            .select(*SNAPSHOT_KEY, "r.*").select(*rows.columns))


def _item(dtype: Column, name: Column, nullable: Column) -> Column:
    def text(c):
        escaped = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        return F.concat(F.lit('"'), escaped, F.lit('"'))

    return F.concat(F.lit('{"dtype": '), text(dtype), F.lit(', "name": '), text(name),
                    F.lit(', "nullable": '), nullable.cast("string"), F.lit("}"))


def _hash_of(items: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")), 256), 1, 16)


def columns_hash(columns: str) -> Column:
    """The content hash of a packed snapshot, over its columns as they are ordered."""
    return _hash_of(F.transform(columns, lambda c: _item(c["dtype"], c["column_name"], c["nullable"])))


def schema_hash(snapshot: DataFrame) -> DataFrame:
    """Content hash of each snapshot: first 16 hex digits of SHA-256 over its column list.

    Names and types are taken as ASCII text. A group is one snapshot message, so its
    size is the width of one table.
    """
    item = _item(F.col("dtype"), F.col("column_name"), F.col("nullable"))
    listed = F.sort_array(F.collect_list(F.struct("position", item.alias("item"))))
    return (snapshot.groupBy("source", "run_id")
            .agg(_hash_of(F.transform(listed, lambda e: e["item"])).alias("computed_hash")))


def schema_history(snapshot: DataFrame) -> DataFrame:
    """First sighting of each version of each source."""
    return (snapshot.groupBy("source", "version_hash")
            .agg(F.min(F.struct("ts", "run_id")).alias("first"))
            .select("source", "version_hash", F.col("first.run_id").alias("first_run_id"),
                    F.col("first.ts").alias("seen_at")))


def bootstrap_contracts(snapshot: DataFrame) -> DataFrame:
    """A source's first snapshot is its contract."""
    first = (snapshot.groupBy("source").agg(F.min(F.struct("ts", "run_id")).alias("f"))
             .select("source", F.col("f.run_id").alias("run_id")))
    rows = snapshot.join(first, ["source", "run_id"], "left_semi")
    return (as_rows(rows) if _is_packed(rows) else rows).select(*CONTRACT_COLUMNS)


def accept_contract(contracts: DataFrame, accepted: DataFrame) -> DataFrame:
    """Replaces all contract columns of the accepted snapshots' sources."""
    replaced = accepted.select("source").distinct()
    return (contracts.join(replaced, "source", "left_anti")
            .unionByName(accepted.select(*contracts.columns)))


def contract_hash(contracts: DataFrame) -> DataFrame:
    """(source, contract_hash), over the contract's columns sorted by name."""
    names = contracts.withColumn("run_id", F.lit("contract")).withColumn("position", F.col("column_name"))
    return schema_hash(names).select("source", F.col("computed_hash").alias("contract_hash"))


def hash_gate(snapshot: DataFrame, contracts: DataFrame) -> DataFrame:
    """Snapshots whose declared hash differs from the contract's; equal ones need no diff."""
    return (snapshot.join(contract_hash(contracts), "source", "left")
            .filter(~F.col("version_hash").eqNullSafe(F.col("contract_hash")))
            .drop("contract_hash"))


def _type_key(c) -> Column:
    return F.upper(F.regexp_replace(c, r"^\s+|\s+$", ""))


def _packed(snapshot: DataFrame) -> DataFrame:
    """One row per snapshot."""
    if _is_packed(snapshot):
        return snapshot
    return snapshot.groupBy("source", "run_id").agg(
        F.collect_list(F.struct("column_name", "dtype", "nullable")).alias("columns"))


def _kind(p: Column) -> Column:
    """What became of a column of the contract; null where nothing did."""
    other_type = (p["dtype"] != p["found"]["dtype"]) & (_type_key(p["dtype"]) != _type_key(p["found"]["dtype"]))
    return (F.when(p["found"].isNull(), "dropped_column").when(other_type, "type_changed")
            .when(~p["nullable"] & p["found"]["nullable"], "nullable_changed"))


def _change(kind: Column, name: Column, contract: Column | None, incoming: Column | None) -> Column:
    """A change with its severity; one of the sides may be missing."""
    of = lambda side, field, dtype: F.lit(None).cast(dtype) if side is None else side[field]
    base = F.lit(None).cast("string")
    for known, severity in CHANGE_SEVERITY.items():
        base = F.when(kind == known, severity).otherwise(base)
    criticality = of(contract, "criticality", "string")
    return F.struct(
        name.alias("column_name"), kind.alias("change_type"), escalate_critical(base, criticality).alias("severity"),
        of(contract, "dtype", "string").alias("contract_type"), of(incoming, "dtype", "string").alias("incoming_type"),
        of(contract, "nullable", "boolean").alias("contract_nullable"), of(incoming, "nullable", "boolean").alias("incoming_nullable"),
        criticality.alias("criticality"))


def snapshot_changes(snapshot: DataFrame, contracts: DataFrame, kinds: list | None = None) -> DataFrame:
    """The packed snapshots, and `changes`: the array of their changes (of `kinds`) against the source's contract.

    Names are unique in a snapshot and in a contract, as `last_per_column` leaves them. One join by source of a row per
    snapshot with a row per contract, split by adaptive execution where a source is hot; the rest stays in the row.
    """
    kinds = list(CHANGE_ORDER) if kinds is None else kinds
    wanted = contracts.groupBy("source").agg(
        F.collect_list(F.struct("column_name", "dtype", "nullable", "criticality")).alias("wanted"))
    both = _packed(snapshot).join(wanted, "source")

    def found(w):
        at = F.coalesce(F.array_position(F.col("columns.column_name"), w["column_name"]), F.lit(0))
        return F.get(F.col("columns"), (at - 1).cast("int"))

    paired = F.transform("wanted", lambda w: F.struct(
        *[w[c].alias(c) for c in ("column_name", "dtype", "nullable", "criticality")], found(w).alias("found")))
    changed = F.transform(F.filter(paired, lambda p: _kind(p).isin(kinds)),
                          lambda p: _change(_kind(p), p["column_name"], p, p["found"]))
    fresh = F.transform(
        F.filter("columns", lambda c: ~F.coalesce(F.array_contains(F.col("wanted.column_name"), c["column_name"]), F.lit(False))),
        lambda c: _change(F.lit("new_column"), c["column_name"], None, c))
    changes = fresh if kinds == ["new_column"] else F.concat(changed, fresh) if "new_column" in kinds else changed
    return both.select(*[c for c in both.columns if c != "wanted"], once(changes).alias("changes"))


def column_changes(snapshot: DataFrame, contracts: DataFrame, kinds: list | None = None) -> DataFrame:
    """Every change (of `kinds`) of every snapshot against its source's contract."""
    return snapshot_changes(snapshot, contracts, kinds).select("source", "run_id", F.inline("changes")).select(*CHANGE_COLUMNS)


def dropped_columns(snapshot: DataFrame, contracts: DataFrame) -> DataFrame:
    return column_changes(snapshot, contracts, ["dropped_column"])


def type_changes(snapshot: DataFrame, contracts: DataFrame) -> DataFrame:
    return column_changes(snapshot, contracts, ["type_changed"])


def nullable_changes(snapshot: DataFrame, contracts: DataFrame) -> DataFrame:
    """Only of columns whose type is the same: a change of type is reported as that."""
    return column_changes(snapshot, contracts, ["nullable_changed"])


def new_columns(snapshot: DataFrame, contracts: DataFrame) -> DataFrame:
    return column_changes(snapshot, contracts, ["new_column"])


def _highest(changes: str) -> Column:
    severities = F.col(f"{changes}.severity")
    return F.coalesce(*[F.when(F.array_contains(severities, s), s) for s in reversed(SEVERITIES)])


def schema_diff(snapshot: DataFrame, contracts: DataFrame) -> DataFrame:
    """All changes plus the highest severity of their snapshot."""
    return (snapshot_changes(snapshot, contracts)
            .select("source", "run_id", _highest("changes").alias("overall_severity"), F.inline("changes"))
            .select(*CHANGE_COLUMNS, "overall_severity"))


# What a message says a kind of change leads to.
IMPACT = {
    "dropped_column": "downstream models referencing this column will fail silently",
    "type_changed": "silent cast failures or precision loss in downstream transforms",
    "nullable_changed": "column previously guaranteed non-null, now allows nulls",
    "new_column": "additive change — generally safe but contract should be updated",
}


def _listed_change(c) -> Column:
    """A change as a message lists it, after its place in the report."""
    order = F.when(c["change_type"] == "dropped_column", 0).when(c["change_type"] == "new_column", 2).otherwise(1)
    kind = c["change_type"]
    impact = F.lit(None).cast("string")
    for name, text in IMPACT.items():
        impact = F.when(kind == name, text).otherwise(impact)

    def of(column, *kinds):  # a null field is left out of the JSON
        return F.when(kind.isin(*kinds), c[column]).alias(column)

    return F.struct(order.alias("ord"), c["column_name"].alias("column"), kind.alias("change_type"), c["severity"].alias("severity"),
                    of("contract_type", "dropped_column", "type_changed"), of("incoming_type", "type_changed", "new_column"),
                    of("contract_nullable", "nullable_changed"), of("incoming_nullable", "nullable_changed", "new_column"),
                    of("criticality", "dropped_column", "type_changed", "nullable_changed"), impact.alias("impact"))


def _drift_messages(drifts: DataFrame) -> DataFrame:
    """Anomalies of (source, run_id, ts, severity, total_changes, a count per kind, changes)."""
    def part(kind):
        return F.when(F.col(kind) > 0,
                      F.concat(F.col(kind).cast("string"), F.lit(" " + kind.replace("_", " "))))

    summary = F.concat(F.lit("Schema drift in '"), F.col("source"), F.lit("': "),
                       F.concat_ws(", ", *[part(kind) for kind in CHANGE_ORDER]))
    listed = F.transform("changes", lambda c: c.dropFields("ord"))
    return drifts.withColumn("summary", summary).select(
        stable_id(F.lit("drift"), "source", "run_id").alias("signal_id"),
        F.lit("schema_drift").alias("anomaly_type"), F.lit("schema_watcher").alias("source_agent"),
        "run_id", F.col("source").alias("model_name"), "severity",
        F.lit(1.0).alias("confidence"), "ts",
        F.to_json(F.struct("total_changes", listed.alias("changes"), "summary")).alias("details"),
        "total_changes", "summary")


def schema_drift_anomalies(diff: DataFrame, snapshot_times: DataFrame | None = None) -> DataFrame:
    """One anomaly per drifting snapshot, with its changes listed in report order.

    `snapshot_times` (source, run_id, ts) gives the anomaly its time.
    """
    grouped = diff.groupBy("source", "run_id").agg(
        max_severity(F.col("severity")).alias("severity"),
        F.count(F.lit(1)).alias("total_changes"),
        *[F.count_if(F.col("change_type") == kind).alias(kind) for kind in CHANGE_ORDER],
        F.sort_array(F.collect_list(_listed_change({c: F.col(c) for c in diff.columns}))).alias("changes"))
    if snapshot_times is None:
        timed = grouped.withColumn("ts", F.lit(None).cast("timestamp"))
    else:
        timed = grouped.join(
            snapshot_times.groupBy("source", "run_id").agg(F.min("ts").alias("ts")),
            ["source", "run_id"], "left")
    return _drift_messages(timed)


def packed_drift_anomalies(packed: DataFrame, contracts: DataFrame) -> DataFrame:
    """The anomalies of `schema_drift_anomalies` of packed snapshots, each made from its own row."""
    found = snapshot_changes(packed, contracts).filter(F.size("changes") > 0)
    many = lambda kind: F.size(F.filter("changes", lambda c: c["change_type"] == kind)).cast("bigint").alias(kind)
    return _drift_messages(found.select(
        "source", "run_id", "ts", _highest("changes").alias("severity"), F.size("changes").cast("bigint").alias("total_changes"),
        *[many(kind) for kind in CHANGE_ORDER], F.sort_array(F.transform("changes", _listed_change)).alias("changes")))
