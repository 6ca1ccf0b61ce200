"""SQL twins of the queries, written for DuckDB over the same tables.

They are independent definitions: plain window functions, recursive queries and joins,
without the chunking, folding and pruning of the Spark side.
"""

TS = "'%Y-%m-%d %H:%M:%S.%f'"


def _ts(column: str) -> str:
    return f"strftime({column}, {TS})"


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


def _digest(text: str) -> str:
    return (f"concat(sum(('0x' || substr(md5({text}), 1, 6))::BIGINT)::BIGINT, '-', "
            f"sum(('0x' || substr(md5({text}), 7, 6))::BIGINT)::BIGINT)")


RANK = "CASE {0} WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 END"
NAME = "CASE {0} WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' WHEN 4 THEN 'CRITICAL' END"
Z_SEVERITY = ("CASE WHEN abs(z_score) >= 5 THEN 'CRITICAL' WHEN abs(z_score) >= 3.5 THEN 'HIGH' "
              "WHEN abs(z_score) >= 2.5 THEN 'MEDIUM' ELSE 'LOW' END")

# ---- inputs -----------------------------------------------------------------

EVENT_TEXT = ("concat(event_id, '|', user_id, '|', CAST(round(value * 100) AS BIGINT), '|', "
              "coalesce(props, '\\N'))")
EVENTS = "ev AS (SELECT *, CASE WHEN value >= 5 THEN value END AS amount FROM events)"
HOURLY = f"""hourly AS (
  SELECT event_type AS source, date_trunc('hour', ts) AS part, count(*) AS row_count,
         {_digest(EVENT_TEXT)} AS checksum,
         count(*) FILTER (amount IS NULL) / count(*)::DOUBLE AS null_rate
  FROM ev GROUP BY 1, 2)"""
SPINE = """spine AS (
  SELECT s.source, g.part FROM (SELECT DISTINCT source FROM hourly) s,
  (SELECT unnest(generate_series(min(part), max(part), INTERVAL 1 HOUR)) AS part FROM hourly) g)"""
SIGNALS = """signals AS (
  SELECT sha256('signal|' || run_id) AS event_id, 'ingestion' AS stage, * FROM (
    SELECT p.source, p.source || '@' || strftime(p.part, '%Y%m%d%H%M') AS run_id, p.part AS ts,
           coalesce(h.row_count, 0) AS row_count, h.checksum, h.null_rate
    FROM spine p LEFT JOIN hourly h ON p.source = h.source AND p.part = h.part))"""
SIG = [EVENTS, HOURLY, SPINE, SIGNALS]
SIGNALS_ORDERS = """signals AS (
  SELECT sha256('signal|' || run_id) AS event_id, * FROM (
    SELECT o_orderpriority AS source,
           o_orderpriority || '@' || strftime(date_trunc('day', o_orderdate), '%Y%m%d%H%M') AS run_id,
           date_trunc('day', o_orderdate)::TIMESTAMP AS ts, count(*) AS row_count
    FROM orders GROUP BY 1, 2, 3))"""

BASED = """based AS (
  SELECT *, count(v) OVER w AS baseline_n, avg(v) OVER w AS baseline_mean,
         CASE WHEN count(v) OVER w = 1 THEN 0 ELSE stddev_samp(v) OVER w END AS baseline_std
  FROM (SELECT *, CASE WHEN row_count > 0 THEN row_count END AS v FROM signals)
  WINDOW w AS (PARTITION BY source ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
SCORED = """scored AS (
  SELECT *, CASE WHEN baseline_std <> 0 THEN (row_count - baseline_mean) / baseline_std END AS z_score FROM based)"""

FLAT_SIGNAL = (f"event_id, stage, source, run_id, {_ts('ts')} AS ts, row_count, coalesce(checksum, '') AS checksum, "
               "coalesce(round(null_rate, 6), -1.0) AS null_rate")
FLAT_BASELINE = ("source, run_id, row_count, baseline_n, coalesce(round(baseline_mean, 4), -1.0) AS baseline_mean, "
                 "coalesce(round(baseline_std, 4), -1.0) AS baseline_std")


def _flat(tag, kind, severity, confidence, agent="ingestion_monitor", model="source", key="event_id", ts="ts"):
    return (f"sha256('{tag}|' || {key}) AS signal_id, '{kind}' AS anomaly_type, '{agent}' AS source_agent, run_id, "
            f"{model} AS model_name, {severity} AS severity, {confidence} AS confidence, {_ts(ts)} AS ts")


CRITICAL = "'CRITICAL'"
OLD_SEVERITY = "CASE WHEN age_seconds >= 172800 THEN 'HIGH' ELSE 'MEDIUM' END"
GAP_SEVERITY = "CASE WHEN gap_seconds >= 6 * m THEN 'HIGH' ELSE 'MEDIUM' END"
ZERO = f"SELECT {_flat('zero', 'row_count_anomaly', CRITICAL, '1.0::DOUBLE')} FROM signals WHERE row_count = 0"
ROWS_HEAD = _flat("rows", "row_count_anomaly", Z_SEVERITY, "round(least(1.0, abs(z_score) / 5.0), 4)")
ROWS_HIT = "FROM scored WHERE row_count <> 0 AND baseline_n >= 3 AND abs(z_score) > 2.5"
ROWS = f"""SELECT {ROWS_HEAD}, row_count, round(baseline_mean, 2) AS baseline_mean,
  round(baseline_std, 2) AS baseline_std_dev, round(z_score, 4) AS z_score, baseline_n AS sample_count {ROWS_HIT}"""
CHECKED = """checked AS (
  SELECT *, strftime(ts, '%Y-%m-%d') AS partition_date,
         lag(checksum) OVER (PARTITION BY source, CAST(ts AS DATE) ORDER BY ts, event_id) AS previous_checksum
  FROM signals WHERE checksum IS NOT NULL)"""
CHECK_HEAD = _flat("checksum", "checksum_mismatch", "'HIGH'", "1.0::DOUBLE")
CHECK_HIT = "FROM checked WHERE previous_checksum <> checksum"
INGESTION = _with(*SIG, BASED, SCORED, CHECKED) + (
    f"{ZERO} UNION ALL SELECT {ROWS_HEAD} {ROWS_HIT} UNION ALL SELECT {CHECK_HEAD} {CHECK_HIT}")

# raw signal messages, as far as their first 200 characters go
RAW = """raw AS (
  SELECT *, substr(md5(event_id), 1, 2) AS kind FROM signals),
msg AS (
  SELECT *, '{"event_id":"' || event_id || '",'
    || CASE WHEN kind < '80' THEN '"event_type":"pipeline.stage.completed",' ELSE '' END
    || '"stage":"' || CASE WHEN kind = '01' THEN 'archive' ELSE 'ingestion' END || '",'
    || CASE WHEN kind <> '02' THEN '"source":"' || source || '",' ELSE '' END
    || CASE WHEN kind <> '04' THEN '"metrics":{"row_count":' || row_count
         || CASE WHEN checksum IS NULL THEN '' ELSE ',"checksum":"' || checksum || '"' END
         || CASE WHEN null_rate IS NULL THEN '' ELSE ',"null_rate":' || null_rate END || '},' ELSE '' END
    || CASE WHEN kind <> '03' THEN '"pipeline_run_id":"' || run_id || '",' ELSE '' END
    || '"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '"}' AS body
  FROM raw)"""

# ---- schema log -------------------------------------------------------------

SCHEMA_LOG = """log AS (
  SELECT 'supplier_' || l_suppkey AS source, strftime(m, '%Y%m') AS run_id, m AS ts,
         row_number() OVER (PARTITION BY l_suppkey, m ORDER BY k, l_linenumber, l_returnflag, l_linestatus) - 1 AS position,
         'c' || l_linenumber AS column_name, l_returnflag AS dtype, l_linestatus = 'O' AS nullable,
         CASE WHEN l_linenumber = 1 THEN 'critical' ELSE 'standard' END AS criticality
  FROM (SELECT l_suppkey, date_trunc('month', l_shipdate)::TIMESTAMP AS m, l_linenumber, l_returnflag, l_linestatus,
               max(l_orderkey) AS k FROM lineitem GROUP BY ALL))"""
SNAPSHOTS = """last_rows AS (
  SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY source, run_id, column_name ORDER BY position DESC) = 1),
items AS (
  SELECT *, '{"dtype": "' || dtype || '", "name": "' || column_name || '", "nullable": ' || nullable || '}' AS item
  FROM last_rows),
hashes AS (
  SELECT source, run_id, substr(sha256('[' || string_agg(item, ', ' ORDER BY column_name) || ']'), 1, 16) AS version_hash,
         substr(sha256('[' || string_agg(item, ', ' ORDER BY position) || ']'), 1, 16) AS computed_hash
  FROM items GROUP BY 1, 2),
snapshots AS (SELECT l.*, h.version_hash FROM last_rows l JOIN hashes h USING (source, run_id))"""
CONTRACTS = """contracts AS (
  SELECT source, column_name, dtype, nullable, criticality FROM snapshots
  WHERE (source, run_id) IN (SELECT (source, min(run_id)) FROM snapshots GROUP BY source))"""
CONTRACT_ITEMS = "source, column_name, dtype, nullable, criticality"
SNAP = [SCHEMA_LOG, SNAPSHOTS, CONTRACTS]
DIFF = """pairs AS (
  SELECT coalesce(c.source, s.source) AS source, coalesce(c.run_id, s.run_id) AS run_id,
         coalesce(c.column_name, s.column_name) AS column_name, c.dtype AS contract_type, s.dtype AS incoming_type,
         c.nullable AS contract_nullable, s.nullable AS incoming_nullable, c.criticality,
         c.source IS NOT NULL AS old, s.source IS NOT NULL AS new
  FROM (SELECT r.run_id, k.* FROM (SELECT DISTINCT source, run_id FROM snapshots) r JOIN contracts k USING (source)) c
  FULL JOIN snapshots s ON c.source = s.source AND c.run_id = s.run_id AND c.column_name = s.column_name),
kinds AS (
  SELECT *, CASE WHEN NOT new THEN 'dropped_column' WHEN NOT old THEN 'new_column'
                 WHEN upper(trim(contract_type)) <> upper(trim(incoming_type)) THEN 'type_changed'
                 WHEN NOT contract_nullable AND incoming_nullable THEN 'nullable_changed' END AS change_type
  FROM pairs),
changes AS (
  SELECT *, CASE WHEN criticality = 'critical' OR change_type = 'dropped_column' THEN 'CRITICAL'
                 WHEN change_type = 'type_changed' THEN 'HIGH' WHEN change_type = 'nullable_changed' THEN 'MEDIUM'
                 ELSE 'LOW' END AS severity
  FROM kinds WHERE change_type IS NOT NULL)"""
CHANGE_COLUMNS = ("source, run_id, column_name, change_type, severity, coalesce(contract_type, '') AS contract_type, "
                  "coalesce(incoming_type, '') AS incoming_type, "
                  "coalesce(CAST(contract_nullable AS VARCHAR), '') AS contract_nullable, "
                  "coalesce(CAST(incoming_nullable AS VARCHAR), '') AS incoming_nullable, "
                  "coalesce(criticality, '') AS criticality")


def _changes(kind):
    return _with(*SNAP, DIFF) + f"SELECT {CHANGE_COLUMNS} FROM changes WHERE change_type = '{kind}'"


DRIFT = _with(*SNAP, DIFF) + f"""
SELECT sha256('drift|' || source || '|' || run_id) AS signal_id, 'schema_drift' AS anomaly_type,
       'schema_watcher' AS source_agent, run_id, source AS model_name,
       {NAME.format('max(' + RANK.format('severity') + ')')} AS severity, 1.0::DOUBLE AS confidence,
       {_ts("strptime(run_id || '01', '%Y%m%d')")} AS ts, count(*) AS total_changes,
       'Schema drift in ''' || source || ''': ' || concat_ws(', ',
         CASE WHEN count(*) FILTER (change_type = 'dropped_column') > 0
              THEN count(*) FILTER (change_type = 'dropped_column') || ' dropped column' END,
         CASE WHEN count(*) FILTER (change_type = 'type_changed') > 0
              THEN count(*) FILTER (change_type = 'type_changed') || ' type changed' END,
         CASE WHEN count(*) FILTER (change_type = 'nullable_changed') > 0
              THEN count(*) FILTER (change_type = 'nullable_changed') || ' nullable changed' END,
         CASE WHEN count(*) FILTER (change_type = 'new_column') > 0
              THEN count(*) FILTER (change_type = 'new_column') || ' new column' END) AS summary
FROM changes GROUP BY source, run_id"""

# ---- tests ------------------------------------------------------------------

ORDER_MONTH = "strftime(date_trunc('month', o_orderdate), 'dbt-run-%Y%m%d%H%M%S')"
LINE_MONTH = "strftime(date_trunc('month', l_shipdate), 'dbt-run-%Y%m%d%H%M%S')"


def _check(table, run, position, name, column, failing):
    model = "orders" if table == "orders" else "lineitem"
    return (f"SELECT {run} AS run_id, {position}::BIGINT AS position, '{name}' AS test_name, '{column}' AS column_name, "
            f"count(*) FILTER ({failing}) AS failures, '{model}' AS model_name FROM {table} GROUP BY 1")


def _unique(table, run, position, keys):
    columns = ", ".join(keys)
    return (f"SELECT run_id, {position}::BIGINT AS position, 'unique' AS test_name, '{','.join(keys)}' AS column_name, "
            f"count(*) FILTER (n > 1) AS failures, '{table}' AS model_name FROM "
            f"(SELECT {run} AS run_id, {columns}, count(*) AS n FROM {table} GROUP BY ALL) GROUP BY 1")


NOT_NULL = _check("orders", ORDER_MONTH, 0, "not_null", "priority", "o_orderpriority = '4-NOT SPECIFIED'")
ACCEPTED = _check("orders", ORDER_MONTH, 1, "accepted_values", "o_orderstatus", "o_orderstatus NOT IN ('F', 'O')")
BETWEEN = _check("lineitem", LINE_MONTH, 6, "between", "l_discount", "l_discount < 0 OR l_discount > 0.09")
UNIQUE = _unique("lineitem", LINE_MONTH, 10, ["l_orderkey", "l_linenumber"])
TEST_PARTS = [
    NOT_NULL, ACCEPTED,
    _check("orders", ORDER_MONTH, 2, "between", "o_totalprice", "o_totalprice > 499000"),
    _check("orders", ORDER_MONTH, 3, "between", "o_totalprice", "o_totalprice < 1100"),
    _unique("orders", ORDER_MONTH, 4, ["o_custkey"]),
    _check("lineitem", LINE_MONTH, 5, "accepted_values", "l_returnflag", "l_returnflag NOT IN ('A', 'N', 'R')"),
    BETWEEN,
    _check("lineitem", LINE_MONTH, 7, "between", "l_quantity", "l_quantity > 49"),
    _check("lineitem", LINE_MONTH, 8, "not_null", "tax", "l_tax = 0"),
    _check("lineitem", LINE_MONTH, 9, "between", "l_extendedprice", "l_extendedprice > 104500"),
    UNIQUE]
TESTS = "tests AS MATERIALIZED (SELECT *, strptime(substr(run_id, 9), '%Y%m%d%H%M%S') AS run_at, " \
        "CASE WHEN failures > 0 THEN 'fail' ELSE 'pass' END AS status, " \
        "CASE WHEN model_name = 'orders' AND test_name = 'not_null' THEN 'critical' " \
        "WHEN column_name = 'l_quantity' THEN 'low' ELSE '' END AS agent_severity " \
        "FROM (" + "\nUNION ALL ".join(f"({p})" for p in TEST_PARTS) + "))"
FLAT_TEST = (f"run_id, {_ts('run_at')} AS run_at, position, 'test.' || model_name || '.' || test_name || '.' || column_name "
             "AS unique_id, test_name, model_name, column_name, status, failures, 'Got ' || failures || ' results' "
             "AS message, agent_severity, 'data-platform' AS oncall_team")
FLAKY = """recent AS (
  SELECT *, count(*) OVER w AS total_runs, count(*) FILTER (status = 'fail') OVER w AS failure_count,
         row_number() OVER (PARTITION BY run_id, model_name, test_name ORDER BY position DESC) AS rn
  FROM tests
  WINDOW w AS (PARTITION BY model_name, test_name ORDER BY run_at, position ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
flaky AS MATERIALIZED (
  SELECT run_id, model_name, test_name, total_runs, failure_count, failure_count / total_runs::DOUBLE AS flakiness_rate,
         total_runs >= 5 AND failure_count / total_runs::DOUBLE > 0.20 AS is_flaky, total_runs < 5 AS is_new_test
  FROM recent WHERE rn = 1)"""
TEST_SCORED = """scored AS (
  SELECT *, CASE WHEN is_flaky AND base IN ('HIGH', 'CRITICAL') THEN 'MEDIUM' ELSE base END AS severity
  FROM (SELECT t.*, f.is_flaky, f.is_new_test,
               CASE WHEN agent_severity <> '' THEN upper(agent_severity) WHEN failures >= 100000 THEN 'CRITICAL'
                    WHEN failures >= 10000 THEN 'HIGH' WHEN failures >= 100 THEN 'MEDIUM' ELSE 'LOW' END AS base
        FROM tests t JOIN flaky f USING (run_id, model_name, test_name) WHERE status = 'fail'))"""
# the same scores with two aggregations a table and no join: counts side by side, unpivoted, flags by window
_MONTHS = {"orders": "strftime(date_trunc('month', o_orderdate), 'dbt-run-%Y%m%d%H%M%S')",
           "lineitem": "strftime(date_trunc('month', l_shipdate), 'dbt-run-%Y%m%d%H%M%S')"}
_COUNTED = {  # position, test, column, failing rows
    "orders": [(0, "not_null", "priority", "o_orderpriority = '4-NOT SPECIFIED'"), (1, "accepted_values", "o_orderstatus", "o_orderstatus NOT IN ('F', 'O')"),
               (2, "between", "o_totalprice", "o_totalprice > 499000"), (3, "between", "o_totalprice", "o_totalprice < 1100"),
               (4, "unique", "o_custkey", None)],
    "lineitem": [(5, "accepted_values", "l_returnflag", "l_returnflag NOT IN ('A', 'N', 'R')"), (6, "between", "l_discount", "l_discount < 0 OR l_discount > 0.09"),
                 (7, "between", "l_quantity", "l_quantity > 49"), (8, "not_null", "tax", "l_tax = 0"),
                 (9, "between", "l_extendedprice", "l_extendedprice > 104500"), (10, "unique", "l_orderkey,l_linenumber", None)]}


def _unpivoted(model: str) -> str:
    checks, key = _COUNTED[model], _COUNTED[model][-1][2]
    by_key = ", ".join(f"count(*) FILTER ({failing}) AS f{i}" for i, _, _, failing in checks if failing)
    by_run = ", ".join(f"sum(f{i})::BIGINT AS f{i}" if failing else f"count(*) FILTER (n > 1) AS f{i}" for i, _, _, failing in checks)
    rows = ", ".join(f"{{'position': {i}, 'test_name': '{test}', 'column_name': '{column}', 'failures': f{i}}}" for i, test, column, _ in checks)
    return (f"{model}_tests AS (SELECT run_id, '{model}' AS model_name, unnest([{rows}]) AS t FROM (SELECT run_id, {by_run} FROM "
            f"(SELECT {_MONTHS[model]} AS run_id, {key}, count(*) AS n, {by_key} FROM {model} GROUP BY run_id, {key}) GROUP BY run_id))")


FLAT_SCORES = _with(
    _unpivoted("orders"), _unpivoted("lineitem"),
    """counted AS (
  SELECT run_id, model_name, t.position AS position, t.test_name AS test_name, t.column_name AS column_name, t.failures AS failures
  FROM (SELECT * FROM orders_tests UNION ALL SELECT * FROM lineitem_tests)),
recent AS (
  SELECT *, count(*) OVER w AS runs, sum(CASE WHEN failures > 0 THEN 1 ELSE 0 END) OVER w AS failed
  FROM counted
  WINDOW w AS (PARTITION BY model_name, test_name ORDER BY substr(run_id, 9), position ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
flagged AS (
  SELECT *, first_value(runs) OVER last AS total_runs, first_value(failed) OVER last AS failure_count
  FROM recent WINDOW last AS (PARTITION BY run_id, model_name, test_name ORDER BY position DESC)),
scored AS (
  SELECT run_id, model_name, test_name, column_name, failures, total_runs < 5 AS is_new_test,
         total_runs >= 5 AND failure_count > 0.20 * total_runs AS is_flaky,
         CASE WHEN column_name = 'priority' THEN 'CRITICAL' WHEN column_name = 'l_quantity' THEN 'LOW' WHEN failures >= 100000 THEN 'CRITICAL'
              WHEN failures >= 10000 THEN 'HIGH' WHEN failures >= 100 THEN 'MEDIUM' ELSE 'LOW' END AS base
  FROM flagged WHERE failures > 0)""")
FLAT_SEVERITY = "CASE WHEN is_flaky AND base IN ('HIGH', 'CRITICAL') THEN 'MEDIUM' ELSE base END AS severity"
QUALITY = _with(TESTS, FLAKY, TEST_SCORED) + f"""
SELECT sha256('quality|' || run_id || '|' || model_name) AS signal_id, 'quality_failure' AS anomaly_type,
       'quality_auditor' AS source_agent, run_id, model_name,
       {NAME.format('max(' + RANK.format('severity') + ')')} AS severity,
       CASE WHEN bool_or(NOT is_flaky) THEN 0.95::DOUBLE ELSE 0.5::DOUBLE END AS confidence, {_ts('max(run_at)')} AS ts,
       count(*) AS total_failed_tests, count(*) FILTER (NOT is_flaky) AS genuine_failures,
       count(*) FILTER (is_flaky) AS flaky_failures
FROM scored GROUP BY run_id, model_name"""

# ---- lineage ----------------------------------------------------------------

USED = """used AS (
  SELECT DISTINCT CAST(n_regionkey AS VARCHAR) AS r, CAST(n_nationkey AS VARCHAR) AS n, c_mktsegment AS s
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
CATALOG = USED + """,
models AS (
  SELECT DISTINCT 'region_' || r AS project, 'model.shop.region_' || r AS uid, 'region_' || r AS name, 'region' AS level FROM used
  UNION SELECT 'region_' || r, 'model.shop.nation_' || n, 'nation_' || n, 'nation' FROM used
  UNION SELECT 'region_' || r, 'model.shop.cust_' || n || '_' || s, 'cust_' || n || '_' || s, 'cust' FROM used),
links AS (
  SELECT DISTINCT 'region_' || r AS project, 'model.shop.region_' || r AS parent, 'model.shop.nation_' || n AS child FROM used
  UNION SELECT 'region_' || r, 'model.shop.nation_' || n, 'snapshot.shop.snap_' || n FROM used
  UNION SELECT 'region_' || r, 'model.shop.nation_' || n, 'test.shop.not_null_' || n FROM used
  UNION SELECT 'region_' || r, 'snapshot.shop.snap_' || n, 'model.shop.cust_' || n || '_' || s FROM used),
needs AS (
  SELECT DISTINCT 'region_' || r AS project, 'exposure.shop.' || s || '_' || r AS uid, s || '_' || r AS name,
         CASE s WHEN 'AUTOMOBILE' THEN 'dashboard' WHEN 'BUILDING' THEN 'dashboard' WHEN 'FURNITURE' THEN 'notebook'
                WHEN 'HOUSEHOLD' THEN 'analysis' WHEN 'MACHINERY' THEN 'dashboard' END AS kind,
         CASE s WHEN 'BUILDING' THEN 'by_breakfast' WHEN 'MACHINERY' THEN 'hourly' ELSE '' END AS sla,
         'model.shop.cust_' || n || '_' || s AS node, r AS owner FROM used
  UNION SELECT 'region_' || r, 'exposure.shop.churn_' || n, 'churn_' || n, 'ml', '', 'model.shop.nation_' || n, 'science' FROM used)"""


def _reach(edge_table, start_sql):
    return f"""reach AS (
  SELECT s.start, e.child AS node FROM ({start_sql}) s JOIN {edge_table} e ON e.parent = s.start
  UNION SELECT r.start, e.child FROM reach r JOIN {edge_table} e ON e.parent = r.node)"""


TABLE_GRAPH = """models AS (
  SELECT 'model.r' || r_regionkey AS uid, 'r' || r_regionkey AS name FROM region
  UNION ALL SELECT 'model.n' || n_nationkey, 'n' || n_nationkey FROM nation
  UNION ALL SELECT 'model.c' || c_custkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'model.o' || o_orderkey, 'o' || o_orderkey FROM orders),
links AS (
  SELECT DISTINCT 'model.r' || n_regionkey AS parent, 'model.n' || n_nationkey AS child FROM nation
  UNION SELECT 'model.n' || c_nationkey, 'model.c' || c_custkey FROM customer
  UNION SELECT 'model.c' || o_custkey, 'model.o' || o_orderkey FROM orders),
needs AS (
  SELECT 'exposure.o' || o_orderkey AS uid, 'view_' || o_orderkey AS name,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'dashboard' ELSE 'ml' END AS kind,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'hourly' ELSE '' END AS sla, 'model.o' || o_orderkey AS node
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))"""
IMPACT = """known AS (SELECT r.start, m.name FROM reach r JOIN models m ON m.uid = r.node),
hit AS (
  SELECT DISTINCT a.start, n.uid, n.name, n.kind, n.sla
  FROM (SELECT start, node FROM reach UNION SELECT uid, uid FROM models) a JOIN needs n ON n.node = a.node)"""
MULTIPLIER = ("least(3.0, 1.0::DOUBLE + CASE WHEN n_downstream >= 10 THEN 1.0 WHEN n_downstream >= 3 THEN 0.5 ELSE 0 END"
              " + CASE WHEN n_dashboards >= 1 THEN 0.5 ELSE 0 END + CASE WHEN n_sla >= 1 THEN 0.5 ELSE 0 END)")
BLAST = f"""counted AS (
  SELECT m.name AS model_name, m.uid AS model_uid, coalesce(k.n, 0) AS n_downstream, coalesce(h.d, 0) AS n_dashboards,
         coalesce(h.ml, 0) AS n_ml, coalesce(h.sla, 0) AS n_sla, coalesce(k.l, '') AS affected_models,
         coalesce(h.dl, '') AS dashboards, coalesce(h.mll, '') AS ml_features, coalesce(h.sl, '') AS sla_breaches
  FROM models m
  LEFT JOIN (SELECT start, count(*) AS n, string_agg(name, ',' ORDER BY name) AS l FROM known GROUP BY 1) k ON k.start = m.uid
  LEFT JOIN (SELECT start, count(*) FILTER (kind IN ('dashboard', 'analysis')) AS d, count(*) FILTER (kind = 'ml') AS ml,
                    count(*) FILTER (sla <> '') AS sla,
                    string_agg(name, ',' ORDER BY name) FILTER (kind IN ('dashboard', 'analysis')) AS dl,
                    string_agg(name, ',' ORDER BY name) FILTER (kind = 'ml') AS mll,
                    string_agg(name || ' (' || sla || ')', ',' ORDER BY name || ' (' || sla || ')') FILTER (sla <> '') AS sl
             FROM hit GROUP BY 1) h ON h.start = m.uid),
blast AS (SELECT *, {MULTIPLIER} AS severity_multiplier FROM counted)"""
MEMBERS = """members AS (
  SELECT m.name AS model_name, x.kind, x.member FROM models m JOIN (
    SELECT start, 'affected_model' AS kind, name AS member FROM known
    UNION ALL SELECT start, 'dashboard', name FROM hit WHERE kind IN ('dashboard', 'analysis')
    UNION ALL SELECT start, 'ml_feature', name FROM hit WHERE kind = 'ml'
    UNION ALL SELECT start, 'sla_breach', name || ' (' || sla || ')' FROM hit WHERE sla <> '') x ON x.start = m.uid)"""
BIG = [TABLE_GRAPH, _reach("links", "SELECT uid AS start FROM models"), IMPACT]
SMALL = [CATALOG, _reach("links", "SELECT uid AS start FROM models"), IMPACT]

# ---- anomalies --------------------------------------------------------------

ANOMALIES = """anomalies AS (
  SELECT sha256('event|' || event_id) AS signal_id,
         CASE event_type WHEN 'click' THEN 'row_count_anomaly' WHEN 'view' THEN 'schema_drift'
              WHEN 'error' THEN 'quality_failure' WHEN 'signup' THEN 'freshness_violation'
              WHEN 'purchase' THEN 'checksum_mismatch' END AS anomaly_type,
         event_type || '_agent' AS source_agent, strftime(ts, '%Y%m%d%H') AS run_id,
         CASE WHEN user_id % 10 = 9 THEN NULL WHEN user_id % 4 = 0 THEN 'nation_' || user_id % 25
              WHEN user_id % 4 = 1 THEN 'cust_' || user_id % 25 || '_' ||
                CASE user_id % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE'
                     WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END
              WHEN user_id % 4 = 2 THEN 'region_' || user_id % 5 ELSE 'm' || user_id % 20 END AS model_name,
         CASE WHEN value >= 150 THEN 'CRITICAL' WHEN value >= 70 THEN 'HIGH' WHEN value >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
         least(1.0, round(value / 100, 4)) AS confidence, ts, props AS details
  FROM events)"""
FLAT_ANOMALY = ("signal_id, anomaly_type, source_agent, run_id, coalesce(model_name, '') AS model_name, severity, "
                f"round(confidence, 4) AS confidence, {_ts('ts')} AS ts")
# one bucket at a time per run: the next opens at the first signal not yet covered
BUCKETS = """opens AS (
  SELECT run_id, min(epoch_us(ts)) AS o FROM anomalies GROUP BY 1
  UNION ALL
  SELECT p.run_id, (SELECT min(epoch_us(a.ts)) FROM anomalies a WHERE a.run_id = p.run_id AND epoch_us(a.ts) >= p.o + 300000000)
  FROM opens p
  WHERE EXISTS (SELECT 1 FROM anomalies a WHERE a.run_id = p.run_id AND epoch_us(a.ts) >= p.o + 300000000)),
bucketed AS (
  SELECT a.*, o.o, make_timestamp(o.o) AS opened_at, sha256('bucket|' || a.run_id || '|' || o.o) AS bucket_id
  FROM anomalies a JOIN opens o ON o.run_id = a.run_id AND epoch_us(a.ts) >= o.o AND epoch_us(a.ts) < o.o + 300000000)"""
FACTS = f"""facts AS (
  SELECT bucket_id, run_id, opened_at, string_agg(DISTINCT anomaly_type, ',' ORDER BY anomaly_type) AS anomaly_types,
         {NAME.format('max(' + RANK.format('severity') + ')')} AS severity, count(*) AS n_signals,
         coalesce(string_agg(DISTINCT model_name, ',' ORDER BY model_name), '') AS models,
         bool_and(severity = 'LOW' AND confidence < 0.6) AS suppressed,
         arg_min(anomaly_type, (ts, signal_id)) AS first_type, arg_min(confidence, (ts, signal_id)) AS first_confidence,
         bool_or(anomaly_type = 'schema_drift') AS d, bool_or(anomaly_type = 'row_count_anomaly') AS r,
         bool_or(anomaly_type = 'quality_failure') AS q, bool_or(anomaly_type = 'checksum_mismatch') AS c,
         bool_or(anomaly_type = 'freshness_violation') AS f
  FROM bucketed GROUP BY 1, 2, 3),
firsts AS (
  SELECT bucket_id, coalesce(model_name, 'unknown') AS primary_model FROM bucketed
  QUALIFY row_number() OVER (PARTITION BY bucket_id ORDER BY ts, signal_id) = 1),
ruled AS (
  SELECT f.*, p.primary_model,
         CASE WHEN n_signals = 1 THEN first_type WHEN d AND r THEN 'schema_drift' WHEN d AND q THEN 'schema_drift'
              WHEN c THEN 'checksum_mismatch' WHEN f AND r THEN 'freshness_violation' ELSE 'unknown' END AS root_cause,
         CASE WHEN n_signals = 1 THEN first_confidence WHEN d AND r THEN 0.95 WHEN d AND q THEN 0.92
              WHEN c THEN 0.99 WHEN f AND r THEN 0.90 ELSE 0.5 END AS confidence
  FROM facts f JOIN firsts p USING (bucket_id)),
incidents AS (
  SELECT *, sha256('incident|' || bucket_id) AS incident_id, root_cause = 'unknown' AS needs_llm
  FROM ruled WHERE NOT suppressed)"""
CORR = [ANOMALIES, BUCKETS, FACTS]
FLAT_INCIDENT = (f"incident_id, run_id, {_ts('opened_at')} AS opened_at, root_cause, severity, "
                 "round(confidence, 4) AS confidence, needs_llm, n_signals, models, primary_model")
INCIDENTS = _with(*CORR, recursive=True) + f"SELECT {FLAT_INCIDENT} FROM incidents"
ESCALATED = NAME.format(f"(CASE WHEN severity_multiplier >= 2 THEN least(4, {RANK.format('severity')} + 1) "
                        f"ELSE {RANK.format('severity')} END)")
LINEAGE_FLAT = f"""SELECT sha256('lineage|' || signal_id) AS incident_id, run_id, {_ts('ts')} AS opened_at,
  anomaly_type AS root_cause, {ESCALATED} AS severity, round(confidence, 4) AS confidence, model_name AS primary_model,
  n_downstream, n_dashboards, n_ml, n_sla, severity_multiplier
FROM (SELECT a.*, coalesce(n_downstream, 0) AS n_downstream, coalesce(n_dashboards, 0) AS n_dashboards,
             coalesce(n_ml, 0) AS n_ml, coalesce(n_sla, 0) AS n_sla, coalesce(severity_multiplier, 1.0::DOUBLE) AS severity_multiplier
      FROM anomalies a LEFT JOIN blast b USING (model_name) WHERE model_name IS NOT NULL)"""
CATALOG_VERSIONS = ["c_nationkey % 3 <> 1 OR c_mktsegment <> 'BUILDING'", "true", "c_nationkey % 4 <> 2 AND c_mktsegment <> 'MACHINERY'"]


def _catalog_version(n: int, keep: str) -> str:
    graph = [SMALL[0].replace("ON c_nationkey = n_nationkey", f"ON c_nationkey = n_nationkey WHERE {keep}"), *SMALL[1:]]
    return (f"SELECT {n}::BIGINT AS version, * FROM (" + _with(*graph, BLAST, recursive=True)
            + "SELECT model_name, model_uid, n_downstream, n_dashboards, n_ml, n_sla, severity_multiplier FROM blast)")


MANIFEST_VERSIONS = "\nUNION ALL ".join(_catalog_version(n, keep) for n, keep in enumerate(CATALOG_VERSIONS, start=1))
LINEAGE = _with(*SMALL, BLAST, ANOMALIES, recursive=True) + LINEAGE_FLAT
NAMED_BLAST = """named AS (
  SELECT n.model_name, coalesce(model_uid, '') AS model_uid, coalesce(n_downstream, 0) AS n_downstream,
         coalesce(affected_models, '') AS affected_models, coalesce(dashboards, '') AS dashboards,
         coalesce(ml_features, '') AS ml_features, coalesce(sla_breaches, '') AS sla_breaches,
         coalesce(severity_multiplier, 1.0::DOUBLE) AS severity_multiplier
  FROM (SELECT DISTINCT model_name FROM anomalies WHERE model_name IS NOT NULL) n LEFT JOIN blast b USING (model_name))"""

ENRICHED = f"""unions AS (
  SELECT DISTINCT i.incident_id, m.kind, m.member
  FROM (SELECT incident_id, unnest(string_split(models, ',')) AS model_name FROM incidents) i JOIN members m USING (model_name)),
impact AS (
  SELECT i.*, coalesce(n_downstream, 0) AS n_downstream, coalesce(n_dashboards, 0) AS n_dashboards,
         coalesce(n_ml, 0) AS n_ml, coalesce(n_sla, 0) AS n_sla, sla_names
  FROM incidents i LEFT JOIN (
    SELECT incident_id, count(*) FILTER (kind = 'affected_model') AS n_downstream,
           count(*) FILTER (kind = 'dashboard') AS n_dashboards, count(*) FILTER (kind = 'ml_feature') AS n_ml,
           count(*) FILTER (kind = 'sla_breach') AS n_sla,
           string_agg(member, ', ' ORDER BY member) FILTER (kind = 'sla_breach') AS sla_names
    FROM unions GROUP BY 1) USING (incident_id)),
enriched AS (
  SELECT * EXCLUDE (severity), {ESCALATED} AS severity, 'SLA at risk: ' || sla_names AS sla_impact
  FROM (SELECT *, {MULTIPLIER} AS severity_multiplier FROM impact)),
targets AS (
  SELECT incident_id, member, row_number() OVER (PARTITION BY incident_id ORDER BY member) AS k
  FROM unions WHERE kind = 'affected_model')"""
# steps are numbered 100 apart to leave room for the pauses, then ranked
PLAN = """steps AS (
  SELECT incident_id, 0 AS k, 'notify_slack' AS action_type, 'data-platform' AS target, '' AS full_refresh, '' AS reason,
         'Notify #data-platform about ' || severity || ' incident' AS description FROM enriched
  UNION ALL SELECT incident_id, 100, 'quarantine_partition', primary_model, '',
         root_cause || ' detected — severity HIGH', 'Quarantine ' || primary_model || ' partition for run ' || run_id
  FROM enriched WHERE severity = 'HIGH'
  UNION ALL SELECT incident_id, 100, 'quarantine_partition', primary_model, '', 'CRITICAL: ' || root_cause,
         'Quarantine ' || primary_model || ' partition' FROM enriched WHERE severity = 'CRITICAL'
  UNION ALL SELECT incident_id, 200 + k, 'pause_downstream_dags', member, '', '',
         'Pause DAG for downstream model ' || member
  FROM enriched JOIN targets USING (incident_id) WHERE severity = 'CRITICAL' AND root_cause = 'schema_drift' AND k <= 5
  UNION ALL SELECT incident_id, 300, 'trigger_backfill', primary_model,
         CAST(root_cause IN ('schema_drift', 'checksum_mismatch') AS VARCHAR), '', 'Trigger dbt backfill for ' || primary_model
  FROM enriched WHERE severity = 'CRITICAL'
  UNION ALL SELECT incident_id, 400, 'create_pagerduty', 'data-platform-oncall', '',
         'CRITICAL data pipeline failure: ' || root_cause || ' in ' || primary_model,
         'Create PagerDuty incident for on-call' FROM enriched WHERE severity = 'CRITICAL'),
plan AS (
  SELECT incident_id, row_number() OVER (PARTITION BY incident_id ORDER BY k) - 1 AS action_seq, action_type, target,
         full_refresh, reason, description,
         action_type IN ('quarantine_partition', 'pause_downstream_dags', 'trigger_backfill') AS touching
  FROM steps)"""
RESPONSE = [*SMALL, MEMBERS, *CORR, ENRICHED]
LOG = """log AS (
  SELECT sha256('action|' || incident_id || '|' || action_seq) AS action_id, incident_id, action_type, target,
         action_seq % 3 <> 2 AS success, CASE WHEN action_seq % 3 <> 2 THEN '' ELSE 'timed out' END AS error_message,
         opened_at + to_seconds(action_seq) AS executed_at
  FROM plan JOIN incidents USING (incident_id))"""


def _long_metric(value, metric):
    counted = "row_count > 0" if metric == "row_count" else f"{value} IS NOT NULL"
    return f"SELECT event_id, source, run_id, ts, '{metric}' AS metric, CAST({value} AS DOUBLE) AS row_count FROM signals WHERE {counted}"


ORACLES = {
    # A
    "decode_signals": _with(*SIG, RAW) + f"SELECT 'pipeline.stage.completed' AS event_type, {FLAT_SIGNAL} FROM raw "
                      "WHERE kind NOT IN ('00', '01', '02', '03', '04')",
    "split_malformed": _with(*SIG, RAW) + "SELECT substr(CASE WHEN kind = '00' THEN substr(body, 1, 60) ELSE body END, 1, 200) "
                       "AS value_head, CASE WHEN kind = '00' THEN substr(body, 1, 60) ELSE body END AS value, CASE kind WHEN '00' THEN 'not json' WHEN '01' THEN 'unknown stage' "
                       "WHEN '02' THEN 'missing source' WHEN '03' THEN 'missing pipeline_run_id' ELSE 'missing metrics' END "
                       "AS reason FROM msg WHERE kind IN ('00', '01', '02', '03', '04')",
    "ingestion_stage_only": _with(*SIG) + f"SELECT {FLAT_SIGNAL} FROM signals WHERE row_count % 2 = 0",
    "decode_anomalies": _with(ANOMALIES) + f"SELECT {FLAT_ANOMALY}, details AS props FROM anomalies "
                        "WHERE NOT (substr(signal_id, 1, 2) IN ('00', '01', '02'))",
    "decode_incidents": _with(*SMALL, BLAST, ANOMALIES, recursive=True) +
        f"SELECT 'i' || signal_id AS incident_id, run_id, {_ts('ts')} AS opened_at, anomaly_type AS root_cause, severity, "
        "1::BIGINT AS n_signals, a.model_name AS primary_model, coalesce(n_downstream, 0) AS n_affected, signal_id "
        "FROM anomalies a LEFT JOIN blast b USING (model_name) WHERE model_name IS NOT NULL AND substr(md5('i' || signal_id), 1, 1) NOT IN ('0', '1')",
    "encode_messages": f"""SELECT 'anomaly' AS kind, run_id AS key, concat(signal_id, '|', anomaly_type, '|', source_agent, '|', run_id, '|', model_name, '|', severity, '|',
  CAST(confidence AS DECIMAL(9, 4)), '|', {_ts('ts')}, '|', details) AS fields FROM ({_with(ANOMALIES)} SELECT * FROM anomalies)
UNION ALL SELECT 'incident', incident_id, concat(incident_id, '|', run_id, '|', opened_at, '|', root_cause, '|', severity, '|', CAST(confidence AS DECIMAL(9, 4)), '|',
  CASE WHEN needs_llm THEN 'true' ELSE 'false' END, '|', n_signals, '|', models, '|', primary_model) FROM ({INCIDENTS})
UNION ALL SELECT 'test', concat('test.', model_name, '.', test_name, '.', column_name), concat(run_id, '|', 'test.', model_name, '.', test_name, '.', column_name, '|', test_name, '|',
  model_name, '|', column_name, '|', status, '|', failures, '|', {_ts('run_at')}) FROM ({_with(TESTS)} SELECT * FROM tests)""",
    "upsert_latest": f"SELECT o_custkey, o_orderkey, o_orderstatus, {_ts('o_orderdate')} AS o_orderdate FROM orders "
                     "QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1",
    "append_history": _with(TESTS) + "SELECT model_name, test_name, count(*) AS n FROM tests GROUP BY 1, 2",
    "run_ids": _with(TESTS) + f"SELECT DISTINCT run_id, {_ts('run_at')} AS generated_at, '1.8.0' AS dbt_version FROM tests",
    "read_manifest": _with(CATALOG) + """SELECT project, 'model' AS kind, uid AS item, concat(name, '|analytics|prod|The ', name, '|', level, '|', level) AS detail FROM models
UNION ALL SELECT project, 'exposure', uid, concat(name, '|', kind, '|About ', name, '|', string_agg(node, ',' ORDER BY node), '|', owner, '|https://bi.example/|', sla) FROM needs GROUP BY project, uid, name, kind, owner, sla
UNION ALL SELECT project, 'edge', parent, child FROM links""",
    # B
    "partition_row_count": _with(*SIG) + f"SELECT source, {_ts('ts')} AS partition, row_count FROM signals",
    "partition_checksum": _with(*SIG) + f"SELECT source, {_ts('part')} AS partition, checksum FROM hourly",
    "partition_null_rate": "SELECT o_orderstatus AS source, strftime(o_orderdate, '%Y%m') AS partition, "
        "'priority' AS column_name, round(count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') / count(*)::DOUBLE, 6) AS null_rate "
        "FROM orders GROUP BY 1, 2 UNION ALL SELECT o_orderstatus, strftime(o_orderdate, '%Y%m'), 'o_custkey', "
        "round(count(*) FILTER (o_custkey IS NULL) / count(*)::DOUBLE, 6) FROM orders GROUP BY 1, 2",
    "column_summary": " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, count(*) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std_dev, "
        f"min({c}) AS min, max({c}) AS max, round(count(*) FILTER ({c} IS NULL) / count(*)::DOUBLE, 6) AS null_rate, "
        f"count(DISTINCT {c}) AS n_distinct FROM lineitem"
        for name, c in (("l_quantity", "l_quantity"), ("l_extendedprice", "l_extendedprice"),
                        ("l_discount", "l_discount"), ("tax", "nullif(l_tax, 0.0)"))),
    "merged_summary": " UNION ALL ".join(
        f"SELECT l_returnflag AS source, '{name}' AS column_name, count(*) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std_dev, "
        f"min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(count(*) FILTER ({c} IS NULL) / count(*)::DOUBLE, 6) AS null_rate, "
        f"{d} AS n_distinct FROM lineitem WHERE strftime(l_shipdate, '%Y%m') BETWEEN '199401' AND '199612' GROUP BY l_returnflag"
        for name, c, d in (("l_quantity", "l_quantity", "count(DISTINCT l_quantity)"), ("l_extendedprice", "l_extendedprice", "-1::BIGINT"),
                           ("l_discount", "l_discount", "count(DISTINCT l_discount)"), ("tax", "nullif(l_tax, 0.0)", "count(DISTINCT nullif(l_tax, 0.0))"),
                           ("l_linenumber", "l_linenumber", "count(DISTINCT l_linenumber)"))),
    "schema_snapshot": " UNION ALL ".join(
        f"SELECT 'lineitem' AS source, {i}::BIGINT AS position, '{c}' AS column_name, '{t}' AS dtype, true AS nullable, "
        f"round(count(*) FILTER ({e} IS NULL) / count(*)::DOUBLE, 6) AS null_rate FROM lineitem"
        for i, (c, t, e) in enumerate([
            ("l_orderkey", "BIGINT", "l_orderkey"), ("l_partkey", "BIGINT", "l_partkey"), ("l_suppkey", "BIGINT", "l_suppkey"),
            ("l_linenumber", "INT", "l_linenumber"), ("l_quantity", "DOUBLE", "l_quantity"),
            ("l_extendedprice", "DOUBLE", "l_extendedprice"), ("l_discount", "DOUBLE", "l_discount"),
            ("l_tax", "DOUBLE", "l_tax"), ("l_returnflag", "STRING", "l_returnflag"),
            ("l_linestatus", "STRING", "l_linestatus"), ("l_shipdate", "TIMESTAMP", "l_shipdate"),
            ("tax", "DOUBLE", "nullif(l_tax, 0.0)")])),
    "build_signals": _with(*SIG) + f"SELECT {FLAT_SIGNAL} FROM signals",
    # C
    "zero_row_anomalies": _with(*SIG) + ZERO,
    "running_baseline": _with(*SIG, BASED) + f"SELECT {FLAT_BASELINE} FROM based",
    "running_baseline_orders": _with(SIGNALS_ORDERS, BASED) + f"SELECT {FLAT_BASELINE} FROM based",
    "baseline_table": _with(SIGNALS_ORDERS) + "SELECT source AS model_name, source, 'row_count' AS metric, "
        "round(avg(row_count), 4) AS mean, round(coalesce(stddev_samp(row_count), 0), 4) AS std_dev, count(*) AS sample_count "
        "FROM signals WHERE row_count > 0 GROUP BY source",
    "z_scores": _with(SIGNALS_ORDERS, BASED, SCORED) + f"SELECT {FLAT_BASELINE}, coalesce(round(z_score, 4), -99.0) AS z_score, "
        "coalesce(abs(z_score) > 2.5, false) AS is_anomalous FROM scored",
    "row_count_anomalies": _with(*SIG, BASED, SCORED) + ROWS,
    "row_count_anomalies_orders": _with(SIGNALS_ORDERS, BASED, SCORED) + ROWS,
    "zscore_severity": _with(SIGNALS_ORDERS, BASED, SCORED) + f"SELECT {Z_SEVERITY} AS severity, count(*) AS n FROM scored "
        "WHERE z_score IS NOT NULL GROUP BY 1",
    "checksum_mismatches": _with(*SIG, CHECKED) + f"SELECT {CHECK_HEAD}, partition_date, previous_checksum, "
        f"checksum AS current_checksum {CHECK_HIT}",
    "ingestion_anomalies": INGESTION,
    "rolling_baseline": _with(*SIG, """based AS (
  SELECT *, count(v) OVER w AS baseline_n, avg(v) OVER w AS baseline_mean,
         CASE WHEN count(v) OVER w = 1 THEN 0 ELSE stddev_samp(v) OVER w END AS baseline_std
  FROM (SELECT *, CASE WHEN row_count > 0 THEN row_count END AS v, CAST(epoch(ts) AS BIGINT) AS u FROM signals)
  WINDOW w AS (PARTITION BY source ORDER BY u RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING))""")
        + f"SELECT {FLAT_BASELINE} FROM based",
    "metric_anomalies": _with(*SIG, f"long AS ({_long_metric('row_count', 'row_count')} UNION ALL {_long_metric('null_rate', 'null_rate')})",
                              """based AS (
  SELECT *, count(row_count) OVER w AS baseline_n, avg(row_count) OVER w AS baseline_mean,
         CASE WHEN count(row_count) OVER w = 1 THEN 0 ELSE stddev_samp(row_count) OVER w END AS baseline_std
  FROM long WINDOW w AS (PARTITION BY source, metric ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
                              SCORED) + f"SELECT * EXCLUDE (signal_id) FROM (SELECT {ROWS_HEAD}, metric, round(row_count, 6) AS value, "
        "round(baseline_mean, 4) AS baseline_mean, round(baseline_std, 4) AS baseline_std_dev, round(z_score, 4) AS z_score, "
        "baseline_n AS sample_count FROM scored WHERE baseline_n >= 3 AND abs(z_score) > 2.5)",
    "freshness_violations": _with("""latest AS (
  SELECT CAST(user_id AS VARCHAR) AS source, event_type AS run_id, ts, CAST(event_id AS VARCHAR) AS event_id FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)""",
        "aged AS (SELECT *, CAST(epoch(TIMESTAMP '2024-01-31') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) AS age_seconds FROM latest)")
        + f"SELECT {_flat('fresh', 'freshness_violation', OLD_SEVERITY, '1.0::DOUBLE')}, "
        "age_seconds FROM aged WHERE age_seconds > 86400",
    "arrival_latency": _with(SIGNALS_ORDERS,
        "gaps AS (SELECT *, CAST(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY source ORDER BY ts, event_id)) AS BIGINT) AS gap_seconds FROM signals)",
        """meant AS (SELECT *, count(gap_seconds) OVER w AS k, avg(gap_seconds) OVER w AS m FROM gaps
  WINDOW w AS (PARTITION BY source ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
        + f"SELECT {_flat('late', 'freshness_violation', GAP_SEVERITY, '1.0::DOUBLE')}, "
        "gap_seconds, round(m, 2) AS mean_gap_seconds FROM meant WHERE k >= 3 AND gap_seconds > 3 * m",
    # D
    "normalize_snapshot": _with(*SNAP) + "SELECT source, run_id, position, column_name, dtype, nullable, criticality, version_hash FROM snapshots",
    "schema_hash": _with(*SNAP) + "SELECT source, run_id, computed_hash FROM hashes",
    "schema_history": _with(*SNAP) + f"SELECT source, version_hash, min(run_id) AS first_run_id, {_ts('min(ts)')} AS seen_at FROM snapshots GROUP BY 1, 2",
    "bootstrap_contracts": _with(*SNAP) + "SELECT * FROM contracts",
    "accept_contract": _with(*SNAP, f"""accepted AS (
  SELECT {CONTRACT_ITEMS} FROM snapshots WHERE (source, run_id) IN (
    SELECT (source, max(run_id)) FROM snapshots WHERE source IN (SELECT 'supplier_' || s_suppkey FROM supplier WHERE s_acctbal > 5000) GROUP BY source))""")
        + "SELECT * FROM contracts WHERE source NOT IN (SELECT source FROM accepted) UNION ALL SELECT * FROM accepted",
    "hash_gate": _with(*SNAP, """chash AS (SELECT source, substr(sha256('[' || string_agg('{"dtype": "' || dtype || '", "name": "' || column_name || '", "nullable": ' || nullable || '}', ', ' ORDER BY column_name) || ']'), 1, 16) AS h FROM contracts GROUP BY 1)""")
        + "SELECT source, run_id, column_name, version_hash FROM snapshots JOIN chash USING (source) WHERE version_hash <> h",
    "dropped_columns": _changes("dropped_column"), "type_changes": _changes("type_changed"),
    "nullable_changes": _changes("nullable_changed"), "new_columns": _changes("new_column"),
    "escalate_critical": _with(*SNAP) + "SELECT criticality, CASE WHEN criticality = 'critical' THEN 'CRITICAL' ELSE 'HIGH' END AS severity, count(*) AS n FROM snapshots GROUP BY 1, 2",
    "schema_diff": _with(*SNAP, DIFF) + f"SELECT {CHANGE_COLUMNS}, "
        f"{NAME.format('max(' + RANK.format('severity') + ') OVER (PARTITION BY source, run_id)')} AS overall_severity FROM changes",
    "schema_drift_anomalies": DRIFT, "stream_schema_drift": DRIFT, "schema_drift_ungated": DRIFT, "stream_schema_drift_ungated": DRIFT,
    # E
    "test_not_null": f"SELECT run_id, test_name, column_name, failures, CASE WHEN failures > 0 THEN 'fail' ELSE 'pass' END AS status FROM ({NOT_NULL})",
    "test_unique": f"SELECT run_id, test_name, column_name, failures, CASE WHEN failures > 0 THEN 'fail' ELSE 'pass' END AS status FROM ({UNIQUE})",
    "test_accepted_values": f"SELECT run_id, test_name, column_name, failures, CASE WHEN failures > 0 THEN 'fail' ELSE 'pass' END AS status FROM ({ACCEPTED})",
    "test_between": f"SELECT run_id, test_name, column_name, failures, CASE WHEN failures > 0 THEN 'fail' ELSE 'pass' END AS status FROM ({BETWEEN})",
    "resolve_test_models": _with(TESTS) + "SELECT run_id, 'test.' || model_name || '.' || test_name || '.' || column_name AS unique_id, model_name, failures FROM tests",
    "failed_tests": _with(TESTS) + f"SELECT {FLAT_TEST} FROM tests WHERE status = 'fail'",
    "test_history": _with(TESTS) + f"SELECT model_name, test_name, run_id, status = 'pass' AS passed, CAST(failures AS DOUBLE) AS failure_rate, {_ts('run_at')} AS run_at, position FROM tests",
    "flakiness": _with(TESTS, FLAKY) + "SELECT * REPLACE (round(flakiness_rate, 4) AS flakiness_rate) FROM flaky",
    "test_severity": FLAT_SCORES + f"SELECT run_id, model_name, test_name, column_name, failures, {FLAT_SEVERITY}, is_flaky, is_new_test FROM scored",
    "quality_anomalies": QUALITY, "stream_quality": QUALITY,
    "quality_anomaly_tests": FLAT_SCORES + f"SELECT sha256('quality|' || run_id || '|' || model_name) AS signal_id, run_id, model_name, test_name, column_name, failures, {FLAT_SEVERITY}, is_flaky, 'high' AS blast_radius, 'data-platform' AS oncall_team, 'Got ' || failures || ' results' AS message FROM scored",
    "run_summary": _with(TESTS) + "SELECT run_id, count(*) AS total_tests, count(*) FILTER (status = 'fail') AS failed_tests, count(DISTINCT model_name) FILTER (status = 'fail') AS n_signals FROM tests GROUP BY 1",
    # F
    "models": _with(CATALOG) + "SELECT project, uid, name, 'analytics' AS schema, 'prod' AS database, 'The ' || name AS description, level AS tags, level FROM models",
    "exposures": _with(CATALOG) + "SELECT project, uid, name, kind AS exposure_type, 'About ' || name AS description, string_agg(node, ',' ORDER BY node) AS depends_on, owner, 'https://bi.example/' AS url, sla FROM needs GROUP BY ALL",
    "edges": _with(CATALOG) + "SELECT project, parent, child FROM links",
    "invert_edges": _with(TABLE_GRAPH) + "SELECT parent, child FROM links",
    "manifest_counts": _with(CATALOG) + "SELECT project, n_models, n_exposures FROM (SELECT project, count(*) AS n_models FROM models GROUP BY 1) JOIN (SELECT project, count(DISTINCT uid) AS n_exposures FROM needs GROUP BY 1) USING (project)",
    "resolve_model": _with(CATALOG, ANOMALIES) + "SELECT DISTINCT a.model_name AS name, coalesce(m.uid, '') AS uid FROM anomalies a LEFT JOIN models m ON m.name = a.model_name WHERE a.model_name IS NOT NULL",
    "downstream_models": _with(*BIG[:2], recursive=True) + "SELECT start, node FROM reach",
    "downstream_models_tree": _with("links AS (SELECT 'model.o' || CAST(floor((o_orderkey - 1) / 2) AS BIGINT) AS parent, 'model.o' || o_orderkey AS child FROM orders WHERE o_orderkey > 0)",
                                    _reach("links", "SELECT 'model.o' || o_orderkey AS start FROM orders"), recursive=True) + "SELECT start, count(*) AS n FROM reach GROUP BY 1",
    "exposures_for_models": _with(*BIG, recursive=True) + "SELECT start, uid AS exposure_uid, name, kind AS exposure_type, sla FROM hit",
    "blast_radius": _with(*BIG, BLAST, recursive=True) + "SELECT model_name, model_uid, n_downstream, n_dashboards, n_ml, n_sla, severity_multiplier FROM blast",
    "blast_members": _with(*BIG, MEMBERS, recursive=True) + "SELECT model_name, kind, member FROM members",
    "blast_radius_lists": _with(*SMALL, BLAST, ANOMALIES, NAMED_BLAST, recursive=True) + "SELECT * FROM named",
    "severity_multiplier": _with(*BIG, BLAST, recursive=True) + "SELECT severity_multiplier, count(*) AS n FROM blast GROUP BY 1",
    "escalate_by_blast": _with(*SMALL, BLAST, ANOMALIES, NAMED_BLAST, recursive=True) + f"SELECT severity, severity_multiplier, {ESCALATED} AS escalated, count(*) AS n FROM (SELECT a.severity, coalesce(n.severity_multiplier, 1.0::DOUBLE) AS severity_multiplier FROM anomalies a LEFT JOIN named n USING (model_name)) GROUP BY 1, 2, 3",
    "lineage_incidents": LINEAGE, "stream_lineage": LINEAGE, "stream_manifests": MANIFEST_VERSIONS,
    "impact_text": _with(*SMALL, BLAST, ANOMALIES, NAMED_BLAST, recursive=True) + """SELECT model_name,
  CASE WHEN sla_breaches <> '' THEN 'SLA at risk: ' || replace(sla_breaches, ',', ', ') ELSE '' END AS sla_impact,
  concat_ws(chr(10), 'Model ''' || model_name || ''' failure affects:', '  • ' || n_downstream || ' downstream models',
    CASE WHEN dashboards <> '' THEN '  • Dashboards: ' || replace(dashboards, ',', ', ') END,
    CASE WHEN ml_features <> '' THEN '  • ML features: ' || replace(ml_features, ',', ', ') END,
    CASE WHEN sla_breaches <> '' THEN '  • SLA at risk: ' || replace(sla_breaches, ',', ', ') END) AS summary FROM named""",
    # G
    "signal_buckets": _with(*CORR[:2], recursive=True) + f"SELECT signal_id, run_id, bucket_id, {_ts('opened_at')} AS opened_at FROM bucketed",
    "clock_buckets": _with(ANOMALIES) + f"SELECT run_id, {_ts('w')} AS window_start, {_ts('w + INTERVAL 5 MINUTE')} AS window_end, count(*) AS n FROM (SELECT run_id, time_bucket(INTERVAL 5 MINUTE, ts) AS w FROM anomalies) GROUP BY run_id, w",
    "bucket_summary": _with(*CORR, recursive=True) + f"SELECT bucket_id, run_id, {_ts('opened_at')} AS opened_at, anomaly_types, severity, models, n_signals FROM facts",
    "suppress_buckets": _with(*CORR, recursive=True) + "SELECT bucket_id, suppressed FROM facts",
    "correlate": _with(*CORR, recursive=True) + "SELECT bucket_id, root_cause, round(confidence, 4) AS confidence, root_cause = 'unknown' AS needs_llm FROM ruled",
    "confirmed_incidents": INCIDENTS, "stream_buckets": INCIDENTS,
    "incident_signals": _with(*CORR, recursive=True) + "SELECT sha256('incident|' || bucket_id) AS incident_id, signal_id FROM bucketed",
    "hypothesis_requests": _with(*CORR, recursive=True) + f"""SELECT bucket_id, signal_id, {_ts('b.ts')} AS ts, anomaly_type,
  coalesce(b.model_name, '') AS model_name, b.severity, round(b.confidence, 4) AS confidence, json_extract_string(b.details, '$.k') AS detail_k,
  anomaly_type AS json_anomaly_type, coalesce(b.model_name, '') AS json_model_name, b.severity AS json_severity, round(b.confidence, 4) AS json_confidence
FROM bucketed b JOIN ruled r USING (bucket_id) WHERE r.root_cause = 'unknown'""",
    "enriched_incidents": _with(*RESPONSE, recursive=True) + """SELECT incident_id, root_cause, severity, n_downstream, n_dashboards, n_ml, n_sla, severity_multiplier,
  coalesce(sla_impact, '') AS sla_impact FROM enriched""",
    "incident_members": _with(*RESPONSE, recursive=True) + "SELECT incident_id, kind, member FROM unions",
    # H
    "plan_actions": _with(*RESPONSE, PLAN, recursive=True) + "SELECT incident_id, action_seq, action_type, target, full_refresh, reason, touching AS requires_approval, description FROM plan",
    "requires_approval": _with(*RESPONSE, PLAN, recursive=True) + "SELECT action_type, mode, count(*) FILTER (touching AND mode = 'supervised') AS n_approvals, count(*) AS n FROM plan, (SELECT unnest(['shadow', 'alert_only', 'supervised', 'full_autonomy']) AS mode) GROUP BY 1, 2",
    "action_disposition": _with(*RESPONSE, PLAN, recursive=True) + """SELECT action_type, mode, CASE WHEN mode = 'shadow' THEN 'logged'
  WHEN mode = 'alert_only' AND action_type <> 'notify_slack' THEN 'skipped' WHEN mode = 'supervised' AND touching THEN 'skipped' ELSE 'executed' END AS disposition,
  count(*) AS n FROM plan, (SELECT unnest(['shadow', 'alert_only', 'supervised', 'full_autonomy']) AS mode) GROUP BY 1, 2, 3""",
    "incident_fields": _with(*RESPONSE, recursive=True) + """SELECT incident_id, primary_model, blast_summary,
  CASE severity WHEN 'CRITICAL' THEN '🚨' WHEN 'HIGH' THEN '🔴' WHEN 'MEDIUM' THEN '🟡' ELSE '🟢' END || ' *[' || severity
  || '] Data Pipeline Incident*' || chr(10) || '*Root cause:* `' || root_cause || '`' || chr(10) || '*Model:* `' || primary_model
  || '` | *Run:* `' || run_id || '`' || chr(10) || '*Blast radius:* ' || blast_summary || chr(10) AS alert_text
FROM (SELECT *, concat_ws(', ', n_downstream || ' models', CASE WHEN n_dashboards > 0 THEN n_dashboards || ' dashboards' END,
                          'SLA: ' || sla_impact) AS blast_summary FROM enriched)""",
    "quarantine_split": _with(SIGNALS_ORDERS, BASED, SCORED,
        f"held AS (SELECT source, ts FROM (SELECT source, ts, {Z_SEVERITY} AS severity {ROWS_HIT}) WHERE severity IN ('HIGH', 'CRITICAL'))")
        + "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 1) AS total, CASE WHEN h.source IS NULL THEN 'clean' ELSE 'quarantined' END AS side FROM orders LEFT JOIN held h ON h.source = o_orderpriority AND h.ts = date_trunc('day', o_orderdate) GROUP BY 1, 4",
    "action_log": _with(*RESPONSE, PLAN, LOG, recursive=True) + f"SELECT action_id, incident_id, action_type, target, success, error_message, {_ts('executed_at')} AS executed_at FROM log",
    "incident_actions": _with(*RESPONSE, PLAN, LOG, recursive=True) + f"SELECT action_type, target, success, error_message, {_ts('executed_at')} AS executed_at FROM log WHERE incident_id = (SELECT max(incident_id) FROM log)",
    # I
    "feedback_report": _with(*CORR, recursive=True) + "SELECT root_cause, CASE WHEN severity IN ('HIGH', 'CRITICAL') THEN 'true_positive' ELSE 'false_positive' END AS feedback, count(*) AS n FROM incidents WHERE opened_at + INTERVAL 1 HOUR > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY GROUP BY 1, 2",
    "open_incidents": _with(*CORR, recursive=True) + f"SELECT incident_id, root_cause, severity, 'open' AS status, {_ts('opened_at')} AS created_at FROM incidents WHERE n_signals > 1",
    "recent_actions": _with(*RESPONSE, PLAN, LOG, recursive=True) + f"SELECT action_type, target, success, {_ts('executed_at')} AS executed_at FROM (SELECT * FROM log ORDER BY executed_at DESC, action_id LIMIT 20)",
    "agent_status": f"SELECT agent_name, {_ts('ts')} AS last_seen, status FROM (SELECT 'agent_' || user_id AS agent_name, ts, CASE WHEN event_type = 'error' THEN 'error' ELSE 'alive' END AS status FROM events) QUALIFY row_number() OVER (PARTITION BY agent_name ORDER BY ts DESC, status DESC) = 1",
    "missing_agents": "SELECT 'agent_' || c_custkey AS agent_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30')",
    "stage_counters": _with(*RESPONSE, PLAN, *SIG, BASED, SCORED, CHECKED, recursive=True) + f"""
SELECT 'ingestion' AS stage, 'processed' AS counter, count(*) AS n FROM signals
UNION ALL SELECT 'ingestion', 'detected', count(*) FROM (SELECT 1 FROM signals WHERE row_count = 0 UNION ALL SELECT 1 {ROWS_HIT} UNION ALL SELECT 1 {CHECK_HIT})
UNION ALL SELECT 'correlation', CASE WHEN suppressed THEN 'suppressed' ELSE 'emitted' END, count(*) FROM facts GROUP BY suppressed
UNION ALL SELECT 'remediation', CASE WHEN touching THEN 'skipped' ELSE 'executed' END, count(*) FROM plan GROUP BY touching""",
    "reconcile_partitions": _with(f"""sides AS (SELECT o_orderpriority AS source, strftime(o_orderdate, '%Y%m') AS partition, count(*) AS left_count,
  count(*) FILTER (o_totalprice <= 499000) AS right_count, count(*) FILTER (o_totalprice > 499000) AS lost FROM orders GROUP BY 1, 2)""")
        + "SELECT source, partition, left_count, right_count, left_count - right_count AS diff, lost = 0 AS checksum_equal FROM sides",
    "live_counters": _with(*SIG) + f"""SELECT 'ingestion' AS stage, 'processed' AS counter, count(*) AS n FROM signals
UNION ALL SELECT 'ingestion', 'empty', count(*) FROM signals WHERE row_count = 0
UNION ALL SELECT 'correlation', 'processed', count(*) FROM ({INGESTION})
UNION ALL SELECT 'correlation', 'critical', count(*) FROM ({INGESTION}) WHERE severity = 'CRITICAL'""",
    # J
    "stream_ingestion_anomalies": INGESTION,
    "emit_gate": _with(ANOMALIES) + "SELECT severity, count(*) AS n, mode FROM anomalies, (SELECT unnest(['alert_only', 'supervised', 'full_autonomy']) AS mode) GROUP BY 1, 3",
    "late_signals": _with(*SIG) + """SELECT source, hour(ts) % 3 = 0 AND CASE
    WHEN ts + INTERVAL 10 DAY < TIMESTAMP '2024-01-11' THEN false
    WHEN ts + INTERVAL 10 DAY < TIMESTAMP '2024-01-21' THEN ts < TIMESTAMP '2024-01-10 23:00:00' - INTERVAL 1 DAY
    ELSE ts < TIMESTAMP '2024-01-20 23:00:00' - INTERVAL 1 DAY END AS is_late, count(*) AS n FROM signals GROUP BY 1, 2""",
}

# artifacts put the tested models' own result rows before the tests, which moves the positions
_ARTIFACT_TESTS = _with(TESTS) + f"""
SELECT {FLAT_TEST.replace(' position,', ' seq AS position,')} FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY position) - 1
            + count(DISTINCT model_name) OVER (PARTITION BY run_id) AS seq FROM tests)"""
for _name in ("parse_test_results", "read_test_results", "new_artifacts"):
    ORACLES[_name] = _ARTIFACT_TESTS
ORACLES["merge_baselines"] = ORACLES["baseline_table"]
ORACLES["stream_freshness"] = ORACLES["freshness_violations"]
