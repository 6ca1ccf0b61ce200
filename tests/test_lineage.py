import json
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.severity import escalate_by_blast, severity_multiplier
from tidewatch.operators import lineage, reach
from tidewatch.sources import artifacts


def node(uid):
    kind, _, name = uid.split(".")
    return {"unique_id": uid, "name": name, "resource_type": kind, "schema": "water",
            "database": "prod", "description": "", "tags": ["t"], "config": {"meta": {"owner": "x"}}}


# a chain into a loop, a model of a shared package that feeds both, and a second project that uses the package
SEA = {
    "model.sea.tide_raw": ["model.sea.tide_clean"], "model.sea.tide_clean": ["test.sea.in_range", "model.sea.tide_daily"],
    "model.common.calendar": ["model.sea.tide_daily", "model.sea.port_calls"], "model.sea.tide_daily": ["model.sea.port_calls"],
    "model.sea.port_calls": ["model.sea.berth_plan"], "model.sea.berth_plan": ["model.sea.port_calls"], "test.sea.in_range": []}
LAND = {"model.common.calendar": ["model.land.rail"], "model.land.rail": ["model.land.tide_daily"], "model.land.tide_daily": []}
BOARD = {"exposure.sea.board": {"name": "harbour_board", "type": "dashboard", "owner": {"name": "Pilots"}, "url": "u", "meta": {"sla": "before_noon"},
                                "depends_on": {"nodes": ["model.sea.tide_daily", "source.sea.gauge"]}}}
EXPOSURES = {**BOARD, "exposure.sea.planner": {"name": "berth_forecast", "type": "ml", "owner": "Dockers", "meta": {},
                                               "depends_on": {"nodes": ["model.sea.berth_plan"]}},
             "exposure.sea.notes": {"name": "notes", "type": "notebook", "depends_on": {"nodes": ["model.sea.port_calls"]}}}


def manifest(project, children, exposures, parents=None):
    uids = sorted({*children, *(c for cs in children.values() for c in cs)})
    return {"metadata": {"project_name": project}, "nodes": {u: node(u) for u in uids}, "exposures": exposures,
            "child_map": {} if parents else children, "parent_map": parents or {}}


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("manifest")
    (folder / "manifest.json").write_text(json.dumps(manifest("sea", SEA, EXPOSURES), indent=1))
    return artifacts.read_manifest(spark, str(folder))


def test_manifest_tables(parsed):
    models, exposures, edges = parsed
    assert {m.uid for m in models.collect()} == {u for u in SEA if u.startswith("model.")}
    assert models.filter("name = 'tide_daily'").first().meta == {"owner": "x"}
    got = {e.name: (e.exposure_type, e.depends_on, e.owner, e.sla) for e in exposures.collect()}
    assert got["harbour_board"] == ("dashboard", ["model.sea.tide_daily"], "Pilots", "before_noon")
    assert got["berth_forecast"][2:] == ("Dockers", None)
    assert edges.count() == sum(map(len, SEA.values()))
    counts = lineage.manifest_counts(models, exposures).first()
    assert (counts.n_models, counts.n_exposures) == (6, 3)


def test_parent_map_replaces_an_empty_child_map(spark, tmp_path):
    parents = {}
    for parent, children in SEA.items():
        for child in children:
            parents.setdefault(child, []).extend([parent, parent])
    (tmp_path / "m.json").write_text(json.dumps(manifest("sea", SEA, {}, parents)))
    edges = artifacts.read_manifest(spark, str(tmp_path))[2]
    assert sorted((e.parent, e.child) for e in edges.collect()) == sorted((p, c) for p, cs in SEA.items() for c in cs)


def impact(spark, tables, names):
    models, exposures, edges = tables
    names = spark.createDataFrame([(n,) for n in names], "model_name string")
    blast = lineage.blast_radius(names, models, edges, exposures)
    return {r.model_name: r for r in lineage.impact_text(blast).collect()}


def test_blast_radius_of_each_model(spark, parsed):
    got = impact(spark, parsed, ["tide_raw", "tide_daily", "calendar", "port_calls", "nowhere"])
    table = {n: (r.n_downstream, r.n_dashboards, r.n_ml, r.n_sla, r.severity_multiplier) for n, r in got.items()}
    assert table == {"tide_raw": (4, 1, 1, 1, 2.5), "tide_daily": (2, 1, 1, 1, 2.0), "calendar": (3, 1, 1, 1, 2.5),
                     "port_calls": (2, 0, 1, 0, 1.0), "nowhere": (0, 0, 0, 0, 1.0)}
    assert got["tide_raw"].affected_models == ["berth_plan", "port_calls", "tide_clean", "tide_daily"]
    assert got["calendar"].sla_breaches == ["harbour_board (before_noon)"]
    assert got["tide_daily"].sla_impact == "SLA at risk: harbour_board (before_noon)"
    assert got["nowhere"].sla_impact is None
    assert got["port_calls"].summary == (
        "Model 'port_calls' failure affects:\n  • 2 downstream models\n  • ML features: berth_forecast")
    models, exposures, edges = parsed
    members = lineage.blast_members(spark.createDataFrame([("tide_daily",)], "model_name string"), models, edges, exposures)
    assert {(m.kind, m.member) for m in members.collect()} == {
        ("affected_model", "port_calls"), ("affected_model", "berth_plan"), ("dashboard", "harbour_board"),
        ("ml_feature", "berth_forecast"), ("sla_breach", "harbour_board (before_noon)")}


def test_what_two_manifests_share_counts_once(spark, tmp_path):
    both = {**LAND, "model.common.calendar": [*LAND["model.common.calendar"], "model.sea.tide_daily"], "model.sea.tide_daily": []}
    (tmp_path / "a.json").write_text(json.dumps(manifest("sea", SEA, EXPOSURES)))
    (tmp_path / "b.json").write_text(json.dumps(manifest("land", both, BOARD)))
    tables = artifacts.read_manifest(spark, str(tmp_path))
    assert tables[0].filter("name = 'calendar'").count() == 2
    got = impact(spark, tables, ["calendar", "rail"])
    assert got["calendar"].affected_models == ["berth_plan", "port_calls", "rail", "tide_daily", "tide_daily"]  # two projects have a tide_daily
    assert (got["calendar"].n_downstream, got["calendar"].n_dashboards, got["calendar"].n_ml, got["calendar"].n_sla) == (5, 1, 1, 1)
    assert got["rail"].affected_models == ["tide_daily"] and got["rail"].n_dashboards == 0


def test_lineage_incidents(spark, parsed):
    models, exposures, edges = parsed
    anomalies = spark.createDataFrame(
        [("s1", "row_count_anomaly", "r", "tide_daily", "HIGH", 0.9), ("s2", "schema_drift", "r", None, "HIGH", 1.0),
         ("s3", "schema_drift", "r", "nowhere", "LOW", 1.0), ("s4", "schema_drift", "r", "", "LOW", 1.0)],
        "signal_id string, anomaly_type string, run_id string, model_name string, severity string, confidence double"
    ).withColumn("ts", F.current_timestamp())
    names = anomalies.select("model_name").filter("model_name <> ''")
    blast = lineage.blast_radius(names, models, edges, exposures, lists=False)
    got = {(r.primary_model, r.root_cause, r.severity) for r in lineage.lineage_incidents(anomalies, blast).collect()}
    assert got == {("tide_daily", "row_count_anomaly", "CRITICAL"), ("nowhere", "schema_drift", "LOW")}


def test_multiplier_at_its_thresholds(spark):
    """Half a step from 3 models, a whole one from 10, half for any dashboard and any SLA, 3 at most."""
    grid = [(d, b, s) for d in (2, 3, 9, 10) for b in (0, 1, 2) for s in (0, 1)]
    want = [min(3.0, 1 + (1 if d >= 10 else 0.5 if d >= 3 else 0) + 0.5 * min(b, 1) + 0.5 * min(s, 1)) for d, b, s in grid]
    df = spark.createDataFrame(grid, "d int, b int, s int").select("d", "b", "s", severity_multiplier(F.col("d"), F.col("b"), F.col("s")).alias("m"))
    assert {(r.d, r.b, r.s): r.m for r in df.collect()} == dict(zip(grid, want))


def test_escalation(spark):
    df = spark.createDataFrame([("LOW", 2.0), ("HIGH", 3.0), ("CRITICAL", 3.0), ("MEDIUM", 1.9)], "s string, m double")
    assert [r[0] for r in df.select(escalate_by_blast(F.col("s"), F.col("m"))).collect()] == [
        "MEDIUM", "CRITICAL", "CRITICAL", "MEDIUM"]


def brute(edges, start):
    seen, queue = set(), [c for p, c in edges if p == start]
    while queue:
        n = queue.pop()
        if n not in seen:
            seen.add(n)
            queue += [c for p, c in edges if p == n]
    return seen


@pytest.mark.parametrize("hops", [1, 3, 4])
def test_reachability_equals_search_on_graphs_with_cycles(spark, hops):
    rnd = random.Random(hops)
    graph = [(f"g{g}n{rnd.randrange(14)}", f"g{g}n{rnd.randrange(14)}") for g in range(6) for _ in range(17)]
    graph += [(f"chain{i}", f"chain{i + 1}") for i in range(13)]
    starts = sorted({n for e in graph for n in e})
    got = lineage.reachable(spark.createDataFrame([(s,) for s in starts], "start string"),
                            spark.createDataFrame(graph, "parent string, child string"), hops).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == {(s, n) for s in starts for n in brute(graph, s)}


def test_cycle_through_the_start_and_name_lookup(spark):
    edges = spark.createDataFrame([("model.a", "snapshot.x"), ("snapshot.x", "model.b"), ("model.b", "model.a")],
                                  "parent string, child string")
    starts = spark.createDataFrame([("model.a",)], "start string")
    assert {r.node for r in lineage.downstream_models(starts, edges).collect()} == {"model.a", "model.b"}
    models = spark.createDataFrame([("u2", "dup", 2), ("u1", "dup", 1)], "uid string, name string, pos int")
    got = lineage.resolve_model(spark.createDataFrame([("dup",), ("no",)], "name string"), models).collect()
    assert {r.name: r.uid for r in got} == {"dup": "u1", "no": None}


def test_closure_updated_by_changed_edges_equals_a_new_one(spark):
    rnd = random.Random(9)
    def table(rows):
        return spark.createDataFrame(sorted(rows), "parent bigint, child bigint")
    edges = {(g * 200 + rnd.randrange(15), g * 200 + rnd.randrange(15)) for g in range(5) for _ in range(20)} | {(1000 + i, 1001 + i) for i in range(70)}
    words = reach.closure(table(edges))
    for _ in range(4):
        gone = set(rnd.sample(sorted(edges), 6))
        now = (edges - gone) | {(rnd.randrange(1000), rnd.randrange(1100)) for _ in range(3)} | {(1000 + rnd.randrange(60), 64 * rnd.randrange(30))}
        words = reach.updated(words, table(edges), table(now))
        edges = now
        got = {(r.node, r.reached) for r in reach.members(words).collect()}
        assert got == {(a, b) for a in {p for p, _ in edges} for b in brute(edges, a)}
    assert words.filter("mask = 0").isEmpty()


def test_members_read_the_stored_closure(spark):
    """The pairs behind the members are found once, though models and exposures both need them."""
    models = spark.createDataFrame([("model.a", "a", 0), ("model.b", "b", 1)], "uid string, name string, pos int")
    edges = spark.createDataFrame([("model.a", "model.b")], "parent string, child string")
    views = spark.createDataFrame([("exposure.v", "v", "dashboard", ["model.b"], None)],
                                  "uid string, name string, exposure_type string, depends_on array<string>, sla string")
    found = lineage.blast_members(models.select(models.name.alias("model_name")), models, edges, views)
    assert "bit_or" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("a", "affected_model", "b"), ("a", "dashboard", "v"), ("b", "dashboard", "v")]
