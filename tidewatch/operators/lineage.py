"""Model lineage: reachability, exposures, blast radius.

A manifest is three tables: models (uid, name, schema, database, description, tags, meta,
pos), exposures (uid, name, exposure_type, description, depends_on, owner, url, sla) and
edges (parent, child).
"""

from pyspark.sql import DataFrame, functions as F

from tidewatch.functions.keys import stable_id
from tidewatch.functions.severity import escalate_by_blast, severity_multiplier
from tidewatch.operators import reach
from tidewatch.sources.storage import checkpointed

MODEL_PREFIX = "model."


def models(manifests: DataFrame) -> DataFrame:
    """Model nodes of the manifests (project, nodes), in manifest order."""
    nodes = manifests.select(
        "project", F.posexplode(F.map_entries("nodes")).alias("pos", "e"))
    return nodes.filter(F.col("e.value.resource_type") == "model").select(
        "project", F.col("e.key").alias("uid"), F.coalesce("e.value.name", F.lit("")).alias("name"),
        F.coalesce("e.value.schema", F.lit("")).alias("schema"),
        F.coalesce("e.value.database", F.lit("")).alias("database"),
        F.coalesce("e.value.description", F.lit("")).alias("description"),
        F.col("e.value.tags").alias("tags"), F.col("e.value.config.meta").alias("meta"), "pos")


def exposures(manifests: DataFrame) -> DataFrame:
    """Exposures with the models they depend on; the owner is an object or a plain name."""
    rows = manifests.select("project", F.explode("exposures").alias("key", "v"))
    owner = F.when(F.col("v.owner").startswith("{"),
                   F.coalesce(F.get_json_object("v.owner", "$.name"), F.lit(""))
                   ).otherwise(F.coalesce("v.owner", F.lit("")))
    return rows.select(
        "project", F.col("key").alias("uid"), F.coalesce("v.name", F.lit("")).alias("name"),
        F.coalesce("v.type", F.lit("unknown")).alias("exposure_type"),
        F.coalesce("v.description", F.lit("")).alias("description"),
        F.filter(F.coalesce("v.depends_on.nodes", F.array().cast("array<string>")),
                 lambda n: n.startswith(MODEL_PREFIX)).alias("depends_on"),
        owner.alias("owner"), F.coalesce("v.url", F.lit("")).alias("url"),
        F.col("v.meta.sla").alias("sla"))


def edges(manifests: DataFrame) -> DataFrame:
    """(project, parent, child); taken from parent_map where a manifest has no child_map."""
    has_children = F.coalesce(F.size("child_map") > 0, F.lit(False))
    down = (manifests.filter(has_children)
            .select("project", F.explode("child_map").alias("parent", "children"))
            .select("project", "parent", F.explode("children").alias("child")))
    up = (manifests.filter(~has_children & F.col("parent_map").isNotNull())
          .select("project", F.explode("parent_map").alias("child", "parents")))
    inverted = invert_edges(up, ["project"]).select("project", "parent", "child")
    return down.unionByName(inverted)


def invert_edges(parents: DataFrame, keep: list | None = None) -> DataFrame:
    """(child, parents array) -> distinct (parent, child)."""
    return (parents.select(*(keep or []), F.explode("parents").alias("parent"), "child").distinct())


def manifest_counts(all_models: DataFrame, all_exposures: DataFrame) -> DataFrame:
    m = all_models.groupBy("project").agg(F.count(F.lit(1)).alias("n_models"))
    e = all_exposures.groupBy("project").agg(F.count(F.lit(1)).alias("n_exposures"))
    return (m.join(e, "project", "full_outer")
            .select("project", F.coalesce("n_models", F.lit(0)).alias("n_models"),
                    F.coalesce("n_exposures", F.lit(0)).alias("n_exposures")))


def _in_order(rows: DataFrame):
    """The order of manifests and of the nodes inside one, as far as the table has it."""
    return F.struct(*[c for c in ("project", "pos", "uid") if c in rows.columns])


def one_per_uid(rows: DataFrame) -> DataFrame:
    """Models or exposures, each uid once: what several manifests share is one node, as its first manifest has it."""
    rest = [c for c in rows.columns if c != "uid"]
    return (rows.groupBy("uid").agg(F.min_by(F.struct(*rest), _in_order(rows)).alias("r"))
            .select("uid", "r.*").select(*rows.columns))


def resolve_model(names: DataFrame, all_models: DataFrame) -> DataFrame:
    """Short name -> uid; the first model in the order of manifests and nodes, NULL if there is none."""
    first = all_models.groupBy("name").agg(F.min(_in_order(all_models)).alias("m"))
    return (names.select("name").distinct()
            .join(first, "name", "left").select("name", F.col("m.uid").alias("uid")))


def _ends(all_edges: DataFrame) -> DataFrame:
    return all_edges.select(F.col("parent").alias("uid")).unionByName(all_edges.select(F.col("child").alias("uid")))


def _by_number(all_edges: DataFrame, numbers: DataFrame) -> DataFrame:
    parent, child = (numbers.select(F.col("uid").alias(c), F.col("number").alias(f"_{c}")) for c in ("parent", "child"))
    return all_edges.join(parent, "parent").join(child, "child").select(
        F.col("_parent").alias("parent"), F.col("_child").alias("child"))


def _numbers(starts: DataFrame, all_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbers of all nodes; edges and starts by number."""
    all_edges = checkpointed(all_edges.select("parent", "child"), "edges")
    numbers = reach.numbered(_ends(all_edges).unionByName(starts.select(F.col("start").alias("uid"))))
    edges = _by_number(all_edges, numbers)
    own = checkpointed(starts.select(F.col("start").alias("uid")).distinct().join(numbers, "uid"), "starts")
    return numbers, edges, own


def reachable(starts: DataFrame, all_edges: DataFrame, hops: int = 4) -> DataFrame:
    """All (start, node) with a path of at least one edge from start to node, from the bitmaps of `reach.closure`.

    A start on a cycle finds itself.
    """
    numbers, edges, own = _numbers(starts, all_edges)
    pairs = reach.members(reach.closure(edges, own, hops).join(own.select(F.col("number").alias("node")), "node", "left_semi"))
    start, node = (numbers.select(F.col("number").alias(f"_{c}"), F.col("uid").alias(c)) for c in ("start", "node"))
    return (pairs.select(F.col("node").alias("_start"), F.col("reached").alias("_node"))
            .join(start, "_start").join(node, "_node").select("start", "node"))


def downstream_models(starts: DataFrame, all_edges: DataFrame, hops: int = 4) -> DataFrame:
    """Models downstream of each start; paths may lead through other kinds of nodes."""
    return reachable(starts, all_edges, hops).filter(F.col("node").startswith(MODEL_PREFIX))


def downstream_counts(starts: DataFrame, all_edges: DataFrame, hops: int = 4) -> DataFrame:
    """(start, n): how many models lie downstream of each start that has any, counted in bitmaps."""
    numbers, edges, own = _numbers(starts, all_edges)
    marked = reach.marks(numbers, {"n": F.col("uid").startswith(MODEL_PREFIX)})
    found = reach.counts(reach.closure(edges, own, hops), marked).filter("n > 0")
    return own.join(found, F.col("number") == F.col("node")).select(F.col("uid").alias("start"), "n")


def exposures_for_models(affected: DataFrame, all_exposures: DataFrame) -> DataFrame:
    """Exposures that depend on any node affected by a start."""
    needs = all_exposures.select(
        F.col("uid").alias("exposure_uid"), "name", "exposure_type", "sla",
        F.explode(F.array_distinct("depends_on")).alias("node"))
    return (affected.join(needs, "node")
            .select("start", "exposure_uid", "name", "exposure_type", "sla").distinct())


def _impact(model_names: DataFrame, all_models: DataFrame, all_edges: DataFrame,
            all_exposures: DataFrame, hops: int):
    all_exposures = one_per_uid(all_exposures)
    named = checkpointed(resolve_model(model_names.select(F.col("model_name").alias("name")), all_models).select(
        F.col("name").alias("model_name"), F.col("uid").alias("model_uid")), "named")
    starts = named.filter(F.col("model_uid").isNotNull()).select(F.col("model_uid").alias("start"))
    down = checkpointed(downstream_models(starts, all_edges, hops), "downstream")
    # names, and the count, only cover uids a manifest describes
    known = down.join(one_per_uid(all_models).select(F.col("uid").alias("node"), "name"), "node")
    own = starts.select("start", F.col("start").alias("node"))
    hit = exposures_for_models(down.unionByName(own), all_exposures)
    return named, known, hit


def blast_members(model_names: DataFrame, all_models: DataFrame, all_edges: DataFrame,
                  all_exposures: DataFrame, hops: int = 4) -> DataFrame:
    """The blast radius in long form: (model_name, kind, member), kind being affected_model,
    dashboard, ml_feature or sla_breach. Grows with the graph but never packs a group into a row.
    """
    named, known, hit = _impact(model_names, all_models, all_edges, all_exposures, hops)
    kinds = F.filter(F.array(
        F.when(F.col("exposure_type").isin("dashboard", "analysis"),
               F.struct(F.lit("dashboard").alias("kind"), F.col("name").alias("member"))),
        F.when(F.col("exposure_type") == "ml",
               F.struct(F.lit("ml_feature").alias("kind"), F.col("name").alias("member"))),
        F.when(F.col("sla") != "",
               F.struct(F.lit("sla_breach").alias("kind"),
                        F.concat("name", F.lit(" ("), "sla", F.lit(")")).alias("member")))),
        lambda x: x.isNotNull())
    rows = (known.select("start", F.lit("affected_model").alias("kind"), F.col("name").alias("member"))
            .unionByName(hit.select("start", F.inline(kinds))))
    return (named.join(rows, named["model_uid"] == rows["start"])
            .select("model_name", "kind", "member"))


def blast_counts(model_names: DataFrame, all_models: DataFrame, all_edges: DataFrame, all_exposures: DataFrame,
                 hops: int = 4) -> DataFrame:
    """(model_name, model_uid, n_downstream, n_dashboards, n_ml, n_sla) of each name, without the pairs behind them.

    Exposures are nodes below the models they depend on, so one closure has models and exposures in its bitmaps.
    """
    named = resolve_model(model_names.select(F.col("model_name").alias("name")), all_models).select(
        F.col("name").alias("model_name"), F.col("uid").alias("model_uid"))
    named = checkpointed(named, "named")
    starts = named.filter(F.col("model_uid").isNotNull()).select(F.col("model_uid").alias("start")).distinct()
    reports = checkpointed(_reports(all_exposures), "reports")
    numbers, edges, own = _numbers(starts, _with_reports(all_edges, reports, starts))
    return _counted(named, reach.closure(edges, own, hops), numbers, all_models, reports)


def _reports(all_exposures: DataFrame) -> DataFrame:
    """Exposures under names that no node has."""
    return one_per_uid(all_exposures).withColumn("uid", F.concat(F.lit("exposure "), "uid"))


def _with_reports(all_edges: DataFrame, reports: DataFrame, starts: DataFrame) -> DataFrame:
    """The edges, and those from models and starts to the exposures that depend on them."""
    needs = reports.select(F.explode(F.array_distinct("depends_on")).alias("parent"), F.col("uid").alias("child"))
    other = starts.filter(~F.col("start").startswith(MODEL_PREFIX)).select(F.col("start").alias("parent"))
    hits = needs.filter(F.col("parent").startswith(MODEL_PREFIX)).unionByName(needs.join(other, "parent", "left_semi"))
    return all_edges.select("parent", "child").unionByName(hits).distinct()


def _counted(named: DataFrame, words: DataFrame, numbers: DataFrame, all_models: DataFrame, reports: DataFrame) -> DataFrame:
    """Impact counts of (model_name, model_uid) from the closure of models and exposures."""
    known = all_models.filter(F.col("uid").startswith(MODEL_PREFIX)).select("uid").distinct().withColumn("_known", F.lit(True))
    described = (numbers.join(known, "uid", "left").join(reports.select("uid", "exposure_type", "sla"), "uid", "left"))
    marked = reach.marks(described, {
        "n_downstream": F.col("_known"), "n_dashboards": F.col("exposure_type").isin("dashboard", "analysis"),
        "n_ml": F.col("exposure_type") == "ml", "n_sla": F.col("sla") != ""})
    found = numbers.join(reach.counts(words, marked), F.col("number") == F.col("node")).drop("number", "node")
    counts = ["n_downstream", "n_dashboards", "n_ml", "n_sla"]
    return named.join(found.withColumnRenamed("uid", "model_uid"), "model_uid", "left").select(
        "model_name", "model_uid", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts])


def update_graph(all_models: DataFrame, all_edges: DataFrame, all_exposures: DataFrame,
                 before: tuple[DataFrame, DataFrame, DataFrame] | None = None, hops: int = 4) -> tuple:
    """((numbers, edges, closure), blast counts of all models by name) of a catalog.

    Given the graph of the catalog as it was before, only what the added and removed edges change is found anew.
    """
    reports = checkpointed(_reports(all_exposures), "reports")
    uids = all_models.select(F.col("uid").alias("start")).distinct()
    text = checkpointed(_with_reports(all_edges, reports, uids), "edges")
    names = _ends(text).unionByName(uids.select(F.col("start").alias("uid")))
    numbers = reach.numbered(names) if before is None else checkpointed(reach.renumbered(before[0], names), "numbers")
    edges = checkpointed(_by_number(text, numbers), "steps")
    words = reach.closure(edges, hops=hops) if before is None else reach.updated(before[2], before[1], edges, hops)
    words = checkpointed(words, "reached")
    named = resolve_model(all_models.select("name"), all_models).select(F.col("name").alias("model_name"), F.col("uid").alias("model_uid"))
    multiplier = severity_multiplier(F.col("n_downstream"), F.col("n_dashboards"), F.col("n_sla")).alias("severity_multiplier")
    return (numbers, edges, words), _counted(named, words, numbers, all_models, reports).select("*", multiplier)


def blast_radius(model_names: DataFrame, all_models: DataFrame, all_edges: DataFrame,
                 all_exposures: DataFrame, hops: int = 4, lists: bool = True) -> DataFrame:
    """Impact of each failed model; unknown models have an empty one with multiplier 1.

    With `lists`, the sorted names are packed into arrays as the incident message wants
    them: their length is what one manifest has downstream of a model. Use lists=False
    (counts only, from bitmaps) with `blast_members` for graphs that grow with the data.
    """
    multiplier = severity_multiplier(F.col("n_downstream"), F.col("n_dashboards"), F.col("n_sla")).alias("severity_multiplier")
    if not lists:
        return blast_counts(model_names, all_models, all_edges, all_exposures, hops).select("*", multiplier)
    members = blast_members(model_names, all_models, all_edges, all_exposures, hops)
    kinds = {"affected_models": "affected_model", "dashboards": "dashboard", "ml_features": "ml_feature", "sla_breaches": "sla_breach"}
    packed = members.groupBy("model_name").agg(*[
        F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("member")))).alias(c) for c, kind in kinds.items()])
    named = resolve_model(model_names.select(F.col("model_name").alias("name")), all_models).select(
        F.col("name").alias("model_name"), F.col("uid").alias("model_uid"))
    none = F.array().cast("array<string>")
    report = named.join(packed, "model_name", "left").select("model_name", "model_uid", *[F.coalesce(c, none).alias(c) for c in kinds])
    sizes = {"n_downstream": "affected_models", "n_dashboards": "dashboards", "n_ml": "ml_features", "n_sla": "sla_breaches"}
    return (report.select("model_name", "model_uid", *[F.size(c).cast("bigint").alias(n) for n, c in sizes.items()], *kinds)
            .select("*", multiplier))


def lineage_incidents(anomalies: DataFrame, blast: DataFrame) -> DataFrame:
    """One incident per anomaly that names a model, with its blast radius."""
    named = anomalies.filter(F.coalesce(F.col("model_name"), F.lit("")) != "")
    impact = [c for c in blast.columns if c != "model_name"]
    severity = escalate_by_blast(F.col("severity"), F.coalesce("severity_multiplier", F.lit(1.0)))
    return (named.join(blast, "model_name", "left")
            .select(stable_id(F.lit("lineage"), "signal_id").alias("incident_id"), "run_id",
                    F.col("ts").alias("opened_at"), F.col("anomaly_type").alias("root_cause"),
                    severity.alias("severity"), "confidence", F.lit(False).alias("needs_llm"),
                    F.lit(1).cast("bigint").alias("n_signals"),
                    F.col("model_name").alias("primary_model"), *impact))


def impact_text(blast: DataFrame) -> DataFrame:
    """Adds the SLA sentence and the multi-line summary of a blast radius with lists."""
    # The sentences of the impact summary.
    def line(label, c):
        return F.when(F.size(c) > 0, F.concat(F.lit(f"  • {label}: "), F.array_join(c, ", ")))

    sla = F.when(F.size("sla_breaches") > 0,
                 F.concat(F.lit("SLA at risk: "), F.array_join("sla_breaches", ", ")))
    summary = F.concat_ws(
        "\n",
        F.concat(F.lit("Model '"), F.col("model_name"), F.lit("' failure affects:")),
        F.concat(F.lit("  • "), F.size("affected_models").cast("string"), F.lit(" downstream models")),
        line("Dashboards", "dashboards"), line("ML features", "ml_features"),
        line("SLA at risk", "sla_breaches"))
    return blast.withColumn("sla_impact", sla).withColumn("summary", summary)
