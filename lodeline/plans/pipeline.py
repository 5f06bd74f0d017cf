"""The analysis as one plan: an inventory to detections, facts and what they resolve to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import anonymous_id, base_name, config_key_id, parent_dir
from ..functions.tables import written
from ..functions.values import digest, priority
from ..functions.workers import visible
from ..operators import catalog, detection, diagnostics, documents, enablement, facts, graph, ownership, profiles, regions, resolution
from ..sources import sinks

LEVELS = (1, 2)


def _charts(artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files named Chart.yaml that say what a chart must say, and (artifact_id, problem) of the others; filtered before they are parsed."""
    asked = artifacts.where((base_name(F.col("path")) == "Chart.yaml") & (F.col("source") != "")).select("artifact_id", "path", "source")
    keys = documents.yaml_keys(asked).where(F.size("keys") == 1)
    said = keys.where(~F.col("duplicate")).groupBy("artifact_id").pivot("path", ["apiVersion", "name", "version", "type"]).agg(F.first(F.trim("value")))
    said = said.withColumn("type", F.coalesce(F.nullif("type", F.lit("")), F.lit("application")))
    fits = F.col("apiVersion").isin("v1", "v2") & (F.col("name") != "") & (F.col("version") != "") & F.col("type").isin("application", "library")
    charts = asked.join(said.where(fits), "artifact_id").select(F.col("artifact_id").alias("chart"), "apiVersion", "name", "version", "type", parent_dir(F.col("path")).alias("directory"))
    problem = F.when(~F.coalesce(F.col("apiVersion").isin("v1", "v2"), F.lit(False)), "api version").otherwise("name, version or type is missing or wrong")
    return charts, said.where(~F.coalesce(fits, F.lit(False))).select("artifact_id", problem.alias("problem"))


def analyse(artifacts: DataFrame, app: str, level: int = 2, overrides: DataFrame | None = None, configurations: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of level 1 (detections, config_keys, actions, calls, references) and 2 (what they resolve to).

    Files are parsed once: what was read is written as tables, of which the others are plans. Each
    level adds tables and changes none of those below; ``overrides`` (artifact_id) names values
    files that a configuration applies, ``configurations`` (artifact_id) the files that declare profiles;
    what these apply is an override too. Plans above ``level`` are not built.
    """
    if level not in LEVELS:
        raise ValueError(f"level {level} is none of {LEVELS}")
    visible(artifacts.sparkSession)
    if "sha256" not in artifacts.columns:
        artifacts = artifacts.withColumn("sha256", digest(F.col("source")))
    artifacts = written(artifacts, "artifacts")
    charts, invalid = (written(df, tag) for df, tag in zip(_charts(artifacts), ("charts", "invalid-charts"), strict=True))
    declared = _profiles(artifacts, charts, app, configurations)
    applied = declared["layers"].where("key IS NULL").select(F.col("source").alias("artifact_id"))
    if configurations is not None:
        overrides = applied if overrides is None else overrides.select("artifact_id").unionByName(applied)
    files = artifacts.where(~detection.excluded(F.col("path")) & (F.col("source") != ""))
    owned = ownership.nearest_ancestor(files, "path", charts, "directory", "chart").where("chart IS NOT NULL").join(charts, "chart")
    relative = F.when(F.col("directory") == ".", F.col("path")).otherwise(F.substr(F.col("path"), F.length("directory") + 2))
    named = overrides.select("artifact_id", F.lit(True).alias("override")).distinct() if overrides is not None else None
    owned = owned.join(named, "artifact_id", "left") if named is not None else owned.withColumn("override", F.lit(False))
    kind = detection.kind_and_roles(relative, F.col("apiVersion"), F.col("type"), F.coalesce("override", F.lit(False)), detection.is_hook(F.col("source")))
    detections = owned.withColumn("k", kind).where("k IS NOT NULL").select("artifact_id", "path", "chart", "k.kind", "k.roles", "source")
    detections = written(detections, "detections")
    parsed = written(documents.yaml_keys(detections.where("kind IN ('helm_values', 'helm_requirements', 'helm_lock', 'helm_crd')")), "keys")
    values = detections.where("kind = 'helm_values'").select("artifact_id")
    keys = parsed.where("keys IS NOT NULL").join(values, "artifact_id", "left_semi")
    keys = keys.withColumn("key", config_key_id(F.col("artifact_id"), F.col("path")))
    actions = written(documents.template_actions(detections.where("kind = 'helm_template'")), "actions")
    out = {
        "artifacts": artifacts.drop("source"),
        "detections": detections.drop("source"),
        "charts": charts,
        "invalid_charts": invalid,
        **declared,
        "unreadable": parsed.where("keys IS NULL").select("artifact_id", "value", "status"),
        "config_keys": keys,
        "actions": actions,
        "references": documents.numbered_facts(documents.value_references(actions), "value-reference", "reference", ["path", "dynamic"]),
        "calls": documents.numbered_facts(documents.template_calls(actions), "template-call", "call", ["kind", "name"]),
        "lookups": documents.numbered_facts(documents.lookup_references(actions), "lookup-reference", "lookup", ["api", "resource", "namespace", "name"]),
        "templates": documents.named_templates(actions).withColumn("template", anonymous_id(F.col("artifact_id"), "named-template", F.col("line"), F.col("start"))),
    }
    out["unbalanced"] = documents.unbalanced(actions)
    read = _declared_dependencies(artifacts, detections, charts)
    of_kind = lambda kind: parsed.where("keys IS NOT NULL").join(detections.where(F.col("kind") == kind).select("artifact_id"), "artifact_id", "left_semi")
    locked = _items(of_kind("helm_lock"), ["name", "version", "repository"])
    locked = locked.withColumn("valid", _named(locked))
    out["locked"] = locked.where("valid").drop("valid")
    out["invalid_dependencies"] = read.where("NOT valid").select("artifact_id", "nth").unionByName(locked.where("NOT valid").select("artifact_id", "nth"))
    resources = documents.custom_resources(of_kind("helm_crd"))
    out["custom_resources"] = resources.where("valid").drop("valid")
    # A file without any is no definition either, unless it couldn't be read at all.
    empty = detections.where("kind = 'helm_crd'").select("artifact_id").join(parsed.where("status <> 'complete'"), "artifact_id", "left_anti").join(resources.where("valid"), "artifact_id", "left_anti")
    out["invalid_resources"] = resources.where("NOT valid").select("artifact_id").unionByName(empty.select("artifact_id")).distinct()
    out["import_values"] = _imports(read)
    bearing = F.arrays_overlap("roles", F.array(*(F.lit(r) for r in ("resource", "test", "hook"))))
    found = regions.template_regions(detections.where("kind = 'helm_template'").where(bearing))
    out["regions"] = written(found.withColumn("region", anonymous_id(F.col("artifact_id"), "resource-template", F.col("first_line"), F.col("start"))), "regions")
    if level < 2:
        out["diagnostics"] = diagnostics.of(app, artifacts, out)
        return out
    of = detections.join(charts.select("chart", "type"), "chart").select("artifact_id", "chart", "type", F.col("path").alias("file"), "roles")
    spoken = keys.where(~F.col("duplicate")).join(of, "artifact_id").select("chart", "path", "key", priority(F.col("roles")).alias("priority"), "kind", F.col("value").alias("text"))
    asked = out["references"].join(of.select("artifact_id", "chart"), "artifact_id")
    out["value_targets"] = resolution.value_targets(asked, spoken.drop("kind", "text"))
    children = written(ownership.vendored_children(charts).join(charts.select(F.col("chart").alias("child"), F.col("name").alias("child_name"), "version"), "child"), "children")
    found = resolution.dependency_targets(read.where("valid"), children, listed=True)
    out["dependencies"] = written(read.where("valid").select("dependency", "artifact_id", "owner", "name", "alias", "constraint", "repository", "condition", "tags").join(found, "dependency"), "dependencies")
    roots = charts.join(children.select(F.col("child").alias("chart")), "chart", "left_anti").select(F.col("chart").alias("root"))
    ways = written(enablement.links(children, out["dependencies"]), "ways")
    trees = enablement.trees(ways, roots, out["dependencies"], written(enablement.switches(spoken), "switches"))
    # Where a chart stands in a tree, and all the templates that may stand at a place there.
    named = charts.select(F.col("chart").alias("tree"), F.col("name").alias("root"))
    here = trees.join(named, "tree").withColumn("at", F.concat_ws("/", F.array("root"), F.transform("names", lambda n: F.concat(F.lit("charts/"), n))))
    trees = written(here.select("tree", "chart", "depth", "at", "group", "alternative"), "trees")
    out["trees"] = trees
    # Library charts lend their helpers only.
    lent = (F.col("type") != "library") | F.startswith(base_name(F.col("file")), F.lit("_"))
    inside = F.when(F.col("directory") == ".", F.col("file")).otherwise(F.substr(F.col("file"), F.length("directory") + 2))
    files = of.where(lent).join(charts.select("chart", "directory"), "chart").join(detections.where("kind = 'helm_template'").select("artifact_id"), "artifact_id", "left_semi")
    sources = trees.join(files.select("chart", "artifact_id", inside.alias("inside")), "chart")
    sources = sources.select("tree", F.concat_ws("/", "at", "inside").alias("file"), F.col("artifact_id").alias("source"), "group", "alternative")
    sources = written(sources, "sources")
    possible = ways.where("choice IS NOT NULL").groupBy("choice").agg(F.count_distinct("child").alias("alternatives"))
    groups = sources.where("group IS NOT NULL").select("tree", "group").distinct().withColumn("choice", F.element_at(F.split("group", r"\|"), -1)).join(possible, "choice").drop("choice")
    groups = written(groups, "groups")
    defined = sources.join(out["templates"].select(F.col("artifact_id").alias("source"), "name", F.col("template").alias("target"), "start", "empty"), "source")
    outcomes = written(resolution.possible_winners(sources, defined, groups), "outcomes")
    out["outcomes"] = outcomes
    callers = resolution.certain_callers(sources, groups)
    calls = out["calls"].where("name IS NOT NULL AND kind <> 'tpl'").join(sources.select("tree", F.col("source").alias("artifact_id")).distinct(), "artifact_id")
    calls = calls.select("tree", "call", "name", "artifact_id", "line").join(callers.select("tree", F.col("source").alias("artifact_id"), F.lit(True).alias("certain")), ["tree", "artifact_id"], "left")
    # A call of a file that is there in any case has the target that wins in any case; every call has its possible ones.
    won = outcomes.where("outcomes = 1 AND NOT absent").select("tree", "name", "target")
    aimed = calls.join(won, ["tree", "name"], "left").withColumn("target", F.when(F.col("certain"), F.col("target")))
    out["call_targets"] = aimed.select("tree", "call", "name", "artifact_id", "line", F.substring_index("target", "/named-template@", 1).alias("template"), "target")
    out["possible_targets"] = calls.join(outcomes.where("target IS NOT NULL"), ["tree", "name"]).select("tree", "call", "name", "artifact_id", "line", F.coalesce("certain", F.lit(False)).alias("certain"), "target", "outcomes", "absent")
    shared = sources.where("group IS NULL").groupBy("tree", "file").agg(F.count_distinct("source").alias("n")).where("n > 1")
    out["shared_places"] = shared
    out["diagnostics"] = diagnostics.of(app, artifacts, out)
    return out


def _profiles(artifacts: DataFrame, charts: DataFrame, app: str, configurations: DataFrame | None) -> dict[str, DataFrame]:
    """Tables of the profiles of configurations and, without any, of every chart; see profiles.configured_profiles."""
    own = profiles.default_profiles(charts, artifacts, app)
    if configurations is None:
        spark = artifacts.sparkSession
        return {"profiles": own, **{name: spark.createDataFrame([], schema) for name, schema in profiles.TABLES.items()}}
    unread = configurations.select("artifact_id").distinct().join(artifacts.select("artifact_id"), "artifact_id", "left_anti").take(5)
    if unread:
        raise ValueError(f"configurations that are not in the inventory: {[r[0] for r in unread]}")
    keys = written(documents.yaml_keys(artifacts.join(configurations.select("artifact_id").distinct(), "artifact_id", "left_semi")), "configurations")
    found = profiles.configured_profiles(keys, artifacts, charts, app)
    found["profiles"] = found["profiles"].unionByName(own)
    return {name: written(df, name) for name, df in found.items()}


def _items(keys: DataFrame, fields: list[str]) -> DataFrame:
    """(artifact_id, nth and fields) of the entries of the list of dependencies."""
    inside = (F.get("keys", F.lit(0)) == "dependencies") & ~F.col("duplicate")
    nth = F.get("keys", F.lit(1)).alias("nth")
    said = keys.where((F.size("keys") == 3) & inside).withColumn("field", F.get("keys", F.lit(2))).groupBy("artifact_id", nth).pivot("field", fields).agg(F.first(F.trim("value")))
    return keys.where((F.size("keys") == 2) & inside).select("artifact_id", nth).join(said, ["artifact_id", "nth"], "left")


def _named(items: DataFrame) -> Column:
    return (F.coalesce("name", F.lit("")) != "") & (F.coalesce("version", F.lit("")) != "")


def _imports(declared: DataFrame) -> DataFrame:
    """(dependency, item, name, child, parent) of the values that dependencies lend their owner."""
    return declared.where("valid").select("dependency", F.explode("imports").alias("x")).select("dependency", "x.*")


def _declared_dependencies(artifacts: DataFrame, detections: DataFrame, charts: DataFrame) -> DataFrame:
    """What charts declare in Chart.yaml and, of apiVersion v1, in the requirements.yaml beside it; valid: with a name and a version."""
    older = detections.where("kind = 'helm_requirements'").select("artifact_id", F.col("chart").alias("owner"))
    owners = charts.select(F.col("chart").alias("artifact_id"), F.col("chart").alias("owner")).unionByName(older)
    keys = written(documents.yaml_keys(artifacts.join(owners, "artifact_id", "left_semi")), "declared")
    inside = (F.get("keys", F.lit(0)) == "dependencies") & ~F.col("duplicate")
    nth = F.get("keys", F.lit(1)).alias("nth")
    each = _items(keys, ["name", "version", "alias", "repository", "condition"])
    listed = lambda name: keys.where((F.size("keys") == 4) & inside & (F.get("keys", F.lit(2)) == name) & F.col("value").isNotNull())
    nth = F.get("keys", F.lit(1)).alias("nth")
    tags = listed("tags").groupBy("artifact_id", nth).agg(F.array_sort(F.collect_set("value")).alias("tags"))
    # Values to import are names, or pairs of a child and a parent.
    pairs = keys.where((F.size("keys") == 5) & inside & (F.get("keys", F.lit(2)) == "import-values")).withColumn("field", F.get("keys", F.lit(4))).groupBy("artifact_id", nth, F.get("keys", F.lit(3)).alias("item")).pivot("field", ["child", "parent"]).agg(F.first("value"))
    single = listed("import-values").select("artifact_id", nth, F.get("keys", F.lit(3)).alias("item"), F.col("value").alias("name"), F.lit(None).cast("string").alias("child"), F.lit(None).cast("string").alias("parent"))
    every = single.unionByName(pairs.select("artifact_id", "nth", "item", F.lit(None).cast("string").alias("name"), "child", "parent"))
    imports = every.groupBy("artifact_id", "nth").agg(F.array_sort(F.collect_list(F.struct(F.col("item").cast("int").alias("item"), "name", "child", "parent"))).alias("imports"))
    each = each.join(tags, ["artifact_id", "nth"], "left").join(imports, ["artifact_id", "nth"], "left").join(owners, "artifact_id")
    valid = _named(each)
    return written(each.select(F.concat_ws("#", "artifact_id", "nth").alias("dependency"), "artifact_id", "nth", "owner", "name", "alias", F.col("version").alias("constraint"), "repository", "condition", "tags", "imports", valid.alias("valid")), "declared")


def run(artifacts: DataFrame, app: str, path: str, version: str = "1", strict: bool = False, **options) -> str:
    """The whole way: analyses an inventory, publishes its graph below ``path``, then judges the diagnostics.

    Raises before anything is written where the analysis or the graph breaks a rule, and after it where
    a configuration is unusable or, if ``strict``, there is any error. Returns the generation.
    """
    tables = analyse(artifacts, app, **options)
    broken = violations(tables).take(5)
    if broken:
        raise ValueError(f"the analysis is inconsistent: {[tuple(r) for r in broken]}")
    nodes, edges = graph.project(tables, app, version)
    found = written(tables["diagnostics"], "diagnostics")
    generation = sinks.write_generation(nodes, edges, catalog.of_analysis(), path, app=app)
    diagnostics.judge(found, strict)
    return generation


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, id) of whatever the tables must not hold; nothing may be written while there is any."""
    artifacts, detections, keys = tables["artifacts"], tables["detections"], tables["config_keys"]

    def rule(name: str, df: DataFrame, id_: str) -> DataFrame:
        return df.select(F.lit(name).alias("rule"), F.col(id_).cast("string").alias("id"))

    files = artifacts.select("artifact_id")
    members = detections.select(F.col("chart").alias("src"), F.col("artifact_id").alias("dst"))
    found = [
        rule("artifact without identity", artifacts.where("artifact_id IS NULL"), "path"),
        rule("artifact twice", facts.duplicates(artifacts, ["artifact_id"]), "artifact_id"),
        rule("facet twice", facts.duplicates(detections, ["artifact_id"]), "artifact_id"),
        rule("facet without file", detections.join(files, "artifact_id", "left_anti"), "artifact_id"),
        rule("key twice", facts.duplicates(keys.where(~F.col("duplicate")), ["key"]), "key"),
        rule("key without file", keys.join(files, "artifact_id", "left_anti"), "key"),
        rule("key nowhere", keys.where("line < 1 OR column < 1"), "key"),
        rule("dangling member", facts.dangling(members, detections, "artifact_id"), "dst"),
        rule("call without template", tables["calls"].join(detections, "artifact_id", "left_anti"), "artifact_id"),
        rule("action nowhere", tables["actions"].where("line < 1 OR start < 0"), "artifact_id"),
        rule("diagnostic of nothing", tables["diagnostics"].where("artifact_id IS NOT NULL").join(files, "artifact_id", "left_anti"), "id"),
        rule("diagnostic twice", facts.duplicates(tables["diagnostics"], ["id"]), "id"),
    ]
    if "value_targets" in tables:
        aims = tables["value_targets"].where("key IS NOT NULL").select(F.col("artifact_id").alias("src"), F.col("key").alias("dst"))
        known = keys.select(F.col("key").alias("id")).unionByName(detections.select(F.col("artifact_id").alias("id")))
        charts = tables["charts"].select("chart")
        targets = tables["dependencies"].where("chart IS NOT NULL")
        called = tables["call_targets"].where("template IS NOT NULL")
        found += [
            rule("dangling reference", facts.dangling(aims, known), "dst"),
            rule("dependency twice", facts.duplicates(tables["dependencies"], ["dependency"]), "dependency"),
            rule("dependency on no chart", targets.join(charts, "chart", "left_anti"), "dependency"),
            rule("dependency with two targets", targets.where("package IS NOT NULL"), "dependency"),
            rule("call of no template", called.join(detections.select(F.col("artifact_id").alias("template")), "template", "left_anti"), "artifact_id"),
        ]
    return reduce(DataFrame.unionByName, found)
