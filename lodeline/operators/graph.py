"""The property graph: rows, checks against a catalog, and generations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import SEMANTIC, encode_segment, semantic_id
from .facts import containment, dangling, duplicates, stale

#: Relationships of the graph that an analysis makes and may take away; fixed values.
RELATIONSHIPS = (
    "IAC_DECLARES_DEPENDENCY IAC_ALIAS_OF IAC_HAS_ALIAS IAC_DEFINES_TEMPLATE IAC_HAS_TEMPLATE_CALL IAC_HAS_VALUE_REFERENCE IAC_HAS_RESOURCE_TEMPLATE IAC_HAS_LOOKUP_REFERENCE "
    "IAC_HAS_DIAGNOSTIC IAC_PART_OF_CHART IAC_TARGETS_CHART_REFERENCE IAC_RESOLVES_TO_CHART IAC_IDENTIFIED_BY_PACKAGE IAC_CALLS_TEMPLATE IAC_REFERENCES_VALUE IAC_DECLARES_PROFILE "
    "IAC_RENDERS_CHART IAC_HAS_VALUE_LAYER IAC_READS_FROM IAC_HAS_RENDER IAC_CONFIGURED_BY IAC_PRODUCES IAC_TARGETS_RESOURCE IAC_DERIVED_FROM"
).split()
#: Relationships that others make too, never taken away.
SHARED = ("HAS_ARTIFACT", "DEFINES_CONFIG")
#: Labels that an analysis adds to nodes which others know too; the others are whole nodes of its own.
FACETS = ("IaCApplication IaCArtifact HelmArtifact HelmChart HelmRequirements HelmLock HelmValues HelmValuesSchema HelmTemplate HelmCRD HelmIgnore IaCValue HelmValue IaCAlias").split()
OWN_LABELS = ("HelmDependency HelmChartReference HelmNamedTemplate HelmTemplateCall HelmValueReference HelmResourceTemplate HelmLookupReference HelmRenderProfile HelmValueLayer HelmRender IaCDiagnostic").split()
#: Beginnings of the properties that go with these facets.
PREFIXES = ("iac_", "helm_")


def edge_rows(edges: DataFrame, family: str = "family", src: str = "src", dst: str = "dst") -> DataFrame:
    """Relationships (type, src, dst), each once."""
    return edges.select(F.upper(family).alias("type"), F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()


def endpoint_violations(edges: DataFrame, nodes: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges whose ends don't bear a label that the catalog (type, src_label, dst_label) allows."""
    n = nodes.select(F.col("id"), F.col("labels"))
    df = edges.join(n.select(F.col("id").alias("src"), F.col("labels").alias("sl")), "src").join(n.select(F.col("id").alias("dst"), F.col("labels").alias("dl")), "dst")
    rules = allowed.groupBy("type").agg(F.collect_set("src_label").alias("sa"), F.collect_set("dst_label").alias("da"))
    df = df.join(rules, "type", "left")
    fits = F.coalesce(F.arrays_overlap("sl", "sa") & F.arrays_overlap("dl", "da"), F.lit(False))
    return df.where(~fits).select("type", "src", "dst")


def statement_groups(nodes: DataFrame) -> DataFrame:
    """Nodes by their set of labels: one upsert statement each."""
    return nodes.groupBy(F.array_join(F.array_sort("labels"), "_").alias("label_set")).agg(F.count("*").alias("rows"), F.min("id").alias("first_id"))


def removal_batches(removals: DataFrame, names: str = "names") -> DataFrame:
    """Removals of the same names as one batch."""
    return removals.groupBy(F.array_join(F.array_sort(names), ",").alias("names")).agg(F.count("*").alias("ids"), F.min("id").alias("first_id"))


def generation_plan(desired_nodes: DataFrame, desired_edges: DataFrame, nodes: DataFrame, edges: DataFrame, app: str, owned: str = "owned", eager: bool = True, families: tuple | list = RELATIONSHIPS) -> DataFrame:
    """(phase, action, id, src, dst) that turn the existing graph into the desired one.

    Without ``eager`` nothing is removed. With it, goes what this application owns and no longer
    wants; nodes of others, relationships outside ``families`` and those that touch none of its own
    nodes stay. Phases 3 and 4, labels and properties, are those of ``facet_removals``.
    """
    none = F.lit(None).cast("string")
    plan = desired_nodes.select(F.lit(1).alias("phase"), F.lit("upsert node").alias("action"), "id", none.alias("src"), none.alias("dst"))
    plan = plan.unionByName(desired_edges.select(F.lit(2).alias("phase"), F.lit("upsert edge").alias("action"), F.col("type").alias("id"), "src", "dst"))
    if not eager:
        return plan
    ours = nodes.where(F.col("app") == app)
    gone = stale(ours.where(F.col(owned)), desired_nodes, ["id"])
    old = stale(edges.where(F.col("type").isin(*families)), desired_edges, ["type", "src", "dst"])
    mine = ours.select("id").distinct()
    touched = old.join(mine.select(F.col("id").alias("src")), "src", "left_semi").unionByName(old.join(mine.select(F.col("id").alias("dst")), "dst", "left_semi")).distinct()
    plan = plan.unionByName(touched.select(F.lit(5).alias("phase"), F.lit("delete edge").alias("action"), F.col("type").alias("id"), "src", "dst"))
    return plan.unionByName(gone.select(F.lit(6).alias("phase"), F.lit("delete node").alias("action"), "id", none.alias("src"), none.alias("dst")))


def label_changes(existing: DataFrame, desired: DataFrame) -> DataFrame:
    """Labels of existing nodes that the desired ones no longer bear."""
    d = desired.select("id", F.col("labels").alias("__want"))
    df = existing.join(d, "id", "left").withColumn("stale", F.array_sort(F.array_except("labels", F.coalesce("__want", F.array().cast("array<string>")))))
    return df.where(F.size("stale") > 0).select("id", F.array_join("stale", ",").alias("stale"))


def facet_removals(existing: DataFrame, desired: DataFrame, app: str) -> DataFrame:
    """(phase, action, id, names): facet labels and their properties that existing nodes have and the desired ones don't.

    Both are nodes (id, labels, properties); existing ones also say their ``app``. Nodes of other
    applications and nodes that are wholly this one's (which go as a whole) are left alone, and so is
    every label and property that isn't a facet's.
    """
    want = desired.select("id", F.col("labels").alias("__labels"), F.map_keys("properties").alias("__names")).dropDuplicates(["id"])
    shared = existing.where(F.col("app") == app).where(~F.arrays_overlap("labels", F.array(*(F.lit(x) for x in OWN_LABELS)))).join(want, "id", "left")
    none = F.array().cast("array<string>")
    labels = F.array_except(F.array_intersect("labels", F.array(*(F.lit(x) for x in FACETS))), F.coalesce("__labels", none))
    ours = lambda x: F.startswith(x, F.lit(PREFIXES[0])) | F.startswith(x, F.lit(PREFIXES[1]))
    names = F.array_except(F.filter(F.map_keys("properties"), ours), F.coalesce("__names", none))
    plan = F.array(F.struct(F.lit(3).alias("phase"), F.lit("remove labels").alias("action"), F.array_sort(labels).alias("names")), F.struct(F.lit(4).alias("phase"), F.lit("remove properties").alias("action"), F.array_sort(names).alias("names")))
    return shared.select("id", F.explode(plan).alias("p")).where(F.size("p.names") > 0).select("p.phase", "p.action", "id", F.array_join("p.names", ",").alias("names"))


def unsafe(plan: DataFrame, existing: DataFrame, removals: DataFrame | None = None, families: tuple | list = RELATIONSHIPS) -> DataFrame:
    """(action, id, reason) of what a plan must not do: asked at the boundary, whoever made the plan.

    Deleted nodes must be known, with labels that are all an analysis's own; deleted relationships must
    be of its families; removed labels and properties must be facets.
    """
    own = F.array(*(F.lit(x) for x in OWN_LABELS))
    known = existing.select("id", "labels").dropDuplicates(["id"])
    nodes = plan.where("action = 'delete node'").select("action", "id").join(known, "id", "left")
    reason = F.when(F.col("labels").isNull(), "not known").when((F.size("labels") == 0) | (F.size(F.array_except("labels", own)) > 0), "labels of others")
    bad = nodes.select("action", "id", reason.alias("reason"))
    edges = plan.where("action = 'delete edge'")
    bad = bad.unionByName(edges.select("action", "id", F.when(~F.col("id").isin(*families), "family of others").alias("reason")))
    if removals is not None:
        each = removals.select("action", "id", F.explode(F.split("names", ",")).alias("name"))
        label = F.col("name").isin(*FACETS)
        facet = F.col("name").rlike(f"^({PREFIXES[0]}|{PREFIXES[1]})")
        bad = bad.unionByName(each.select("action", "id", F.when(~F.when(F.col("action") == "remove labels", label).otherwise(facet), F.concat(F.lit("not a facet: "), "name")).alias("reason")))
    return bad.where("reason IS NOT NULL")


def strongest_class(labels: Column, strength: dict[str, int]) -> Column:
    """The highest ownership class of a set of labels, 0 without one."""
    known = F.create_map(*(F.lit(x) for pair in strength.items() for x in pair))
    return F.coalesce(F.array_max(F.transform(labels, lambda x: F.coalesce(F.try_element_at(known, x), F.lit(0)))), F.lit(0))


#: Tables of template facts with their id, label, family and properties.
TEMPLATE_FACTS = (
    ("templates", "template", "HelmNamedTemplate", "iac_defines_template", ("name", "line", "empty")),
    ("calls", "call", "HelmTemplateCall", "iac_has_template_call", ("name", "kind", "line")),
    ("references", "reference", "HelmValueReference", "iac_has_value_reference", ("path", "dynamic", "line")),
    ("regions", "region", "HelmResourceTemplate", "iac_has_resource_template", ("nth", "start", "stop")),
    ("lookups", "lookup", "HelmLookupReference", "iac_has_lookup_reference", ("api", "resource", "namespace", "name", "line")),
)
#: Who stamps the nodes, and the names of the stamps on nodes of its own and beside facets.
PRODUCER = "lodeline"
OWN_STAMP, FACET_STAMP = ("producer", "analyzer_version", "iac_app_id"), ("iac_producer", "iac_analyzer_version", "iac_app_id")


def project(tables: dict[str, DataFrame], app: str, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, labels, properties) and relationships (type, src, dst) of an analysis.

    A file's facet lies on the file's own node; absent values are left out of the properties. With a
    ``version``, nodes say who made them.
    """

    def node(df: DataFrame, id_: str, labels: Column, *names: str) -> DataFrame:
        pairs = F.filter(F.array(*(F.struct(F.lit(n).alias("k"), F.col(n).cast("string").alias("v")) for n in names)), lambda p: p["v"].isNotNull() & (p["v"] != ""))
        return df.select(F.col(id_).alias("id"), labels.alias("labels"), F.map_from_entries(pairs).alias("properties"))

    def edge(df: DataFrame, family: str, src: str, dst: str) -> DataFrame:
        return df.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.lit(family).alias("family"), F.col(src).alias("src"), F.col(dst).alias("dst"))

    d, keys = tables["detections"].withColumn("role_list", F.array_join("roles", ",")), tables["config_keys"].where(~F.col("duplicate"))
    home = F.concat(F.lit(SEMANTIC), encode_segment(F.lit(app)))
    # Every file is a node, whether or not it belongs to a chart.
    every = tables["artifacts"].withColumn("application", home)
    facet = F.concat_ws("", F.transform(F.split("kind", "_"), F.initcap))
    facet = F.regexp_replace(F.regexp_replace(facet, "^HelmCrd$", "HelmCRD"), "^HelmValuesSchema$", "HelmValuesSchema")
    nodes = every.select(home.alias("id")).distinct().select("id", F.array(F.lit("Application"), F.lit("IaCApplication")).alias("labels"), F.create_map(F.lit("name"), F.lit(app)).alias("properties"))
    configs = tables["profiles"].where("config <> chart").select(F.col("config").alias("artifact_id")).distinct().withColumn("configures", F.lit(True))
    plain = every.join(d.select("artifact_id"), "artifact_id", "left_anti").join(configs, "artifact_id", "left")
    labels = F.when(F.col("configures"), F.array(F.lit("Artifact"), F.lit("IaCArtifact"))).otherwise(F.array(F.lit("Artifact")))
    nodes = nodes.unionByName(node(plain, "artifact_id", labels, "path"))
    nodes = nodes.unionByName(node(d, "artifact_id", F.array(F.lit("Artifact"), F.lit("IaCArtifact"), F.lit("HelmArtifact"), facet), "path", "kind", "role_list"))
    nodes = nodes.unionByName(node(keys, "key", F.array(F.lit("ConfigKey"), F.lit("IaCValue"), F.lit("HelmValue")), "path", "value", "kind"))
    edges = edge(every, "has_artifact", "application", "artifact_id").unionByName(edge(d.where("chart <> artifact_id"), "iac_part_of_chart", "artifact_id", "chart")).unionByName(edge(keys, "defines_config", "artifact_id", "key"))
    found = tables["diagnostics"].where("artifact_id IS NOT NULL")
    nodes = nodes.unionByName(node(found, "id", F.array(F.lit("IaCDiagnostic")), "code", "severity", "phase", "message"))
    edges = edges.unionByName(edge(found, "iac_has_diagnostic", "artifact_id", "id"))
    # What templates say: a node at its place in the file, and a relationship from the file to it.
    for table, id_, label, family, names in TEMPLATE_FACTS:
        nodes = nodes.unionByName(node(tables[table], id_, F.array(F.lit(label)), *names))
        edges = edges.unionByName(edge(tables[table], family, "artifact_id", id_))
    # A chart is known by its folder too.
    alias = semantic_id(F.lit(app), "helm", F.lit("chart"), F.col("directory"))
    named = tables["charts"].withColumn("alias", alias)
    nodes = nodes.unionByName(node(named, "alias", F.array(F.lit("IdentityAlias"), F.lit("IaCAlias")), "name"))
    edges = edges.unionByName(edge(named, "iac_alias_of", "alias", "chart")).unionByName(edge(named, "iac_has_alias", "chart", "alias"))
    # What configurations and charts declare to be rendered, and the layers of values.
    own, layers, said = tables["profiles"], tables["layers"], tables["set_keys"]
    nodes = nodes.unionByName(node(own, "profile", F.array(F.lit("HelmRenderProfile")), "name", "namespace", "release")).unionByName(node(layers, "layer", F.array(F.lit("HelmValueLayer")), "ordinal"))
    nodes = nodes.unionByName(node(said, "key", F.array(F.lit("ConfigKey")), "path"))
    edges = edges.unionByName(edge(said, "defines_config", "artifact_id", "key")).unionByName(edge(own, "iac_declares_profile", "config", "profile")).unionByName(edge(own, "iac_renders_chart", "profile", "chart"))
    edges = edges.unionByName(edge(layers, "iac_has_value_layer", "profile", "layer")).unionByName(edge(layers, "iac_reads_from", "layer", "source"))
    if "value_targets" in tables:
        edges = edges.unionByName(edge(tables["value_targets"], "iac_references_value", "reference", "key")).unionByName(edge(tables["call_targets"], "iac_calls_template", "call", "target"))
        # A dependency aims at a reference, which says what it is found to be.
        d = tables["dependencies"].withColumn("reference", semantic_id(F.lit(app), "helm", F.lit("chart-reference"), F.col("dependency")))
        nodes = nodes.unionByName(node(d, "dependency", F.array(F.lit("HelmDependency")), "name", "alias", "status")).unionByName(node(d, "reference", F.array(F.lit("HelmChartReference")), "name", "constraint", "repository"))
        for family, src, dst in (("iac_declares_dependency", "owner", "dependency"), ("iac_targets_chart_reference", "dependency", "reference"), ("iac_resolves_to_chart", "reference", "chart"), ("iac_identified_by_package", "reference", "package")):
            edges = edges.unionByName(edge(d, family, src, dst))
        packages = d.where("package IS NOT NULL").select("package").distinct()
        nodes = nodes.unionByName(node(packages, "package", F.array(F.lit("Package")), "package"))
    if version is not None:
        nodes = stamped(nodes, app, PRODUCER, version)
    return nodes, edge_rows(edges)


def existing_edges(edges: DataFrame, nodes: DataFrame, app: str) -> DataFrame:
    """Relationships with an end that belongs to the application: two semi-joins, no comparison of pairs."""
    ours = nodes.where(F.col("app") == app).select("id").distinct()
    by_src = edges.join(ours.select(F.col("id").alias("src")), "src", "left_semi").select("type", "src", "dst")
    return by_src.unionByName(edges.join(ours.select(F.col("id").alias("dst")), "dst", "left_semi").select("type", "src", "dst")).distinct()


def disallowed(nodes: DataFrame, catalog: DataFrame, labels: str = "labels", label: str = "label") -> DataFrame:
    """(id, label) of labels that the catalog doesn't know."""
    each = nodes.select("id", F.explode(F.array_distinct(labels)).alias(label))
    return each.join(catalog.select(label).distinct(), label, "left_anti").select("id", label)


def graph_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, id) of whatever the graph must not hold: nodes twice, unknown labels and families, dangling ends, files outside the application."""
    labels = [*FACETS, *OWN_LABELS, "Application", "Artifact", "ConfigKey", "IdentityAlias", "Package"]
    has = edges.where("type = 'HAS_ARTIFACT'")
    found = [
        duplicates(nodes, ["id"]).select(F.lit("node twice").alias("rule"), "id"),
        nodes.where(F.size(F.array_except("labels", F.array(*(F.lit(x) for x in labels)))) > 0).select(F.lit("unknown label").alias("rule"), "id"),
        edges.where(~F.col("type").isin(*RELATIONSHIPS, *SHARED)).select(F.lit("unknown relationship").alias("rule"), F.col("type").alias("id")),
        dangling(edges, nodes).select(F.lit("dangling relationship").alias("rule"), F.concat_ws(" ", "src", "dst").alias("id")),
        containment(nodes.where(F.array_contains("labels", "Artifact")), has, "id", "dst").select(F.lit("file outside the application").alias("rule"), "id"),
    ]
    return reduce(DataFrame.unionByName, found)


#: The label that a node is merged on, by its first facet or own label; other labels of the catalog merge on themselves.
_ELSEWHERE = {"IaCApplication": "Application", "IaCValue": "ConfigKey", "HelmValue": "ConfigKey", "IaCAlias": "IdentityAlias"}
MERGED_ON = _ELSEWHERE | {x: "Artifact" for x in FACETS if x not in _ELSEWHERE}
#: Properties that a neutral label declares: written when a node is made, never again.
NEUTRAL = {"Artifact": ("format", "id", "path", "sha256", "size_bytes", "source"), "ConfigKey": ("id", "name", "path", "span_json"), "Application": ("id",), "Package": ("id", "purl")}


def merge_label(labels: Column) -> Column:
    """The one label that all of a node's labels merge on; null where they disagree, and without labels."""
    known = F.create_map(*(F.lit(x) for pair in MERGED_ON.items() for x in pair))
    each = F.array_distinct(F.transform(labels, lambda x: F.coalesce(F.try_element_at(known, x), x)))
    return F.when(F.size(each) == 1, F.get(each, F.lit(0)))


def split_properties(nodes: DataFrame) -> DataFrame:
    """Nodes (id, labels, properties) with ``neutral`` properties, which their neutral labels declare, and ``owned`` ones, all others."""
    declared = F.create_map(*(x for label, names in NEUTRAL.items() for x in (F.lit(label), F.array(*(F.lit(n) for n in names)))))
    none = F.array().cast("array<string>")
    names = F.flatten(F.transform("labels", lambda x: F.coalesce(F.try_element_at(declared, x), none)))
    df = nodes.withColumn("__names", names)
    neutral = F.map_filter("properties", lambda k, v: F.array_contains("__names", k))
    owned = F.map_filter("properties", lambda k, v: ~F.array_contains("__names", k))
    return df.withColumn("neutral", neutral).withColumn("owned", owned).drop("__names")


def stamped(nodes: DataFrame, app: str, producer: str, version: str) -> DataFrame:
    """Nodes with who made them: plain names on nodes that are wholly an analysis's, prefixed ones beside facets, none on others."""
    facet = F.arrays_overlap("labels", F.array(*(F.lit(x) for x in FACETS)))
    whole = F.arrays_overlap("labels", F.array(*(F.lit(x) for x in OWN_LABELS)))

    def of(names: tuple[str, ...]) -> Column:
        return F.create_map(*(F.lit(x) for pair in zip(names, (producer, version, app), strict=True) for x in pair))

    stamp = F.when(whole, of(OWN_STAMP)).when(facet, of(FACET_STAMP))
    kept = F.map_filter("properties", lambda k, v: ~F.coalesce(F.map_contains_key(stamp, k), F.lit(False)))
    return nodes.withColumn("properties", F.when(stamp.isNull(), F.col("properties")).otherwise(F.map_concat(kept, stamp)))


def with_label(nodes: DataFrame, label: str) -> DataFrame:
    """(id, labels, path) of the nodes that bear a label."""
    return nodes.where(F.array_contains("labels", label)).select("id", F.array_join(F.array_sort("labels"), ",").alias("labels"), F.try_element_at("properties", F.lit("path")).alias("path"))


def dereferenced(aliases: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(alias, id, labels) of the nodes that aliases (alias) stand for."""
    to = edges.where("type = 'IAC_ALIAS_OF'").select(F.col("src").alias("alias"), F.col("dst").alias("id")).distinct()
    return aliases.select("alias").distinct().join(to, "alias").join(nodes.select("id", F.array_join(F.array_sort("labels"), ",").alias("labels")), "id").select("alias", "id", "labels")
