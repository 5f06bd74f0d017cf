"""The catalog of a graph: which labels, properties and relationships there are, and whose they are.

A catalog is a small file, compiled once on the driver; rows are checked by joins against its tables
and classified by expressions made of it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph

#: Ownership of a label by its declared properties: nobody's, a facet on others' nodes, an analysis's own.
NEUTRAL, FACET, OWN = 0, 1, 2
#: What a property's text must look like to be of a declared type.
TYPES = {"string": r"(?s).*", "integer": r"-?[0-9]+", "boolean": r"true|false", "string[]": r'(?s)\[\s*("([^"\\]|\\.)*"\s*(,\s*"([^"\\]|\\.)*"\s*)*)?\]'}


@dataclass(frozen=True)
class Catalog:
    """merge: label to the one it merges on; properties: label to names and types; ends: relationship to labels from and to."""

    merge: dict[str, str]
    properties: dict[str, dict[str, str]]
    ends: dict[str, tuple[list[str], list[str]]]
    constraints: list[str] = field(default_factory=list)

    def ownership(self, label: str) -> int:
        own = self.properties.get(label, {})
        return OWN if "producer" in own else FACET if "iac_producer" in own else NEUTRAL

    def labels(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(x, m, self.ownership(x)) for x, m in self.merge.items()], "label string, merge_label string, ownership int")

    def declared(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(x, n, t) for x, own in self.properties.items() for n, t in own.items()], "label string, property string, type string")

    def endpoints(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t, side, x) for t, ends in self.ends.items() for side, own in zip(("src", "dst"), ends, strict=True) for x in own], "type string, side string, label string")


def compiled(text: str) -> Catalog:
    """A catalog out of its file's text; raises where a label merges on none, or a relationship ends at none."""
    raw = json.loads(text)
    merge = {x["label"]: x["merge_label"] for x in raw["node_labels"]}
    properties = {x["label"]: dict(x["properties"]) for x in raw["node_labels"]}
    ends = {x["type"]: (list(x["from"]), list(x["to"])) for x in raw["relationship_types"]}
    lost = sorted({m for m in merge.values() if m not in merge} | {x for pair in ends.values() for own in pair for x in own if x not in merge})
    odd = sorted({t for own in properties.values() for t in own.values() if t not in TYPES})
    if lost or odd or len(merge) != len(raw["node_labels"]):
        raise ValueError(f"the catalog names unknown labels {lost} or types {odd}, or a label twice")
    return Catalog(merge, properties, ends, list(raw.get("constraints", [])))


def read(spark: SparkSession, path: str) -> Catalog:
    return compiled(spark.read.text(path, wholetext=True).first()[0])


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def merge_label(labels: Column, catalog: Catalog) -> Column:
    """The one label that all of a node's labels merge on; null where one is unknown, they disagree, or there is none."""
    each = F.array_distinct(F.transform(labels, lambda x: F.try_element_at(_map(catalog.merge), x)))
    return F.when(F.size(each) == 1, F.get(each, F.lit(0)))


def ownership(labels: Column, catalog: Catalog) -> Column:
    """The strongest claim that a node's labels carry."""
    known = _map({x: catalog.ownership(x) for x in catalog.merge})
    return F.coalesce(F.array_max(F.transform(labels, lambda x: F.coalesce(F.try_element_at(known, x), F.lit(NEUTRAL)))), F.lit(NEUTRAL))


def classified(nodes: DataFrame, catalog: Catalog) -> DataFrame:
    """Nodes (id, labels, properties) with merge_label, ownership, and their properties as ``neutral`` (declared by a label that is nobody's) and ``owned``."""
    names = {x: sorted(own) for x, own in catalog.properties.items() if catalog.ownership(x) == NEUTRAL}
    declared = F.create_map(*(y for x, own in names.items() for y in (F.lit(x), F.array(*map(F.lit, own)).cast("array<string>"))))
    none = F.array().cast("array<string>")
    df = nodes.withColumn("__names", F.flatten(F.transform("labels", lambda x: F.coalesce(F.try_element_at(declared, x), none))))
    neutral = F.map_filter("properties", lambda k, v: F.array_contains("__names", k))
    owned = F.map_filter("properties", lambda k, v: ~F.array_contains("__names", k))
    own = df.withColumns({"neutral": neutral, "owned": owned, "merge_label": merge_label(F.col("labels"), catalog), "ownership": ownership(F.col("labels"), catalog)})
    return own.drop("__names")


def node_violations(nodes: DataFrame, catalog: Catalog) -> DataFrame:
    """(rule, id, name) of unknown labels and properties, properties of another type than declared, and labels that don't merge.

    Labels and properties meet the catalog's tables in joins with a broadcast side, the size of a schema.
    """
    spark = nodes.sparkSession
    labels, declared = F.broadcast(catalog.labels(spark)), F.broadcast(catalog.declared(spark))
    each = nodes.select("id", F.explode(F.array_distinct("labels")).alias("label"))
    unknown = each.join(labels, "label", "left_anti").select(F.lit("unknown label").alias("rule"), "id", F.col("label").alias("name"))
    apart = nodes.where(F.coalesce(F.size(F.array_distinct(F.transform("labels", lambda x: F.coalesce(F.try_element_at(_map(catalog.merge), x), x)))), F.lit(0)) != 1)
    unmerged = apart.select(F.lit("no merge label").alias("rule"), "id", F.array_join(F.array_sort("labels"), ",").alias("name"))
    said = nodes.select("id", "labels", F.explode("properties").alias("property", "value"))
    types = declared.groupBy("property").agg(F.collect_list(F.struct("label", "type")).alias("types"))
    met = said.join(F.broadcast(types), "property", "left")
    own = F.array_distinct(F.transform(F.filter("types", lambda t: F.array_contains("labels", t["label"])), lambda t: t["type"]))
    met = met.withColumn("own", F.coalesce(own, F.array().cast("array<string>")))
    fits = reduce(lambda a, b: a | b, (F.array_contains("own", t) & F.col("value").rlike(rf"\A(?:{p})\z") for t, p in TYPES.items()))
    rule = F.when(F.size("own") == 0, "unknown property").when(~F.coalesce(fits, F.lit(False)), "wrong type")
    wrong = met.withColumn("rule", rule).where("rule IS NOT NULL").select("rule", "id", F.col("property").alias("name"))
    return unknown.unionByName(unmerged).unionByName(wrong)


def edge_violations(edges: DataFrame, nodes: DataFrame, catalog: Catalog) -> DataFrame:
    """(rule, id, name) of relationships (type, src, dst) that the catalog doesn't know, or that end at labels it doesn't allow there."""
    spark = edges.sparkSession
    ends = catalog.endpoints(spark)
    unknown = edges.join(F.broadcast(ends.select("type").distinct()), "type", "left_anti").select(F.lit("unknown relationship").alias("rule"), F.concat_ws(" ", "src", "dst").alias("id"), F.col("type").alias("name"))
    allowed = ends.groupBy("type", "side").agg(F.collect_set("label").alias("allowed"))
    both = edges.select("type", "src", "dst", F.explode(F.array(F.struct(F.lit("src").alias("side"), F.col("src").alias("end")), F.struct(F.lit("dst").alias("side"), F.col("dst").alias("end")))).alias("e")).select("type", "src", "dst", "e.*")
    met = both.join(nodes.select(F.col("id").alias("end"), "labels"), "end").join(F.broadcast(allowed), ["type", "side"])
    wrong = met.where(~F.arrays_overlap("labels", "allowed")).select(F.concat_ws(" ", F.lit("wrong"), F.when(F.col("side") == "src", "source").otherwise("target")).alias("rule"), F.concat_ws(" ", "src", "dst").alias("id"), F.col("type").alias("name"))
    return unknown.unionByName(wrong)


def unsafe_removals(removals: DataFrame, catalog: Catalog) -> DataFrame:
    """(action, id, reason) of what a plan (action, id, names) must not take away: labels that aren't facets or an analysis's own, properties outside their names."""
    own = [x for x in catalog.merge if catalog.ownership(x) != NEUTRAL]
    ours = {n for x in own for n in catalog.properties[x] if n.startswith(("iac_", "helm_"))}
    each = removals.select("action", "id", F.explode(F.split("names", ",")).alias("name"))
    good = F.when(F.col("action") == "remove labels", F.col("name").isin(*own)).otherwise(F.col("name").isin(*sorted(ours)))
    return each.where(~good).select("action", "id", F.concat(F.lit("not a facet: "), "name").alias("reason"))


#: Labels that the relationships of an analysis begin and end at; fixed values.
ENDS = {
    "HAS_ARTIFACT": (["IaCApplication"], ["Artifact"]), "DEFINES_CONFIG": (["Artifact"], ["ConfigKey"]), "IAC_PART_OF_CHART": (["HelmArtifact"], ["HelmChart"]),
    "IAC_DECLARES_DEPENDENCY": (["HelmChart"], ["HelmDependency"]), "IAC_TARGETS_CHART_REFERENCE": (["HelmDependency"], ["HelmChartReference"]),
    "IAC_RESOLVES_TO_CHART": (["HelmChartReference"], ["HelmChart"]), "IAC_IDENTIFIED_BY_PACKAGE": (["HelmChartReference"], ["Package"]),
    "IAC_DEFINES_TEMPLATE": (["HelmTemplate"], ["HelmNamedTemplate"]), "IAC_HAS_TEMPLATE_CALL": (["HelmTemplate"], ["HelmTemplateCall"]), "IAC_CALLS_TEMPLATE": (["HelmTemplateCall"], ["HelmNamedTemplate"]),
    "IAC_HAS_VALUE_REFERENCE": (["HelmTemplate"], ["HelmValueReference"]), "IAC_REFERENCES_VALUE": (["HelmValueReference"], ["HelmValue"]),
    "IAC_HAS_RESOURCE_TEMPLATE": (["HelmTemplate"], ["HelmResourceTemplate"]), "IAC_HAS_LOOKUP_REFERENCE": (["HelmTemplate"], ["HelmLookupReference"]),
    "IAC_DECLARES_PROFILE": (["IaCArtifact", "HelmChart"], ["HelmRenderProfile"]), "IAC_RENDERS_CHART": (["HelmRenderProfile"], ["HelmChart"]),
    "IAC_HAS_VALUE_LAYER": (["HelmRenderProfile"], ["HelmValueLayer"]), "IAC_READS_FROM": (["HelmValueLayer"], ["Artifact", "ConfigKey"]),
    "IAC_HAS_DIAGNOSTIC": (["Artifact"], ["IaCDiagnostic"]), "IAC_HAS_ALIAS": (["Artifact"], ["IaCAlias"]), "IAC_ALIAS_OF": (["IaCAlias"], ["Artifact"]),
}
#: What the nodes of an analysis say, by label; all else is text.
SAID = {
    "Application": ("name",), "Artifact": ("path",), "IaCArtifact": ("kind", "role_list"), "ConfigKey": ("path", "value", "kind"), "Package": ("package",), "IdentityAlias": ("name",), "IaCDiagnostic": ("code", "severity", "phase", "message"),
    "HelmDependency": ("name", "alias", "status"), "HelmChartReference": ("name", "constraint", "repository"), "HelmRenderProfile": ("name", "namespace", "release"), "HelmValueLayer": ("ordinal", "kind", "path", "value"),
} | {label: names for _, _, label, _, names in graph.TEMPLATE_FACTS}
NUMBERS, FLAGS = ("line", "nth", "start", "stop", "ordinal"), ("empty", "dynamic")


def of_analysis() -> Catalog:
    """The catalog of what ``graph.project`` makes."""
    stamps = {graph.FACET_STAMP: graph.FACETS, graph.OWN_STAMP: graph.OWN_LABELS}
    kind = lambda n: "integer" if n in NUMBERS else "boolean" if n in FLAGS else "string"
    neutral = ("Application", "Artifact", "ConfigKey", "IdentityAlias", "Package")
    labels = [*neutral, *graph.FACETS, *graph.OWN_LABELS]
    own = {x: {n: kind(n) for n in (*SAID.get(x, ()), *(n for names, those in stamps.items() if x in those for n in names))} for x in labels}
    return Catalog({x: graph.MERGED_ON.get(x, x) for x in labels}, own, ENDS, [f"CREATE CONSTRAINT {m.lower()}_id IF NOT EXISTS FOR (n:{m}) REQUIRE n.id IS UNIQUE" for m in sorted({graph.MERGED_ON.get(x, x) for x in labels})])
