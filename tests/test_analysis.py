"""Enablement, diagnostics, the whole graph and safe generations."""

import pytest
from pyspark.sql import functions as F

from lodeline.operators import diagnostics, enablement, facts, graph
from lodeline.plans import pipeline
from lodeline.sources import sinks, workspace

AT = "can://artifact/app/"


def analysed(spark, files):
    df = spark.createDataFrame([(p, bytearray(x, "utf8"), None) for p, x in files.items()], "path string, content binary, problem string")
    return pipeline.analyse(workspace.artifacts(df, "app"), "app", level=2)


def chart(name, dependencies="", api="v2"):
    return f"apiVersion: {api}\nname: {name}\nversion: 1.0.0\n" + (f"dependencies:\n{dependencies}" if dependencies else "")


def item(name, **fields):
    return f"  - name: {name}\n    version: '*'\n" + "".join(f"    {k}: {v}\n" for k, v in fields.items())


def test_conditions_tags_and_aliases(spark):
    dependencies = [("d1", "root", "c1", "one", None, "one.enabled,two.enabled", None), ("d2", "root", "c2", "two", None, None, ["front"]), ("d3", "root", "c3", "three", "alias", "alias.enabled", None),
                    ("d4", "c3", "c4", "four", None, "four.enabled", None), ("d5", "root", "c5", "five", None, None, ["back", "front"]), ("d6", "root", "c6", "six", None, "none.enabled", ["back"])]
    df = spark.createDataFrame(dependencies, "dependency string, owner string, chart string, name string, alias string, condition string, tags array<string>").withColumn("candidate_charts", F.array("chart"))
    children = spark.createDataFrame([("root", f"c{i}", n, False) for i, n in enumerate(("zero", "one", "two", "three", "four", "five", "six"))] + [("c3", "c7", "seven", False)], "parent string, child string, child_name string, hidden boolean")
    values = spark.createDataFrame([("root", "two.enabled", False), ("root", "tags.front", False), ("root", "tags.back", True), ("root", "alias.four.enabled", False), ("c3", "four.enabled", True)], "chart string, path string, value boolean")
    roots = spark.createDataFrame([("root",)], "root string")

    def found(values):
        return {(r.chart, "/".join(r.names)) for r in enablement.trees(enablement.links(children, df), roots, df, values).collect()}

    # The condition one.enabled isn't found, two.enabled is; tags vote; the root's value speaks before the owner's.
    vendored = {("root", ""), ("c0", "zero"), ("c4", "four")}
    assert found(values) == vendored | {("c3", "alias"), ("c7", "alias/seven"), ("c5", "five"), ("c6", "six")}
    off = spark.createDataFrame([("root", "alias.enabled", False)], "chart string, path string, value boolean")
    assert found(off) == vendored | {("c1", "one"), ("c2", "two"), ("c5", "five"), ("c6", "six")}


def test_what_disabled_charts_define_does_not_win(spark):
    files = {
        "shop/Chart.yaml": chart("shop", item("db", condition="db.enabled") + item("web")),
        "shop/values.yaml": "db:\n  enabled: false\n",
        "shop/templates/d.yaml": 'a: {{ include "db.name" . }}{{ include "web.name" . }}\n',
        "shop/charts/db/Chart.yaml": chart("db"),
        "shop/charts/db/templates/_h.tpl": '{{ define "db.name" }}x{{ end }}',
        "shop/charts/web/Chart.yaml": chart("web") + "type: library\n",
        "shop/charts/web/templates/_h.tpl": '{{ define "web.name" }}x{{ end }}',
        "shop/charts/web/templates/h.yaml": '{{ define "web.name" }}y{{ end }}',
    }
    out = analysed(spark, files)
    assert {r.name: r.template for r in out["call_targets"].collect()} == {"db.name": None, "web.name": f"{AT}shop/charts/web/templates/_h.tpl"}
    assert not pipeline.violations(out).take(1)


FAULTY = {
    "a/Chart.yaml": chart("a", item("x") + item("y")),
    "a/charts/x1/Chart.yaml": chart("x"),
    "a/charts/x2/Chart.yaml": chart("x"),
    "a/charts/y/Chart.yaml": "apiVersion: v2\nname: z\nversion: 1.0.0\n",
    "a/values.yaml": "k: 1\nk: 2\n",
    "a/templates/t.yaml": '{{ define "n" }}x{{ end }}{{ define "n" }}y{{ end }}{{ .Values.k }}',
    "b/Chart.yaml": chart("b", api="v7"),
    "c/Chart.yaml": "apiVersion: v2\nname: c\n",
    "d/Chart.yaml": chart("d"),
    "d/values.yaml": "a: [\n",
    "logo.bin": "\x00",
    "docs/readme.md": "text",
}


def test_diagnostics_and_the_whole_graph(spark, tmp_path):
    out = analysed(spark, FAULTY)
    rows = {(r.code, r.severity, (r.artifact_id or "").removeprefix(AT)) for r in out["diagnostics"].collect()}
    assert rows == {
        ("IAC_SOURCE_NOT_TEXT", "warning", "logo.bin"), ("IAC_HELM_UNSUPPORTED_API_VERSION", "error", "b/Chart.yaml"), ("IAC_HELM_INVALID_CHART", "error", "c/Chart.yaml"),
        ("IAC_HELM_YAML_PARSE", "error", "d/values.yaml"), ("IAC_HELM_DUPLICATE_VALUE_PATH", "error", "a/values.yaml"), ("IAC_HELM_DUPLICATE_TEMPLATE_DEFINITION", "error", "a/templates/t.yaml"),
        ("IAC_HELM_AMBIGUOUS_VENDORED_DEPENDENCY", "warning", "a/Chart.yaml"), ("IAC_HELM_INCOMPATIBLE_VENDORED_DEPENDENCY", "warning", "a/Chart.yaml"),
    }
    assert {r.n for r in diagnostics.by_code(out["diagnostics"]).collect()} == {1}
    assert [tuple(r) for r in pipeline.violations(out).collect()] == []
    nodes, edges = graph.project(out, "app")
    nodes, edges = nodes.cache(), edges.cache()
    labels = {r.id.removeprefix(AT): set(r.labels) for r in nodes.collect()}
    assert labels["can://iac/app"] == {"Application", "IaCApplication"} and labels["docs/readme.md"] == {"Artifact"} == labels["logo.bin"]
    assert labels["a/values.yaml"] == {"Artifact", "IaCArtifact", "HelmArtifact", "HelmValues"} and set(FAULTY) <= set(labels)
    assert edges.where("type = 'HAS_ARTIFACT'").count() == len(FAULTY) and not graph.graph_violations(nodes, edges).take(1)
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    assert spark.read.text(str(tmp_path / "g/script")).count() == nodes.count() + edges.count()
    with pytest.raises(ValueError):
        sinks.write_graph(nodes, edges.unionByName(spark.createDataFrame([("IAC_PRODUCES", "x", "y")], "type string, src string, dst string")), str(tmp_path / "h"))
    assert not (tmp_path / "h").exists()


NODE = "id string, labels array<string>, properties map<string,string>"


def test_only_own_stale_facts_go(spark):
    desired = spark.createDataFrame([("chart", ["Artifact", "IaCArtifact", "HelmChart"], {"path": "p", "iac_kind": "k", "helm_name": "n"})], NODE)
    existing = spark.createDataFrame([
        ("chart", ["Artifact", "IaCArtifact", "HelmChart"], {"path": "p", "iac_kind": "k", "helm_name": "n", "helm_deprecated": "true", "other_x": "y"}, "ours", False),
        ("module", ["Artifact", "IaCArtifact", "HelmValues", "TSModule"], {"path": "p", "iac_kind": "k", "helm_roles": "r", "ts_x": "y"}, "ours", False),
        ("render", ["HelmRender"], {"iac_app_id": "ours"}, "ours", True),
        ("foreign", ["HelmValues"], {"iac_kind": "k"}, "theirs", True),
    ], f"{NODE}, app string, owned boolean")
    edge = "type string, src string, dst string"
    edges = spark.createDataFrame([("IAC_HAS_RENDER", "chart", "render"), ("HAS_ARTIFACT", "app", "module"), ("CALLS", "foreign", "chart"), ("IAC_PRODUCES", "foreign", "foreign")], edge)
    plan = graph.generation_plan(desired.select("id"), edges.limit(0), existing, edges, "ours")
    assert {(r.action, r.id, r.src) for r in plan.where("phase > 2").collect()} == {("delete edge", "IAC_HAS_RENDER", "chart"), ("delete node", "render", None)}
    removals = graph.facet_removals(existing, desired, "ours")
    assert {(r.phase, r.id, r.names) for r in removals.collect()} == {(3, "module", "HelmValues,IaCArtifact"), (4, "module", "helm_roles,iac_kind"), (4, "chart", "helm_deprecated")}
    assert not graph.unsafe(plan, existing, removals).take(1)
    bad = spark.createDataFrame([("delete node", "module"), ("delete node", "nobody"), ("delete edge", "CALLS")], "action string, id string")
    names = spark.createDataFrame([("remove labels", "module", "HelmValues,Artifact"), ("remove properties", "module", "ts_x")], "action string, id string, names string")
    assert sorted(r.reason for r in graph.unsafe(bad, existing, names).collect()) == ["family of others", "labels of others", "not a facet: Artifact", "not a facet: ts_x", "not known"]


def test_names_and_controls_in_statements(spark):
    nodes = spark.createDataFrame([("a\x01'", ["A b", "C"], {"x`y": "\x7f"})], NODE)
    said = sinks.statements(nodes, spark.createDataFrame([("T-1", "a", "b")], "type string, src string, dst string")).collect()
    assert said[0].statement == "MERGE (n {id: 'a\\u0001\\''}) SET n:`A b`:C, n += {`x``y`: '\\u007F'};" and "[:`T-1`]" in said[1].statement


def test_deep_trees(spark):
    from lodeline.operators import ownership

    edges = spark.range(120).selectExpr("id AS parent", "id + 1 AS child")
    assert ownership.walk(edges, spark.createDataFrame([(0,)], "root long")).count() == 121
    assert not facts.duplicates(edges, ["parent"]).take(1)


def test_stamps_and_default_profiles(spark):
    from lodeline.operators import layers

    nodes = spark.createDataFrame([("f", ["Artifact", "HelmChart"], {"path": "p", "iac_producer": "old"}), ("w", ["HelmRender"], {"x": "y"}), ("a", ["Artifact"], {"path": "q"})], NODE)
    found = {r.id: r.properties for r in graph.stamped(nodes, "app", "lodeline", "1").collect()}
    assert found["f"] == {"path": "p", "iac_producer": "lodeline", "iac_analyzer_version": "1", "iac_app_id": "app"}
    assert found["w"] == {"x": "y", "producer": "lodeline", "analyzer_version": "1", "iac_app_id": "app"} and found["a"] == {"path": "q"}
    rows = layers.default_profiles(spark.createDataFrame([("c1",), ("c1",), ("c2",)], "chart string"), "app").collect()
    assert sorted((r.chart, r.profile, r.name) for r in rows) == [(x, f"can://iac/app/default-profile/{x}", "default") for x in ("c1", "c2")]


def test_layers_over_trees(spark):
    from lodeline.operators import layers

    rows = [("p", 0, "a.b", "1"), ("p", 0, "a.c", "2"), ("p", 1, "a.b", "3"), ("p", 2, "k", "4"), ("p", 3, "k.m", "5"), ("p", 0, "z.y.x", "6"), ("p", 4, "z", "7"), ("q", 9, "a", "8")]
    found = layers.layered_values(spark.createDataFrame(rows, "profile string, ordinal int, path string, value string")).collect()
    assert {tuple(r) for r in found} == {("p", "a.b", "3"), ("p", "a.c", "2"), ("p", "k.m", "5"), ("p", "z", "7"), ("q", "a", "8")}
