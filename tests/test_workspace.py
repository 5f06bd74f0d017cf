"""Workspaces, documents inside them, and the plan over both."""

import os

import pytest
from pyspark.sql import functions as F

from lodeline.functions import identity, versions
from lodeline.operators import detection, documents, facts
from lodeline.plans import pipeline
from lodeline.sources import workspace

FILES = {
    "shop/Chart.yaml": "apiVersion: v2\nname: shop\nversion: 1.10.0\ndependencies:\n  - name: db\n    version: '>=1.0.0'\n    repository: oci://reg.example.com/charts\n  - name: cache\n    version: ^2.0.0\n    repository: oci://reg.example.com/charts\n",
    "shop/values.yaml": "image:\n  tag: v1\n  tag: v2\nliteral.key: x\nports:\n  - 80\n  - name: web\n",
    "shop/templates/d.yaml": 'a: {{ .Values.image.tag }}\nb: {{ index .Values "literal.key" }}\nc: {{ index .Values .name }}\nd: {{ include "shop.name" . }}\n{{/* .Values.none */}}\n',
    "shop/templates/_h.tpl": '{{ define "shop.name" }}x{{ end }}',
    "shop/charts/db/Chart.yaml": "apiVersion: v2\nname: db\nversion: 1.2.0\n",
    "shop/charts/db/values.yaml": "enabled: true\n",
    "shop/.helmignore": "*.md\n",
    "shop/README.md": "# shop\n",
    "other/broken.yaml": "a: [\n",
    ".git/config": "x",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("ws")
    for path, text in FILES.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_text(text)
    (top / "shop/logo.bin").write_bytes(b"\x00\xff")
    os.symlink("/etc/hosts", top / "out")
    return str(top)


def test_inventory(spark, root):
    rows = {r.path: r for r in workspace.artifacts(workspace.files(spark, root), "app").collect()}
    assert set(rows) == {p for p in FILES if not p.startswith(".git")} | {"shop/logo.bin"}
    assert rows["shop/.helmignore"].format == "text" and rows["shop/Chart.yaml"].format == "yaml"
    assert rows["shop/logo.bin"].source == "" and rows["shop/logo.bin"].problem == "not text" and len(rows["shop/logo.bin"].sha256) == 64
    assert rows["shop/Chart.yaml"].artifact_id == "can://artifact/app/shop/Chart.yaml"


def test_selections_are_one_union_and_stay_inside(root):
    assert workspace.listed(root, ["shop/charts", "shop/charts/db", "shop/values.yaml"]) == ["shop/charts/db/Chart.yaml", "shop/charts/db/values.yaml", "shop/values.yaml"]
    with pytest.raises(ValueError):
        workspace.listed(root, ["../x"])


def test_levels(spark, root):
    out = pipeline.analyse(workspace.artifacts(workspace.files(spark, root), "app"), "app", level=2)
    kinds = {r.path: (r.kind, r.roles) for r in out["detections"].collect()}
    assert kinds["shop/Chart.yaml"] == ("helm_chart", ["application"]) and kinds["shop/templates/_h.tpl"] == ("helm_template", ["helper"])
    assert "shop/README.md" not in kinds and kinds["shop/charts/db/values.yaml"] == ("helm_values", ["default"])
    keys = {(r.path, r.value, r.duplicate) for r in out["config_keys"].collect() if "charts" not in r.artifact_id}
    assert ("image.tag", "v1", False) in keys and ("image.tag", "v2", True) in keys and ("literal%2Ekey", "x", False) in keys and ("ports.1.name", "web", False) in keys
    refs = {(r.line, r.path, r.status) for r in out["value_targets"].collect()}
    assert refs == {(1, "image.tag", "resolved"), (2, "literal%2Ekey", "resolved"), (3, "[expr]", "missing")}
    targets = {r.name: (r.status, r.chart, r.package) for r in out["dependencies"].collect()}
    assert targets["db"] == ("vendored", "can://artifact/app/shop/charts/db/Chart.yaml", None)
    assert targets["cache"][0] == "package" and targets["cache"][2].startswith("pkg:oci/cache?repository_url=reg.example.com%2Fcharts%2Fcache")
    calls = {(r.name, r.template) for r in out["call_targets"].collect()}
    assert calls == {("shop.name", "can://artifact/app/shop/templates/_h.tpl")}
    first = pipeline.analyse(workspace.artifacts(workspace.files(spark, root), "app"), "app", level=1)
    assert set(first) < set(out) and first["config_keys"].count() == out["config_keys"].count()
    assert not pipeline.violations(out).take(1)


def test_broken_yaml_is_a_fact(spark):
    df = spark.createDataFrame([("a", "x: [\n"), ("b", ""), ("c", None), ("d", "k: &a 1\nm: *a\n")], "artifact_id string, source string")
    rows = documents.yaml_keys(df).collect()
    assert [r.artifact_id for r in rows if r.status == "failed"] == ["a"]
    assert {r.path for r in rows if r.artifact_id == "d"} == {"k", "m"}


def test_encoding(spark):
    df = spark.createDataFrame([("a b*~/☃",), ("",), ("x.y",)], "s string")
    rows = [tuple(r) for r in df.select(identity.encode_segment(F.col("s")), identity.encode_value_segment(F.col("s"))).collect()]
    assert rows == [("a%20b%2A~%2F%E2%98%83", "a%20b%2A~%2F%E2%98%83"), ("", ""), ("x.y", "x%2Ey")]


def test_paths_that_cannot_be_artifacts(spark):
    bad = ["", "/a", "a//b", "a/../b", "./a", "C:/x", "a\x00b"]
    df = spark.createDataFrame([(p,) for p in [*bad, "a\\b", "a/b"]], "p string")
    assert [r[0] for r in df.select(identity.is_relative_path(F.col("p"))).collect()] == [False] * len(bad) + [True, True]


def test_versions(spark):
    cases = [("1.2.3", ">=1.0.0, <2", True), ("1.2.3", "^1.3", False), ("0.2.9", "^0.2.3", True), ("0.3.0", "^0.2.3", False), ("1.2.9", "~1.2.3", True), ("1.3.0", "~1.2.3", False), ("x", "*", False), ("1.0.0", "*", True), ("v1.0", "1.0.0", True), ("1.0.0", "nope", False)]
    df = spark.createDataFrame(cases, "v string, c string, want boolean")
    assert all(r.fits == r.want for r in versions.met(df, "v", "c").collect())


def test_hooks(spark):
    df = spark.createDataFrame([("metadata:\n  name: x\n  annotations:\n    helm.sh/hook: pre\n",), ("metadata:\n  labels:\n    helm.sh/hook: pre\n",), (None,), ("spec:\n  annotations:\n    helm.sh/hook: x\n",)], "s string")
    assert [r[0] for r in df.select(detection.is_hook(F.col("s"))).collect()] == [True, False, False, False]


def test_conflicts_stop_a_union(spark):
    a, b = (spark.createDataFrame([(1, x)], "k int, v string") for x in "ab")
    with pytest.raises(ValueError):
        facts.conflict_checked_union([a, b], ["k"])
    assert facts.conflict_checked_union([a, a], ["k"]).count() == 1


def test_graph_inventory_states(spark):
    rows = [("can://artifact/app/a.yaml", "a.yaml", "x: 1", True), ("can://artifact/app/b.yaml", "b.yaml", None, True), ("can://artifact/app/c.yaml", "c.yaml", "x", False), ("can://artifact/app/z.yaml", "d.yaml", "x", True), ("can://artifact/other/a", "a", "x", True)]
    df = spark.createDataFrame(rows, "id string, path string, source string, same boolean").withColumn("sha256", F.when(F.col("same"), F.sha2("source", 256)).otherwise("no"))
    assert {r.path: r.state for r in workspace.from_graph(df, "app").collect()} == {"a.yaml": "ok", "b.yaml": "missing", "c.yaml": "changed", "d.yaml": "foreign"}


def test_graph_and_script(spark, root, tmp_path):
    from lodeline.operators import graph
    from lodeline.sources import sinks

    out = pipeline.analyse(workspace.artifacts(workspace.files(spark, root), "app"), "app", level=2)
    nodes, edges = graph.project(out, "app")
    nodes, edges = nodes.cache(), edges.cache()
    assert not facts.dangling(edges, nodes).take(1) and not facts.duplicates(nodes, ["id"]).take(1)
    assert {r[0] for r in edges.select("type").distinct().collect()} == {"HAS_ARTIFACT", "IAC_PART_OF_CHART", "DEFINES_CONFIG", "IAC_REFERENCES_VALUE", "IAC_RESOLVES_TO_CHART", "IAC_IDENTIFIED_BY_PACKAGE", "IAC_DECLARES_DEPENDENCY", "IAC_HAS_DIAGNOSTIC"} | {
        "IAC_TARGETS_CHART_REFERENCE", "IAC_HAS_VALUE_REFERENCE", "IAC_ALIAS_OF", "IAC_HAS_ALIAS", "IAC_DEFINES_TEMPLATE", "IAC_HAS_TEMPLATE_CALL", "IAC_CALLS_TEMPLATE", "IAC_HAS_RESOURCE_TEMPLATE", "IAC_DECLARES_PROFILE", "IAC_RENDERS_CHART"}
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "g/script")).collect()]
    assert len(lines) == nodes.count() + edges.count() and spark.read.parquet(str(tmp_path / "g/edges")).count() == edges.count()


def test_literals(spark):
    df = spark.createDataFrame([("a'b\\c\nd\te",)], "s string")
    from lodeline.sources import sinks

    assert df.select(sinks.literal(F.col("s"))).first()[0] == "'a\\'b\\\\c\\nd\\te'"
