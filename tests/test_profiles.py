"""Profiles out of configurations, whole or not at all."""

import pytest
from pyspark.sql import functions as F
from test_analysis import analysed, chart

from lodeline.operators import catalog, graph
from lodeline.plans import pipeline
from lodeline.sources import workspace

AT = "can://artifact/app/"
FILES = {
    "shop/Chart.yaml": chart("shop"), "shop/values.yaml": "a: 1\n", "shop/templates/t.yaml": "x: {{ .Values.a }}\n", "prod.yaml": "a: 2\n", "eu.yaml": "a: 3\n", "shop/extra.yaml": "a: 4\n",
    "render.yaml": "version: 1\nrenders:\n  - name: prod\n    chart: shop/Chart.yaml\n    values: [prod.yaml, shop/extra.yaml, can://artifact/app/eu.yaml]\n    set:\n      b.c: x\n      a: '9'\n    namespace: web\n    api_versions: [v1, apps/v1]\n  - name: bare\n    chart: can://artifact/app/shop/Chart.yaml\n    release_name: rel\n",
}


def run(spark, config, name="render.yaml"):
    files = FILES | {"render.yaml": config}
    df = spark.createDataFrame([(p, bytearray(x, "utf8"), None) for p, x in files.items()], "path string, content binary, problem string")
    return pipeline.analyse(workspace.artifacts(df, "app"), "app", level=1, configurations=spark.createDataFrame([(AT + name,)], "artifact_id string"))


def test_profiles_and_layers(spark):
    out = run(spark, FILES["render.yaml"])
    found = {r.name: r for r in out["profiles"].collect()}
    assert set(found) == {"prod", "bare", "default"} and not out["problems"].take(1)
    assert (found["prod"].chart, found["prod"].namespace) == (AT + "shop/Chart.yaml", "web") and found["prod"].release.startswith("shop-") and (found["bare"].release, found["bare"].namespace) == ("rel", "default")
    layers = [(r.ordinal, r.source, r.value) for r in out["layers"].orderBy("ordinal").collect()]
    config = AT + "render.yaml@key/renders.0.set."
    assert layers == [(0, AT + "prod.yaml", None), (1, AT + "shop/extra.yaml", None), (2, AT + "eu.yaml", None), (3, config + "a", "9"), (4, config + "b%252Ec", "x")]
    assert {r.layer.rpartition("/")[2] for r in out["layers"].collect()} == {f"000{i}" for i in range(5)}
    assert [r.api_version for r in out["api_versions"].orderBy("nth").collect()] == ["v1", "apps/v1"]
    # A file that a profile applies is a values file, whatever it is called.
    assert "override" in {r.path: r.roles for r in out["detections"].collect()}["shop/extra.yaml"]
    nodes, edges = graph.project(out, "app", version="1")
    n = {r.type: r["count"] for r in edges.groupBy("type").count().collect()}
    assert (n["IAC_DECLARES_PROFILE"], n["IAC_RENDERS_CHART"], n["IAC_HAS_VALUE_LAYER"], n["IAC_READS_FROM"]) == (3, 3, 5, 5)
    rules = catalog.of_analysis()
    assert [tuple(r) for r in catalog.edge_violations(edges, nodes, rules).collect()] == [] == [tuple(r) for r in catalog.node_violations(nodes, rules).collect()]
    assert [tuple(r) for r in graph.graph_violations(nodes, edges).collect()] == []


GOOD = "  - name: ok\n    chart: shop/Chart.yaml\n"
WRONG = {
    "a chart that isn't there": f"renders:\n{GOOD}  - name: x\n    chart: nope/Chart.yaml\n", "a file that is no chart": f"renders:\n{GOOD}  - name: x\n    chart: prod.yaml\n", "no chart": f"renders:\n{GOOD}  - name: x\n",
    "a values file that isn't there": f"renders:\n{GOOD}    values: [prod.yaml, ../x.yaml]\n", "no name": f"renders:\n{GOOD}  - chart: shop/Chart.yaml\n", "one name twice": f"renders:\n{GOOD}{GOOD}",
    "another version": f"version: 2\nrenders:\n{GOOD}", "a field that isn't known": f"renders:\n{GOOD}    color: red\n", "a top that isn't known": f"renders:\n{GOOD}other: 1\n", "a list for a name": "renders:\n  - name: [x]\n    chart: shop/Chart.yaml\n",
    "no list": "renders: x\n", "broken": f"renders:\n{GOOD}x: [\n", "a key twice": f"renders:\n{GOOD}    name: again\n", "too deep": f"renders:\n{GOOD}    set:\n      a: {{b: c}}\n",
}


def test_one_fault_and_nothing_is_declared(spark):
    from lodeline.functions.workers import visible
    from lodeline.operators import documents, profiles

    visible(spark)
    names = sorted(WRONG)
    files = spark.createDataFrame([(AT + str(i), WRONG[n]) for i, n in enumerate(names)] + [(AT + "good", f"renders:\n{GOOD}"), (AT + "empty", "")], "artifact_id string, source string")
    known = spark.createDataFrame([(AT + p, "ab" * 32) for p in FILES], "artifact_id string, sha256 string")
    charts = spark.createDataFrame([(AT + "shop/Chart.yaml", "shop")], "chart string, name string")
    found = profiles.configured_profiles(documents.yaml_keys(files), known, charts, "app")
    assert {r.config for r in found["profiles"].collect()} == {AT + "good"} and not found["layers"].take(1) and not found["set_keys"].take(1)
    assert {names[int(r.artifact_id.rpartition("/")[2])] for r in found["problems"].select("artifact_id").distinct().collect()} == set(names)


def test_a_bad_selector_is_a_diagnostic(spark):
    out = run(spark, f"renders:\n{GOOD}  - name: x\n    chart: nope/Chart.yaml\n")
    assert {r.name for r in out["profiles"].collect()} == {"default"}
    assert [(r.code, r.severity, r.phase) for r in out["diagnostics"].collect()] == [("IAC_HELM_INVALID_CONFIG", "error", "load")]
    with pytest.raises(ValueError, match="not in the inventory"):
        run(spark, FILES["render.yaml"], "none.yaml")


def test_without_a_configuration_every_chart_has_its_profile(spark):
    out = analysed(spark, {"a/Chart.yaml": chart("a"), "a/charts/b/Chart.yaml": chart("b")})
    assert {(r.name, r.chart, r.config == r.chart) for r in out["profiles"].collect()} == {("default", AT + "a/Chart.yaml", True), ("default", AT + "a/charts/b/Chart.yaml", True)}
    assert out["profiles"].where(F.col("release").isNull()).count() == 0
