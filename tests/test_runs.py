"""Whole runs: what they publish, and when they count as failures."""

import os

import pytest
from pyspark.sql import functions as F
from test_analysis import chart, item

from lodeline.operators import diagnostics
from lodeline.plans import pipeline
from lodeline.sources import sinks, workspace

AT = "can://artifact/app/"


def inventory(spark, files):
    df = spark.createDataFrame([(p, bytearray(x, "utf8"), None) for p, x in files.items()], "path string, content binary, problem string")
    return workspace.artifacts(df, "app")


FAULTY = {
    "a/Chart.yaml": chart("a", item("db") + "  - version: '1'\n  - name: cache\n"), "a/values.yaml": "x: 1\ny: [\n",
    "a/Chart.lock": "dependencies:\n  - name: db\n    version: 1.2.3\n    repository: oci://reg.io\n  - name: cache\n", "a/crds/c.yaml": "kind: Pod\n", "a/crds/d.yaml": "# nothing\n",
    "a/templates/t.yaml": "{{ if .Values.x }}\nk: 1\n", "a/templates/u.yaml": '{{ end }}{{ if 1 }}\n{{ include "n" . }}\n', "a/templates/_h.tpl": '{{ define "n" }}{{ end }}',
}


def test_a_run_is_published_before_it_is_judged(spark, tmp_path):
    with pytest.raises(diagnostics.Failed) as failed:
        pipeline.run(inventory(spark, FAULTY), "app", str(tmp_path), strict=True)
    assert failed.value.counts == {"IAC_HELM_YAML_PARSE": 1, "IAC_HELM_TEMPLATE_PARSE": 2, "IAC_HELM_INVALID_DEPENDENCY": 3, "IAC_HELM_INVALID_CRD": 2}
    shown = sinks.published(spark, str(tmp_path), verified=True)
    # What stands before the fault is there.
    assert shown["nodes"].where("array_contains(labels, 'HelmValue')").count() == 1 and shown["nodes"].where("array_contains(labels, 'IaCDiagnostic')").count() == 8
    assert shown["edges"].where("type = 'IAC_DECLARES_DEPENDENCY'").count() == 1 and shown["statements"].count() > 10
    assert all(r.properties["iac_app_id"] == "app" and r.properties.get("producer", r.properties.get("iac_producer")) == "lodeline" for r in shown["nodes"].where("NOT array_contains(labels, 'Package') AND size(labels) > 1 OR array_contains(labels, 'IaCDiagnostic')").collect())


def test_a_conflict_of_hashes_is_an_error(spark):
    artifacts = inventory(spark, {"a/Chart.yaml": chart("a"), "a/values.yaml": "x: 1\n"})
    out = pipeline.analyse(artifacts.withColumn("conflict", F.col("path") == "a/values.yaml"), "app", level=1)
    assert [(r.code, r.artifact_id) for r in out["diagnostics"].collect()] == [("IAC_ARTIFACT_HASH_CONFLICT", AT + "a/values.yaml")]


def test_an_unusable_configuration_is_a_failure_of_its_own(spark, tmp_path):
    files = {"a/Chart.yaml": chart("a"), "r.yaml": "renders:\n  - name: x\n    chart: none/Chart.yaml\n"}
    with pytest.raises(diagnostics.Failed, match="IAC_HELM_INVALID_CONFIG"):
        pipeline.run(inventory(spark, files), "app", str(tmp_path), level=1, configurations=spark.createDataFrame([(AT + "r.yaml",)], "artifact_id string"))
    assert os.path.exists(tmp_path / "manifest")


def test_locks_imports_and_resources(spark):
    crd = "kind: CustomResourceDefinition\nmetadata: {name: a.b.c}\nspec: {group: b.c, names: {kind: A, plural: as}}\n"
    files = {"a/Chart.yaml": chart("a", item("db", **{"import-values": "[data, {child: x, parent: y}]"})), "a/Chart.lock": "dependencies:\n  - {name: db, version: 1.2.3}\n", "a/crds/c.yaml": f"{crd}---\n{crd}"}
    out = pipeline.analyse(inventory(spark, files), "app", level=1)
    assert [(r.name, r.version) for r in out["locked"].collect()] == [("db", "1.2.3")] and out["custom_resources"].count() == 2 and not out["diagnostics"].take(1)
    assert [(r.item, r.name, r.child, r.parent) for r in out["import_values"].orderBy("item").collect()] == [(0, "data", None, None), (1, None, "x", "y")]
