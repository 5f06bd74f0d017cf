"""Queries that take whole tables, and rules of the analysis that need whole files."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_forest_has_every_customer(spark):
    keys = {r[0] for r in duckdb.sql(f"SELECT c_custkey FROM '{DATA}/customer.parquet'").fetchall()}

    def place(k):
        depth = 0
        while k // 8 in keys and k // 8 != k:
            k, depth = k // 8, depth + 1
        return k, depth

    want = sorted((place(k)[0], k, place(k)[1]) for k in keys)
    assert sorted(map(tuple, entry.queries()["ownership_forest"](spark, DATA).collect())) == want and len(want) == len(keys)


def test_walk_takes_more_rows_than_a_million(spark):
    from lodeline.operators import ownership

    edges = spark.range(1, 1_100_000).selectExpr("0L AS parent", "id AS child")
    assert ownership.walk(edges, spark.createDataFrame([(0,)], "root long")).count() == 1_100_000


def test_whole_texts_in_identities_and_statements(spark, tmp_path):
    head = "the same twelve and forty characters of a text"
    rows = [(1, f"{head} a'\\\n\r\t", "s/1", "en"), (2, f"{head} b", "s/1", "en"), (3, None, "s/1", "en"), (4, "", "s/1", "en"), (5, "a/b\\c", "s/1", "en"), (6, f"{head} b", "s/1", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in entry.queries()["whole_text_identities"](spark, str(tmp_path)).collect()}
    assert len(found) == 6 and len({r.artifact for r in found.values()}) == 6 and len({r.semantic for r in found.values()}) == 5
    assert found[2].semantic == found[6].semantic and found[3].semantic == "can://iac/corpus/text/s%2F1/none" and found[1].artifact.startswith("can://artifact/corpus/s%2F1/en/1-")
    said = {r.id: r.statement for r in entry.queries()["whole_text_upserts"](spark, str(tmp_path)).collect()}
    assert said["d2"].endswith(f"n += {{`text`: '{head} b'}};") and said["d3"].endswith("n += {};") and said["d4"].endswith("n += {`text`: ''};")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("whole_text_identities", "whole_text_upserts"):
        df = entry.queries()[name](spark, str(tmp_path))
        other = db.execute(entry.oracle_sql()[name])
        at = [[x[0] for x in other.description].index(x) for x in df.columns]
        assert sorted(str(tuple(r)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in other.fetchall())


def test_empty_definitions(spark):
    from lodeline.operators import documents

    source = (
        '{{ define "a" }}x{{ end }}{{ define "b" }} \n{{/* c */}}{{- /* d */ -}} {{ end }}text{{define "c"}}{{ if .x }}{{ end }}{{ end }}'
        '{{ define "d" }} {{ define "e" }}x{{ end }} {{ end }}{{ define "f" }}{{ block "g" . }} {{ end }}{{ end }}{{ define "h" }}{{ .x }}{{ end }}{{- define "i" -}}{{- end -}}'
        '{{ define "j" }}{{ define "k" }}{{ end }}y{{ end }}{{ define "l" }}{{ with .x }} {{ define "m" }}{{ end }}{{ else }}{{ end }}{{ end }}'
    )
    df = spark.createDataFrame([("t", source), ("u", "no actions"), ("v", None)], "artifact_id string, source string")
    found = {r.name: r.empty for r in documents.named_templates(documents.template_actions(df)).collect()}
    assert sorted(n for n, empty in found.items() if empty) == ["b", "d", "g", "i", "k", "m"] and len(found) == 13


def analysed(spark, files):
    from lodeline.plans import pipeline

    df = spark.createDataFrame(list(files.items()), "path string, source string")
    df = df.withColumn("artifact_id", F.concat(F.lit("can://artifact/app/"), "path"))
    return pipeline.analyse(df, "app", level=2)


def test_an_empty_override_does_not_win(spark):
    files = {
        "shop/Chart.yaml": "apiVersion: v2\nname: shop\nversion: 1.0.0\n",
        "shop/templates/a.tpl": '{{ define "n" }}x{{ end }}{{ define "m" }}{{ end }}',
        "shop/templates/z.tpl": '{{ define "n" }} {{/* empty */}} {{ end }}{{ define "m" }}y{{ end }}',
        "shop/templates/d.yaml": 'a: {{ include "n" . }}{{ include "m" . }}\n',
    }
    at = "can://artifact/app/shop/templates/"
    assert {r.name: r.template for r in analysed(spark, files)["call_targets"].collect()} == {"n": f"{at}a.tpl", "m": f"{at}z.tpl"}


def test_requirements_of_v1_charts(spark):
    def item(name):
        return f"dependencies:\n  - name: {name}\n    version: '>=1.0.0'\n    repository: oci://reg.example.com/charts\n"

    files = {
        "old/Chart.yaml": "apiVersion: v1\nname: old\nversion: 1.0.0\n",
        "old/requirements.yaml": item("db") + item("cache").partition("\n")[2],
        "old/charts/db/Chart.yaml": "apiVersion: v1\nname: db\nversion: 1.2.0\n",
        "new/Chart.yaml": "apiVersion: v2\nname: new\nversion: 1.0.0\n" + item("queue"),
        "new/requirements.yaml": item("never"),
    }
    at = "can://artifact/app/"
    found = {r.dependency: (r.owner, r.name, r.status, r.chart) for r in analysed(spark, files)["dependencies"].collect()}
    assert found == {
        f"{at}old/requirements.yaml#0": (f"{at}old/Chart.yaml", "db", "vendored", f"{at}old/charts/db/Chart.yaml"),
        f"{at}old/requirements.yaml#1": (f"{at}old/Chart.yaml", "cache", "package", None),
        f"{at}new/Chart.yaml#0": (f"{at}new/Chart.yaml", "queue", "package", None),
    }


def test_groups_are_not_gathered(spark, tmp_path):
    import hashlib

    rows = [(k, t // 2, "user", None if t == 5 else f"text {t % 3} {k}") for k in (1, 2, None) for t in range(40)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    found = {r.conv_id: r.input_hash for r in entry.queries()["input_hashes"](spark, str(tmp_path)).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {k: sha(",".join(f"{t}@{sha(x)}" for i, t, _, x in sorted((r for r in rows if r[0] == k and r[3] is not None), key=lambda r: (r[1], r[3])))) for k in (1, 2, None)}
    assert found == want
    for name, at in (("input_hashes", str(tmp_path)), ("normalised_roles", DATA), ("node_allowlist", DATA)):
        assert "collect_list" not in entry.queries()[name](spark, at)._jdf.queryExecution().toString()
