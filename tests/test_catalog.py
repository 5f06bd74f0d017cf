"""Catalogs, grouped statements, and publication by one rename."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from lodeline.operators import catalog
from lodeline.sources import sinks

TEXT = json.dumps({
    "node_labels": [
        {"label": "File", "merge_label": "File", "properties": {"id": "string", "path": "string", "size": "integer"}},
        {"label": "Chart", "merge_label": "File", "properties": {"id": "string", "iac_producer": "string", "helm_roles": "string[]", "helm_old": "boolean"}},
        {"label": "Note", "merge_label": "Note", "properties": {"id": "string", "producer": "string", "size": "integer"}},
    ],
    "relationship_types": [{"type": "IAC_NOTES", "from": ["Chart"], "to": ["Note"]}],
    "constraints": ["CREATE CONSTRAINT file_id IF NOT EXISTS FOR (n:File) REQUIRE n.id IS UNIQUE"],
})
NODE = "id string, labels array<string>, properties map<string,string>"


@pytest.fixture(scope="module")
def rules(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("catalog") / "schema.json"
    path.write_text(TEXT)
    return catalog.read(spark, str(path))


def test_a_catalog_is_checked_when_it_is_compiled(rules):
    assert [rules.ownership(x) for x in ("File", "Chart", "Note", "none")] == [0, 1, 2, 0] and len(rules.constraints) == 1
    for old, new in (('"Note", "merge_label": "Note"', '"Note", "merge_label": "No"'), ('"to": ["Note"]', '"to": ["X"]'), ('"boolean"', '"float"'), ('"label": "Note"', '"label": "File"')):
        with pytest.raises(ValueError):
            catalog.compiled(TEXT.replace(old, new))


def test_rows_that_the_catalog_does_not_allow(spark, rules):
    good = {"path": "a\nb", "size": "12", "iac_producer": "x", "helm_roles": '["a", "b\\"c"]', "helm_old": "true"}
    nodes = [("ok", ["File", "Chart"], good), ("bare", ["File"], {}), ("label", ["File", "Odd"], {}), ("none", [], {}), ("null", None, None), ("two", ["File", "Note"], {}), ("property", ["File"], {"helm_old": "true"}),
             ("type", ["File", "Chart"], {"size": "1.5", "helm_old": "yes", "helm_roles": "[1]"}), ("own", ["Note"], {"size": "-3", "producer": ""})]
    df = spark.createDataFrame(nodes, NODE)
    found = {(r.rule, r.id, r.name or "") for r in catalog.node_violations(df, rules).collect()}
    assert found == {("unknown label", "label", "Odd"), ("no merge label", "label", "File,Odd"), ("no merge label", "none", ""), ("no merge label", "null", ""), ("no merge label", "two", "File,Note"), ("unknown property", "property", "helm_old"),
                     ("wrong type", "type", "size"), ("wrong type", "type", "helm_old"), ("wrong type", "type", "helm_roles")}
    edges = spark.createDataFrame([("IAC_NOTES", "ok", "own"), ("IAC_NOTES", "bare", "own"), ("IAC_NOTES", "ok", "ok"), ("OTHER", "ok", "own")], "type string, src string, dst string")
    assert {tuple(r) for r in catalog.edge_violations(edges, df, rules).collect()} == {("wrong source", "bare own", "IAC_NOTES"), ("wrong target", "ok ok", "IAC_NOTES"), ("unknown relationship", "ok own", "OTHER")}
    kinds = {r.id: (r.merge_label, r.ownership, r.neutral, r.owned) for r in catalog.classified(df.where("id IN ('ok', 'two', 'own')"), rules).collect()}
    assert kinds["ok"][:2] == ("File", 1) and set(kinds["ok"][2]) == {"path", "size"} and set(kinds["ok"][3]) == {"iac_producer", "helm_roles", "helm_old"}
    assert kinds["two"][:2] == (None, 2) and kinds["own"][:2] == ("Note", 2) and set(kinds["own"][3]) == {"size", "producer"}


def graph(spark, n):
    nodes = spark.range(n).select(F.concat(F.lit("n'"), F.col("id")).alias("id"), F.array(F.lit("File"), F.lit("Chart")).alias("labels"), F.create_map(F.lit("path"), F.concat(F.lit("p"), "id"), F.lit("size"), F.col("id").cast("string"), F.lit("helm_roles"), F.lit('["r"]')).alias("properties"))
    nodes = nodes.unionByName(spark.createDataFrame([("note", ["Note"], {"producer": "me"})], NODE))
    return nodes, nodes.where("id <> 'note'").select(F.lit("IAC_NOTES").alias("type"), F.col("id").alias("src"), F.lit("note").alias("dst"))


def test_a_hot_set_of_labels_is_split(spark, rules):
    nodes, edges = graph(spark, 3000)
    rows = sinks.grouped_statements(nodes, edges, rules, most=20_000).collect()
    own = [r for r in rows if r.phase == 1 and ":File" in r.statement]
    assert len(own) > 8 and all(len(r.statement) < 21_000 for r in rows) and sum(r.n for r in own) == 3000
    ids = [x for r in own for x in re.findall(r"\{id: '((?:[^'\\]|\\.)*)', neutral", r.statement)]
    assert sorted(ids) == sorted(f"n\\'{i}" for i in range(3000))
    assert all(r.statement.endswith("] AS row MERGE (n:File {id: row.id}) ON CREATE SET n += row.neutral SET n:Chart SET n += row.owned;") for r in own)
    assert any("{id: 'n\\'7', neutral: {path: 'p7', size: 7}, owned: {helm_roles: ['r']}}" in r.statement for r in own)
    links = [r for r in rows if r.phase == 2]
    assert sum(r.n for r in links) == 3000 and {r.statement.split("] AS row ")[1] for r in links} == {"MATCH (s:File {id: row.src}) MATCH (t:Note {id: row.dst}) MERGE (s)-[:IAC_NOTES]->(t);"}


def test_later_phases(spark, rules):
    nodes, edges = graph(spark, 2)
    plan = spark.createDataFrame([("delete edge", "IAC_NOTES", "a", "b"), ("delete node", "note", None, None)], "action string, id string, src string, dst string")
    removals = spark.createDataFrame([(3, "remove labels", "x", "Chart"), (3, "remove labels", "y", "Chart"), (4, "remove properties", "x", "helm_old,iac_producer")], "phase int, action string, id string, names string")
    rows = sinks.grouped_statements(nodes.limit(0), edges.limit(0), rules, plan, removals, "it's").collect()
    got = {}
    for r in rows:
        got.setdefault((r.phase, r.statement.split("] AS ")[1]), []).extend(re.findall(r"\{.*?\}|'\w+'", r.statement.split("] AS ")[0]))
    assert {k: sorted(v) for k, v in got.items()} == {
        (3, "id MATCH (n {id: id}) REMOVE n:Chart;"): ["'x'", "'y'"], (4, "id MATCH (n {id: id}) REMOVE n.helm_old, n.iac_producer;"): ["'x'"],
        (5, "row MATCH (s {id: row.src})-[r:IAC_NOTES]->(t {id: row.dst}) DELETE r;"): ["{src: 'a', dst: 'b'}"], (6, "id MATCH (n {id: id}) WHERE n.producer = 'lodeline' AND n.iac_app_id = 'it\\'s' DETACH DELETE n;"): ["'note'"],
    }


def test_a_generation_shows_at_once_or_not_at_all(spark, tmp_path):
    path = str(tmp_path)
    one, two = spark.range(5).toDF("x"), spark.range(3).toDF("y")
    first = sinks.publish({"one": one, "two": two}, path)
    assert {k: v.count() for k, v in sinks.published(spark, path, verified=True).items()} == {"one": 5, "two": 3}
    broken = spark.range(2).select(F.raise_error(F.lit("gone")).cast("string").alias("z"))
    with pytest.raises(Exception, match="gone"):
        sinks.publish({"one": one.limit(1), "two": broken}, path)
    assert {k: v.count() for k, v in sinks.published(spark, path, verified=True).items()} == {"one": 5, "two": 3}
    assert sinks.publish({"one": one.limit(2)}, path) != first
    assert {k: v.count() for k, v in sinks.published(spark, path).items()} == {"one": 2}
    folder = os.path.join(path, first, "one")
    assert os.path.isdir(folder)
    now = sinks.published(spark, path)["one"].inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    spark.range(9).toDF("x").write.mode("append").parquet(now)
    with pytest.raises(ValueError, match="changed"):
        sinks.published(spark, path, verified=True)


def test_nothing_is_written_that_is_not_allowed(spark, tmp_path):
    raw = json.loads(TEXT)
    raw["node_labels"] = [{"label": x, "merge_label": "Artifact", "properties": {"id": "string", "iac_producer": "string"}} for x in ("Artifact", "HelmChart")] + [{"label": "IaCDiagnostic", "merge_label": "IaCDiagnostic", "properties": {"producer": "string"}}]
    raw["relationship_types"] = [{"type": "HAS_ARTIFACT", "from": ["Artifact"], "to": ["Artifact"]}, {"type": "IAC_HAS_DIAGNOSTIC", "from": ["Artifact"], "to": ["IaCDiagnostic"]}]
    rules = catalog.compiled(json.dumps(raw))
    nodes = spark.createDataFrame([("d", ["IaCDiagnostic"], {"producer": "me"})], NODE)
    edges = spark.createDataFrame([], "type string, src string, dst string")
    existing = spark.createDataFrame([("theirs", ["Service"]), ("ours", ["IaCDiagnostic"])], "id string, labels array<string>")
    plan = spark.createDataFrame([("delete node", "ours", None, None)], "action string, id string, src string, dst string")
    foreign = plan.unionByName(spark.createDataFrame([("delete node", "theirs", None, None)], plan.schema))
    removals = spark.createDataFrame([(3, "remove labels", "x", "Service")], "phase int, action string, id string, names string")
    for bad in ({"plan": foreign, "existing": existing}, {"plan": plan}, {"removals": removals}):
        with pytest.raises(ValueError):
            sinks.write_generation(nodes, edges, rules, str(tmp_path), **bad)
    with pytest.raises(ValueError, match="unknown property"):
        sinks.write_generation(nodes.withColumn("properties", F.create_map(F.lit("odd"), F.lit("x"))), edges, rules, str(tmp_path))
    assert not os.listdir(tmp_path)
    sinks.write_generation(nodes, edges, rules, str(tmp_path), plan=plan, existing=existing)
    assert sorted(r.phase for r in sinks.published(spark, str(tmp_path), verified=True)["statements"].collect()) == [1, 6]
