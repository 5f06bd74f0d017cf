"""Keys of YAML documents: aliases, several documents, broken ones."""

import time

from lodeline.operators import documents


def keys(source):
    events, problem, attempts = documents.recovered(source)
    return [(".".join(k), v, kind, dup) for k, v, kind, *_, dup, _ in documents._keys_of(events)], problem, attempts


def test_aliases_are_leaves():
    began = time.time()
    assert keys("a: &x\n  b: *x\n") == ([("a", None, "map", False), ("a.b", None, "alias", False)], None, 1)
    nested = "a0: &a0 [1, 1]\n" + "".join(f"a{i}: &a{i} [*a{i - 1}, *a{i - 1}]\n" for i in range(1, 60))
    found, problem, _ = keys(nested)
    assert len(found) == 180 and problem is None and time.time() - began < 2
    assert keys("base: &b {x: 1}\nmine:\n  <<: *b\n  y: 2\n")[0][2:] == [("mine", None, "map", False), ("mine.<<", None, "alias", False), ("mine.y", "2", "int", False)]


def test_kinds_keys_and_documents():
    text = "a: true\nb: '1'\nc: 1.5\nd:\ne: !x y\n? [k]\n: {z: 1}\nf: {a: [1, {g: h}], a: 2}\n---\na: again\nj: k\n"
    assert keys(text)[0] == [("a", "true", "bool", False), ("b", "1", "str", False), ("c", "1.5", "float", False), ("d", "", "null", False), ("e", "y", "!x", False), ("f", None, "map", False), ("f.a", None, "seq", False), ("f.a.0", "1", "int", False),
                             ("f.a.1", None, "map", False), ("f.a.1.g", "h", "str", False), ("f.a", "2", "int", True), ("a", "again", "str", True), ("j", "k", "str", False)]


def test_a_long_broken_rest_costs_few_parses():
    source = "".join(f"before{i:04}: true\n" for i in range(400)) + "broken: [one, two\n" + "".join(f"after{i:04}: true\n" for i in range(2500))
    began = time.time()
    found, problem, attempts = keys(source)
    assert [k for k, *_ in found] == [f"before{i:04}" for i in range(400)] and problem and attempts <= 12 and time.time() - began < 1


def test_without_a_good_beginning_nothing_is_found():
    for source in ("x: [\n", "dependencies: [broken\n", "\x00", "# only a sign\nx: [\n", "a: b: c"):
        found, problem, attempts = keys(source)
        assert found == [] and problem and attempts <= 12
    assert keys("") == ([], None, 1)


def test_rows_say_how_far_a_document_is_good(spark):
    df = spark.createDataFrame([("a", "x: 1\ny: [\n"), ("b", "y: [\n"), ("c", "x: 1\n"), ("d", None)], "artifact_id string, source string")
    rows = {(r.artifact_id, r.status, r.path, r.value is None) for r in documents.yaml_keys(df).collect()}
    assert rows == {("a", "partial", None, False), ("a", "partial", "x", False), ("b", "failed", None, False), ("c", "complete", "x", False)}


def test_documents_that_define_resources(spark):
    good = "kind: CustomResourceDefinition\nmetadata: {name: a.b.c}\nspec: {group: b.c, names: {kind: A, plural: as}}\n"
    df = spark.createDataFrame([("x", f"{good}---\n{good.replace('plural: as', '')}---\nkind: Pod\n"), ("y", "")], "artifact_id string, source string")
    rows = {(r.artifact_id, r.document, r.name, r.kind, r.valid) for r in documents.custom_resources(documents.yaml_keys(df)).collect()}
    assert rows == {("x", 0, "a.b.c", "A", True), ("x", 1, "a.b.c", "A", False), ("x", 2, "", "", False)}
