"""Tables of cases for single rules: versions, hooks, value paths, templates, ordinals, encodings."""

import time

import pytest
from pyspark.sql import functions as F

from lodeline.functions import identity, values, versions
from lodeline.operators import detection, documents, facts, precedence, resolution

VERSIONS = """
1.2.3 | >=1.0.0, <2 | y
1.2.3 | ^1.3 | n
0.2.9 | ^0.2.3 | y
0.3.0 | ^0.2.3 | n
1.2.9 | ~1.2.3 | y
1.3.0 | ~1.2.3 | n
1.9.0 | ~1 | y
2.0.0 | ~1 | n
0.9.0 | ^0 | y
1.0.0 | ^0 | n
0.0.9 | ^0.0 | y
0.1.0 | ^0.0 | n
0.0.4 | ^0.0.3 | n
1.7.2 | 1 | y
2.0.0 | 1 | n
1.2.7 | 1.2 | y
1.2.7 | 1.2.x | y
1.3.0 | 1.2.* | n
5.0.0 | * | y
5.0.0 | x | y
5.0.0-rc1 | * | n
1.5.0 | 1.2 - 1.4.5 | n
1.4.5 | 1.2 - 1.4.5 | y
1.4.9 | 1.2 - 1.4 | y
3.1.0 | ^1 || ^3 | y
2.1.0 | ^1 || ^3 | n
3.1.0 | ^3 || nope | n
1.2.3-beta.2 | >=1.2.3-beta.1 | y
1.2.3-beta.11 | >1.2.3-beta.2 | y
1.2.3-beta | >=1.0.0 | n
1.2.3 | >1.2.3-beta | y
1.2.3-alpha | <1.2.3-alpha.1 | y
1.2.3+build.5 | 1.2.3 | y
1.2.3 | =1.2.3+other | y
1.2.3 | != 1.2.3 | n
1.3.0 | !=1.2 | y
2.0.0 | >1 | y
1.9.0 | >1 | n
1.9.0 | <=1 | y
2.0.0 | <=1 | n
1.9.0 | => 1.2 < 2 | y
v1.0 | 1.0.0 | y
7.1.0 | ~0.0.0 | y
x | * | n
1.0.0 | nope | n
1.0.0\n | 1.0.0 | n
"""


def test_versions(spark):
    cases = [tuple(x.strip(" ") for x in line.split(" | ")) for line in VERSIONS.strip().split("\n") if " | " in line]
    cases = [(v.replace("\\n", "\n"), c, w == "y") for v, c, w in cases]
    df = spark.createDataFrame(cases, "v string, c string, want boolean")
    rows = versions.met(df, "v", "c", "got").collect()
    assert [tuple(r) for r in rows if r.got != r.want] == [] and len(rows) == len(cases)


def test_version_keys_sort(spark):
    order = ["0.0.0-0", "0.0.0", "0.9.10", "0.10.2-9", "0.10.2-10", "0.10.2-99999999999999999999", "0.10.2-a", "0.10.2-a.1", "0.10.2-a.b", "0.10.2-a-b", "0.10.2-ab", "0.10.2", "1.0.0", "999999999999999999.0.0"]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(order)], "v string, i int").withColumn("k", versions.version_key(F.col("v")))
    assert [r.v for r in df.orderBy("k").collect()] == order
    odd = spark.createDataFrame([("x",), (None,), ("1.2.3.4",), ("9" * 19,)], "v string").select(versions.version_key(F.col("v")).alias("k"))
    assert [r.k for r in odd.collect()] == [None] * 4


def test_constraints_are_compiled_once(spark):
    df = spark.createDataFrame([("1 - 2 || !=3.1, >=3",), (">1 <2",), (">2 <1",), ("x",), ("1 nope",), (None,), ("",)] * 3, "constraint string")
    rows = {(r.constraint, len(r.holes)) for r in versions.compiled_constraints(df).collect()}
    assert rows == {("1 - 2 || !=3.1, >=3", 0), ("1 - 2 || !=3.1, >=3", 1), (">1 <2", 0), ("x", 0), ("", 0)}


TOP = "apiVersion: v1\nkind: Pod\n"
HOOKS = [
    ("metadata:\n  annotations:\n    helm.sh/hook: x\n", True),
    ('metadata:\n  annotations:\n    {{- if .Values.t }}\n    "helm.sh/hook": x\n    {{- end }}\n', True),
    ("metadata: # a\n  annotations: # b\n    helm.sh/hook: x\n", True),
    ("metadata:\n  annotations: {helm.sh/hook: x}\n", True),
    ("metadata:\n  annotations: {'a/b': 'c', \"helm.sh/hook\": 'x'} # d\n", True),
    ("metadata:\n  labels:\n    - app: a\n  annotations:\n    helm.sh/hook: x\n", True),
    ("metadata:\n  annotations:\n    note: a\n--- # second\nmetadata:\n  annotations:\n    'helm.sh/hook': x\n", True),
    ("data:\n  helm.sh/hook: x\n", False),
    ("# helm.sh/hook: x\n", False),
    ("metadata:\n  annotations:\n    text: |\n      helm.sh/hook: x\n", False),
    ("metadata:\n  annotations:\n    a:\n      helm.sh/hook: x\n", False),
    ("metadata:\n  annotations:\n---\n    helm.sh/hook: x\n", False),
    ("metadata:\n  annotations:\n...\n    helm.sh/hook: x\n", False),
    ("spec:\n  metadata:\n    annotations:\n      helm.sh/hook: x\n", False),
    ("metadata:\n  labels:\n    annotations:\n      helm.sh/hook: x\n", False),
    ("metadata:\n  annotations:\n    a: b\n  helm.sh/hook: x\n", False),
    ("metadata:\n  annotations:\n    - a:\n        helm.sh/hook: x\n", False),
    ("metadata:\n  annotations: {a: {helm.sh/hook: x}}\n", False),
    ("metadata:\n  annotations: {a: 'helm.sh/hook: x'}\n", False),
    ("metadata:\n  annotations: [{helm.sh/hook: x}]\n", False),
    ("metadata:\n  annotations: '# a'\n    helm.sh/hook: x\n", False),
]
BARE = [
    ("  kind: Pod\n  metadata:\n    annotations:\n      'helm.sh/hook': x\n", True), ("- kind: Pod\n  metadata:\n    annotations:\n      helm.sh/hook: x\n", False),
    ("-\n  kind: Pod\n  metadata:\n    annotations:\n      helm.sh/hook: x\n", False), (None, False), ("", False),
]


def test_hooks(spark):
    cases = [(None if s is None else s, w) for s, w in [*((TOP + s, w) for s, w in HOOKS), *BARE]]
    rows = spark.createDataFrame(cases, "s string, want boolean").select("s", "want", detection.is_hook(F.col("s")).alias("got")).collect()
    assert [tuple(r) for r in rows if r.got != r.want] == []


def test_value_paths(spark):
    source = 'x {{ (index .Values "a").b }} y\n{{ index .Values "k.y" 0 }} {{ .Values.p.q }}{{ "}}" }}\n{{/* .Values.c */}}{{ index $.Values.z .n }}{{ `a}}` | f "\\"}}" $.Values.w }}'
    actions = documents.template_actions(spark.createDataFrame([("a", source), ("b", None), ("c", "{{ x")], "artifact_id string, source string"))
    rows = documents.value_references(actions).collect()
    assert sorted((r.line, r.path, r.dynamic) for r in rows) == [(1, "a.b", False), (2, "k%2Ey.0", False), (2, "p.q", False), (3, "w", False), (3, "z.[expr]", True)]
    starts = [(r.start, r.line) for r in actions.orderBy("nth").collect()]
    assert all(source[s : s + 2] == "{{" and source.count("\n", 0, s) + 1 == n for s, n in starts) and len(starts) == 6


def test_template_scan_is_linear(spark):
    def seconds(n):
        df = spark.createDataFrame([("a", "{{ .Values.x }} " * n)], "artifact_id string, source string")
        began = time.time()
        assert documents.template_actions(df).agg(F.count("*"), F.max("start")).first()[:] == (n, 16 * (n - 1))
        return time.time() - began

    seconds(100)
    small, large = min(seconds(24_000) for _ in range(2)), min(seconds(96_000) for _ in range(2))
    assert large <= 5 and large <= 9 * small + 0.05


def winners(spark, rows):
    df = spark.createDataFrame([("t", *r) for r in rows], "tree string, name string, template string, depth int, path string, start int, empty boolean")
    return {r.name: r.template for r in resolution.template_winners(df).collect()}


def test_the_first_name_at_the_top_wins(spark):
    rows = [("shared", "a", 2, "templates/_a.tpl", 0, False), ("shared", "z", 2, "templates/_z.tpl", 0, False), ("shared", "d", 3, "templates/deep/_first.tpl", 0, False)]
    assert winners(spark, rows) == {"shared": "a"}
    assert winners(spark, [("shared", "parent", 2, "templates/_x.tpl", 0, False), ("shared", "child", 4, "charts/c/templates/_a.tpl", 0, False)]) == {"shared": "parent"}


@pytest.mark.parametrize("rows, want", [
    ([("n", "a", 2, "a", 0, True), ("n", "z", 2, "z", 0, False)], "z"),
    ([("n", "a", 2, "a", 0, False), ("n", "z", 2, "z", 0, True)], "a"),
    ([("n", "a", 2, "a", 0, True), ("n", "z", 2, "z", 0, True)], "z"),
    ([("n", "a", 2, "a", 0, True), ("n", "a", 2, "a", 9, False)], "a"),
])
def test_empty_definitions_only_fill(spark, rows, want):
    assert winners(spark, rows) == {"n": want}


def test_a_name_twice_in_a_file_leaves_a_tree_without_winners(spark):
    assert winners(spark, [("n", "a", 2, "a", 0, False), ("n", "a", 2, "a", 9, False), ("m", "b", 2, "b", 0, False)]) == {}


def test_ordinals_beyond_four_digits(spark):
    df = precedence.ordinals(spark.range(10_002).selectExpr("1 AS k", "id"), ["k"], ["id"])
    assert {r.id: r.ordinal for r in df.where("id IN (0, 9999, 10000, 10001)").collect()} == {0: "0000", 9999: "9999", 10000: "10000", 10001: "10001"}


def test_a_line_feed_is_encoded(spark):
    df = spark.createDataFrame([("x\n",), ("x",), ("a/b c",), ("é",), ("",)], "s string")
    rows = df.select("s", identity.encode_segment(F.col("s")).alias("e"), identity.decode_segment(identity.encode_segment(F.col("s"))).alias("d")).collect()
    assert [r.e for r in rows] == ["x%0A", "x", "a%2Fb%20c", "%C3%A9", ""] and all(r.s == r.d for r in rows)
    ids = spark.createDataFrame([("can://artifact/my%20app/a/b",), ("can://iac/x@key/y",), ("can://iac/%zz/y",), ("other",)], "i string")
    assert [r[0] for r in ids.select(identity.application_of(F.col("i"))).collect()] == ["my app", "x", None, None]


def test_repeated_keys_multiply_nothing(spark):
    f = spark.createDataFrame([(1, None), (2, "a")], "k int, t string")
    p = spark.createDataFrame([(1, "b"), (1, "b"), (1, None), (2, "a"), (2, "c")], "k int, t string")
    assert sorted(map(tuple, facts.filled_targets(f, p, "k", "t").collect())) == [(1, "b", False), (2, "a", True)]
    inventory = spark.createDataFrame([(1, "x", "text"), (2, "y", "text")], "k int, d string, c string")
    known = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (2, "z")], "k int, d string")
    assert sorted((r.k, r.conflict, r.c) for r in facts.guarded(inventory, known, "k", "d", "c").collect()) == [(1, False, "text"), (2, True, "")]
