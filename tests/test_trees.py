"""Digests of trees against the digest of their text."""

import hashlib
import json
import random

import pyarrow as pa
import pytest

from lodeline.operators import trees


def rows_of(x, keys=()):
    kind = {dict: "map", list: "seq", str: "str", bool: "bool", int: "int", float: "float", type(None): "null"}[type(x)]
    yield list(keys), kind, None if kind in ("map", "seq", "null") else json.dumps(x) if kind != "str" else x
    for k, v in x.items() if kind == "map" else enumerate(x) if kind == "seq" else ():
        yield from rows_of(v, (*keys, str(k)))


def text_of(x):
    out = json.dumps(x, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    return out.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026").replace("\u2028", "\\u2028")


def made(rng, depth):
    kind = rng.randint(0, 8 if depth else 5)
    if kind > 5:
        return [made(rng, depth - 1) for _ in range(rng.randint(0, 13))] if kind == 6 else {rng.choice(["a", "10", "9", "b<", "ä", "Z", "x.y", ""]) + str(rng.randint(0, 3)): made(rng, depth - 1) for _ in range(rng.randint(0, 5))}
    return [None, True, rng.randint(-99, 99), rng.choice([0.5, -2.25, 1234.5]), rng.choice(["", "a\n\"b", "&<>\u2028", "日本\x7f\x01\b"]), False][kind]


def test_digests(spark):
    rng = random.Random(2)
    every = [made(rng, 4) for _ in range(60)] + [{"a": list(range(30))}, {}, [], "x", None]
    rows = [(i, *r) for i, x in enumerate(every) for r in rows_of(x)] + [(None, ["a"], "int", "1")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "tree long, keys array<string>, kind string, value string").repartition(3)
    got = {r.tree: r.digest for r in trees.tree_digests(df).collect()}
    assert got == {i: hashlib.sha256(text_of(x).encode()).hexdigest() for i, x in enumerate(every)}


def test_maps_without_a_row_of_their_own():
    assert "".join(trees._texts([(["a", "b"], "int", "1"), (["a", "c", "d"], "null", None), (["e"], "str", "x")])) == '{"a":{"b":1,"c":{"d":null}},"e":"x"}'


def test_places_across_batches():
    """Items of sequences and keys of maps that look alike, in batches of one row and of all."""
    every = [{"10": 1, "9": [0] * 12, "a": {"b": [[1, 2], {"10": 0, "9": 0}]}}, [[{"1": 0}], 2], {"x": {"2": 0, "10": 0}}]
    rows = sorted((i, list(keys), kind, value) for i, x in enumerate(every) for keys, kind, value in rows_of(x))
    rows = [r for r in rows if r[1] != ["x"]]  # a map without a row of its own
    whole = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.list_(pa.string()), pa.string(), pa.string()), strict=True)], ["tree", "keys", "kind", "value"])

    def padded(i, keys):
        x, out = every[i], []
        for k in keys:
            out.append(k.rjust(12, "0") if isinstance(x, list) else k)
            x = x[int(k)] if isinstance(x, list) else x[k]
        return out

    expected = [padded(i, keys) for i, keys, *_ in rows]
    for n in (1, 2, 5, len(rows)):
        out = list(trees._placed(iter([whole.slice(0, 0), *(whole.slice(i, n) for i in range(0, len(rows), n))])))
        assert [p for b in out for p in b.column("place").to_pylist()] == expected
        assert [k for b in out for k in b.column("keys").to_pylist()] == [r[1] for r in rows]


def test_rows_are_shuffled_once(spark):
    df = spark.createDataFrame([(1, ["a"], "seq", None), (1, ["a", "0"], "int", "1")], "tree long, keys array<string>, kind string, value string")
    plan = trees.tree_digests(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


@pytest.mark.parametrize("x, text", [(1.0, "1"), (100.0, "100"), (1.5, "1.5"), (1e20, "100000000000000000000"), (1e21, "1e+21"), (1.25e-7, "1.25e-7"), (0.000001, "0.000001"), (0.00001234, "0.00001234"), (-0.5, "-0.5"), (0.0, "0")])
def test_numbers(x, text):
    assert trees._number(x) == text
