"""Line dedup with its default bound, one edit for every twenty characters, against brute force."""

import hashlib
import itertools
import random
import struct

import numpy as np
import pytest

from test_joins import distance, documents

from lodeline.llm import line_dedup, queries


def varied(rng, lengths, times, most):
    out = []
    for n in lengths:
        seed = "".join(rng.choice("abcdefgé ") for _ in range(n))
        for _ in range(times):
            x = list(seed)
            for _ in range(rng.randrange(most + 1)):
                at = rng.randrange(len(x) + 1)
                x[at : at + rng.randrange(2)] = rng.choice(["", "z", "ü"])
            out.append("".join(x))
    return out


@pytest.mark.parametrize("size", [line_dedup.CROWD, 1])
def test_longer_lines_may_differ_more(spark, size, monkeypatch):
    monkeypatch.setattr(line_dedup, "CROWD", size)
    lines = varied(random.Random(5), [21, 39, 41, 59, 62, 80, 83, 100, 212], 9, 6)
    df = documents(spark, ["\n".join(lines[i : i + 5]) for i in range(0, len(lines), 5)])
    long = sorted({x for x in lines if len(x) >= 20})
    bound = {(a, b): min(4, min(len(a), len(b)) // 20) for a, b in itertools.combinations(long, 2)}
    want = {p for p, k in bound.items() if abs(len(p[0]) - len(p[1])) <= k and distance(*p) <= k}
    assert {distance(*p) for p in want} == {1, 2, 3, 4}
    of = {named(x): x for x in lines}
    rows = line_dedup.line_links(df).collect()
    found = {tuple(sorted((of[tuple(r.a)], of[tuple(r.b)]))) for r in rows}
    assert found == want and len(rows) == len(want)


def named(line):
    return struct.unpack("<qq", hashlib.blake2b(line.encode(), digest_size=16).digest())


@pytest.mark.parametrize("size", [line_dedup.CROWD, 1])
def test_every_place_of_the_edits(spark, size, monkeypatch):
    """Lines at the ends of length classes, with all edits at one place, wherever it lies."""
    monkeypatch.setattr(line_dedup, "CROWD", size)
    rng = random.Random(8)
    want, lines = set(), set()
    for k, sizes in ((1, (20, 23, 24, 28, 39)), (2, (40, 47, 48, 59)), (3, (60, 71, 72, 79)), (4, (80, 95, 96, 115, 300))):
        for n in sizes:
            for at in range(0, n + 1, max(1, n // 12)):
                x = "".join(rng.choice("abcdefghij") for _ in range(n))
                for y in (x[:at] + "z" * k + x[at:], x[:at] + "y" * k + x[at + k :], x[:at] + "w" * (k // 2) + x[at:], x[: at // 2] + "v" + x[at // 2 : at] + "v" * (k - 1) + x[at:]):
                    m = min(len(x), len(y))
                    if min(4, m // 20) >= k and x != y:
                        want.add(tuple(sorted((x, y))))
                    lines |= {x, y}
    of = {named(x): x for x in lines}
    lines = sorted(lines)
    df = documents(spark, ["\n".join(lines[i : i + 40]) for i in range(0, len(lines), 40)])
    found = {tuple(sorted((of[tuple(r.a)], of[tuple(r.b)]))) for r in line_dedup.line_links(df).collect()}
    assert want <= found and all(distance(*p) <= line_dedup.allowed(*p, None) for p in found - want)


def test_lines_shorter_than_their_segments(spark):
    texts = ["a\nb\nab\nabc\nxyz\nabcd\nabzd\n\u00e9\nab\u00e9"]
    lines = texts[0].split("\n")
    want = {tuple(sorted(p)) for p in itertools.combinations(lines, 2) if distance(*p) <= 2}
    of = {named(x): x for x in lines}
    found = {tuple(sorted((of[tuple(r.a)], of[tuple(r.b)]))) for r in line_dedup.line_links(documents(spark, texts), 2).collect()}
    assert found == want


def test_short_lines_have_rows_and_classes(spark, tmp_path):
    texts = ["Of.\n\nIn in.", "Of.\nOf,", None, "", "x" * 19 + "\n" + "x" * 20, "x" * 19 + "\n" + "x" * 19 + "y", "In in.\n "]
    df = documents(spark, texts)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.n_links, r.kept) for r in queries.QUERIES["op3_line_dedup"](spark, str(tmp_path)).collect()}
    assert rows == {
        (0, 0): (0, 0, 0, True), (0, 2): (0, 2, 0, True), (1, 0): (0, 0, 0, False), (1, 1): (1, 1, 0, True),
        (4, 0): (4, 0, 0, True), (4, 1): (4, 1, 1, True), (5, 0): (4, 0, 0, False), (5, 1): (4, 1, 1, False),
        (6, 0): (0, 2, 0, False), (6, 1): (6, 1, 0, True),
    }
    out = {r.doc_id: r.text for r in line_dedup.without_duplicate_lines(df, least=20).collect()}
    assert out[1] == texts[1] and out[5] == "x" * 19 and out[6] == texts[6]
    short = {r.doc_id: r.text for r in line_dedup.without_duplicate_lines(df).collect()}
    assert short == {0: texts[0], 1: "Of,", 2: None, 3: "", 4: texts[4], 5: "", 6: " "} or short == {0: texts[0], 1: "Of,", 2: None, 3: "", 4: texts[4], 6: " "}


def crowd(n, seed=0, width=40):
    rng = np.random.RandomState(seed)
    made = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), width)) for _ in range(n)]
    return ["the same beginning of every line, in 48 letters. " + x for x in made]


def test_a_crowd_meets_by_finer_segments(spark):
    lines = crowd(1500)
    rng = np.random.RandomState(1)
    near = []
    for x in lines[:60]:
        y = list(x)
        for _ in range(rng.randint(1, 5)):
            i = rng.randint(len(y))
            y[i : i + rng.randint(0, 2)] = [chr(97 + rng.randint(26))] * rng.randint(0, 2)
        near.append("".join(y))
    every = list(dict.fromkeys(lines + near))
    df = documents(spark, ["\n".join(every[i::7]) for i in range(7)])
    of = {named(x): x for x in every}
    found = {tuple(sorted((of[tuple(r.a)], of[tuple(r.b)]))) for r in line_dedup.line_links(df).collect()}
    want = {tuple(sorted((x, y))) for x, y in zip(lines[:60], near) if x != y and distance(x, y) <= line_dedup.allowed(x, y, None)}
    assert len(want) > 40 and want <= found and all(distance(*p) <= line_dedup.allowed(*p, None) for p in found)


def test_rows_of_one_id_keep_their_own_lines(spark):
    a, b, c = ("a line of text that is long enough to count " + x for x in ("one " * 9, "2 " * 20, "drei"))
    rows = [(None, f"{a}\n{b}"), (None, f"{c}\n{a}"), (7, f"{b}\n{b}"), (7, "only here"), (7, "only here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id is None, r.text) for r in line_dedup.without_duplicate_lines(df).collect())
    kept = [line for _, t in out for line in t.split("\n")]
    assert sorted(kept) == sorted([a, b, c, "only here", "only here"])
