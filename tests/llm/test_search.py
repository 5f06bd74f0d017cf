"""Lexical search, substring dedup and hard negatives against plain versions, with odd input."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeline.llm import exact_topk, hard_negatives, lexical_search, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# --- lexical search -------------------------------------------------------------------------------


def ranked(docs, items, k=10, once=True):
    terms = [TERM.findall((t or "").translate(LOWER)) for _, t in docs]
    n, total = sum(bool(t) for t in terms), sum(map(len, terms))
    counts = [collections.Counter(t) for t in terms]
    df = collections.Counter(t for c in counts for t in c)
    asked = collections.defaultdict(collections.Counter)
    for i, t in items:
        if i is not None:
            asked[i].update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for i, own in asked.items():
        scored = []
        for (d, _), words, c in zip(docs, terms, counts):
            if d is None or not words:
                continue
            m = 10 + 90 * len(words) * n // total
            score = sum((1 if once else times) * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in own.items() if c[t])
            if score > 0:
                scored.append((-score, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


DOCS = [(1, "The cat sat. THE CAT!"), (2, "the Cät sat\x00sat"), (3, None), (4, ""), (5, "..."), (6, "cat cat cat dog"), (6, "cat cat cat dog"), (None, "dog cat zebra"), (7, "cat " * 3000 + "dog"), (8, "x9 9x İstanbul"), (9, "cat cat cat dog")]
ITEMS = [(1, "cat Dog dog"), (2, None), (3, ""), (None, "cat"), (4, "zebra İstanbul"), (1, "sat"), (5, "cät X9"), (6, "nothing here")]


@pytest.mark.parametrize("once", [True, False])
def test_lexical_search(spark, once, monkeypatch):
    docs = spark.createDataFrame([(d, t, i, t, "n") for i, (d, t) in enumerate(DOCS)], "doc_id long, text string, score long, term string, n string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(lexical_search, "TURN", 3)
    for k in (2, 10):
        got = lexical_search.lexical_search(docs, items, k=k, once=once).collect()
        assert sorted(map(tuple, got)) == ranked(DOCS, ITEMS, k, once)


def test_lexical_search_of_nothing(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    for a, b in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("text is null"), items)):
        assert lexical_search.lexical_search(a, b).collect() == []


# --- substring dedup ------------------------------------------------------------------------------


def deduped(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def passages(seed, window):
    rng = np.random.RandomState(seed)
    fresh = lambda n: " ".join(rng.choice(["a", "b", "cc", "dé", "日本", f"w{rng.randint(9)}"], n))
    shared = [fresh(n) for n in (window - 1, window, window + 1, 3 * window, 8 * window)]
    rows = [(None, None), (0, ""), (1, " \t\n "), (2, "a " * 5 * window), (3, "x " + "a " * 2 * window + "y"), (4, "ab " * 4 * window), (5, fresh(2 * window)), (5, fresh(2 * window)), (None, shared[3])]
    for i in range(40):
        rows.append((10 + i, f" {fresh(rng.randint(30))} \n{shared[rng.randint(5)]}\t{fresh(rng.randint(60))} {shared[rng.randint(5)]} "))
    return [*rows, rows[-1], (99, rows[-1][1])]


@pytest.mark.parametrize("window", [2, 5, 12, 35])
def test_substring_dedup(spark, window):
    rows = passages(window, window)
    docs = spark.createDataFrame([(d, t, 1, b"x") for d, t in rows], "doc_id long, text string, base long, names binary").repartition(5)
    got = sorted(map(tuple, substring_dedup.substring_dedup(docs, window).collect()), key=repr)
    assert got == deduped(rows, window)


def test_long_texts_are_rewritten_in_pieces(spark):
    rng = np.random.RandomState(3)
    words = [f"w{x}" for x in rng.randint(0, 1000, 150_000)]
    words[59_990:60_040] = words[100:150]
    rows = [(1, " ".join(words)), (2, " ".join(words[119_900:119_960])), (3, " ".join(words[7:40]))]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == deduped(rows, 35)
    assert {r.doc_id: r.n_removed for r in got} == {1: 160, 2: 60, 3: 0}


def test_no_texts_to_dedup(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.substring_dedup(docs).collect() == []
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(docs, window=1)


@pytest.mark.parametrize("kinds", [2, 5, 1000])
def test_certain_symbols_are_the_same_in_any_context(kinds):
    rng = np.random.RandomState(kinds)
    for _ in range(60):
        n = rng.randint(5, 80)
        passage = rng.randint(0, kinds, n)
        inside = []
        for _ in range(4):
            a, b = rng.randint(0, kinds, rng.randint(0, 20)), rng.randint(0, kinds, rng.randint(0, 20))
            whole = np.concatenate([a, passage, b]).astype(np.uint64)
            name, start, first, last = substring_dedup.recompressed(whole, np.zeros(len(whole), int), "rpppprpp")
            low, high = first[len(a)], last[len(a) + n]
            keep = (start >= low) & (np.append(start[1:], len(whole)) <= high)
            inside.append([(int(x), int(s) - len(a)) for x, s in zip(name[keep], start[keep])])
        assert all(x == inside[0] for x in inside)


# --- hard negatives -------------------------------------------------------------------------------


def mined(rows, k=5, percent=80):
    own = [(i, la, [math.floor(256 * x) for x in v]) for i, la, v in rows if i is not None and la is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, la, v in own:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (la, v)), (la, v))
    out = []
    for a, (la, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, lb) for i, lb, w in own if i != a)
        for p, s in sorted({(i, -s) for s, i, lb in [x for x in scored if x[2] == la][:k]}):
            fit = [(i, -t) for t, i, lb in scored if lb != la and percent * s <= -100 * t <= 100 * s][:k]
            out += [(a, p, r + 1, i, s, t) for r, (i, t) in enumerate(fit)]
    return sorted(out)


def vectors(seed, n, width, kinds=4):
    rng = np.random.RandomState(seed)
    centres = rng.randn(6, width)
    rows = [(int(i), int(rng.randint(kinds)), (centres[rng.randint(6)] + 0.3 * rng.randn(width)).round(2).tolist()) for i in range(n)]
    return rows


@pytest.mark.parametrize("width", [2, 8, 64])
def test_hard_negatives(spark, width):
    rows = vectors(width, 900, width)
    rows += [(None, 1, [1.0] * width), (901, None, [1.0] * width), (902, 1, None), (903, 1, [float("nan")] * width), (904, 1, [None] * width), (905, 2, [float("-inf")]), (906, 2, []), (1000, 0, [0.0] * width), (1100, 1, rows[5][2]), (1100, 0, rows[6][2]), (1200, 9, [1.0])]
    rows += [rows[7]] * 3 + [(7, 1, rows[7][2]), (907, rows[100][1], rows[100][2]), (908, (rows[100][1] + 1) % 4, rows[100][2])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<double>, score int, x string").repartition(3)
    got = hard_negatives.hard_negatives(df, df.where("vec_id % 100 = 0")).collect()
    assert sorted(map(tuple, got)) == mined(rows)


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame(vectors(1, 30, 3), "vec_id long, label int, embedding array<double>")
    assert hard_negatives.hard_negatives(df, df.where("false")).collect() == []
    assert hard_negatives.hard_negatives(df.where("false"), df).collect() == []


def test_long_vectors_stop_the_job(spark):
    df = spark.createDataFrame([(0, 1, [1e9] * 4)], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="too long"):
        hard_negatives.hard_negatives(df, df).collect()


def test_a_walk_leaves_subtrees_out():
    rng = np.random.RandomState(5)
    x = rng.randn(4000, 3)
    x = np.floor(400 * x / np.linalg.norm(x, axis=1)[:, None])
    tree = hard_negatives.VantageTree(np.arange(4000), np.zeros(4000, int), x)
    leaves = sum(left < 0 for *_, left, _ in tree.nodes)
    query, seen = x[17], 0
    scores = np.sort((x @ query).astype(np.int64))[::-1]
    best = hard_negatives.Best(np.array([scores[400]]), np.array([scores[200]]), 5)
    adding = best.add

    def counted(*a):
        nonlocal seen
        seen += 1
        adding(*a)

    best.add = counted
    hard_negatives._walk(tree, 17, 1, query, best, same=False)
    assert best.scores[0].tolist() == scores[(scores <= scores[200])][:5].tolist() and seen < leaves / 2


def test_rows_of_one_id_are_dealt_to_all_blocks(spark):
    df = spark.range(0, 30_000, 1, 3).select(F.lit(5).alias("vec_id")).select(exact_topk._block(4).alias("b"))
    assert all(6_500 < r["count"] < 8_500 for r in df.groupBy("b").count().collect())
    vectors = spark.createDataFrame([(5, [float(i % 7), 1.0]) for i in range(9000)] + [(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = exact_topk.exact_topk(vectors, vectors.where("vec_id = 1"), k=3).collect()
    assert sorted(map(tuple, got)) == [(1, r, 5, 6 * 1024 * 1024) for r in (1, 2, 3)]
