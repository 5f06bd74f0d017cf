"""Operators over pairs, sequences and vectors, and the pipeline."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeline.llm import exact_topk, line_dedup, minhash_dedup, packing, sentencepieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or ""), "clash") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, n string")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def union(pairs, items):
    parent = {x: x for x in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in items}


def test_edit_distance_band():
    rng = random.Random(2)
    pairs = []
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(9)))
        b = list(a)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "b"])
        b = "".join(b)
        for k in (0, 1, 2, 3):
            assert line_dedup.within(a, b, k) == (distance(a, b) <= k), (a, b, k)
            pairs.append((a, b, k))
    long = ["".join(rng.choice("abcé\U0001f600 ") for _ in range(n)) for n in (30, 31, 33, 90, 91, 200)]
    for x in long:
        for _ in range(60):
            y = list(x)
            for _ in range(rng.randrange(6)):
                at = rng.randrange(len(y) + 1)
                y[at : at + rng.randrange(2)] = rng.choice(["", "z", "a"])
            pairs.append((x, "".join(y), rng.randrange(5)))
    found = line_dedup.all_within([p[:2] for p in pairs], np.array([p[2] for p in pairs]))
    assert found.tolist() == [distance(a, b) <= k for a, b, k in pairs] and not len(line_dedup.all_within([], np.zeros(0, np.int64)))


@pytest.mark.parametrize("edits", [1, 2])
def test_line_classes(spark, edits):
    rng = random.Random(edits)
    seed = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(20, 34))) for _ in range(12)]
    lines = []
    for s in seed:
        for _ in range(9):
            x = list(s)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(x) + 1)
                x[at : at + rng.randrange(2)] = rng.choice(["", "z", "a"])
            lines.append("".join(x))
    rng.shuffle(lines)
    texts = [None, "", "short\nshort", *("\n".join([*lines[i : i + 4], "tiny"]) for i in range(0, len(lines), 4)), "\n".join(lines[:2])]
    df = documents(spark, texts)
    every = [(d, i, x) for d, t in enumerate(texts) for i, x in enumerate((t or "").split("\n")) if len(x) >= 20]
    distinct = sorted({x for *_, x in every})
    links = [(a, b) for a, b in itertools.combinations(distinct, 2) if abs(len(a) - len(b)) <= edits and distance(a, b) <= edits]
    class_, n = union(links, distinct), collections.Counter(x for p in links for x in p)
    first = {}
    for d, i, x in every:
        first.setdefault(class_[x], (d, i))
    want = {(d, i, *first[class_[x]], n[x], (d, i) == first[class_[x]]) for d, i, x in every}
    assert {tuple(r) for r in line_dedup.line_classes(df, edits, least=20).collect()} == want
    kept = {(d, i) for d, i, *_, k in want if k} | {(d, i) for d, t in enumerate(texts) for i, x in enumerate((t or "").split("\n")) if len(x) < 20}
    out = {r.doc_id: r.text for r in line_dedup.without_duplicate_lines(df, edits, least=20).collect()}
    for d, t in enumerate(texts):
        left = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) in kept)
        assert out.get(d, "") == left or not left and d not in out and t
    assert line_dedup.line_classes(df.limit(0)).count() == 0


def near_wanted(texts, k):
    sets = []
    for t in texts:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    of = union(links, range(len(sets)))
    return {(d, len(sets[d]), of[d], of[d] == d) for d in of}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " ", "a b", "A B", "a b c", "x", "x"]
    passage = " ".join(rng.choice(words) for _ in range(70))
    for n in (30, 64, 90, 300):
        base = [rng.choice(words) for _ in range(n)]
        for _ in range(40):
            x = list(base)
            for _ in range(rng.randrange(1 + n // 30)):
                x[rng.randrange(len(x))] = rng.choice(words)
            texts.append(" ".join(x))
        texts += [" ".join(base).upper(), " ".join(base)]
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randrange(10, 60))) for _ in range(60)]
    df = documents(spark, texts)
    assert {tuple(r) for r in minhash_dedup.near_duplicates(df, k).collect()} == near_wanted(texts, k)
    odd = df.select("doc_id", "text").unionByName(spark.createDataFrame([(None, texts[20]), (20, texts[20])], "doc_id long, text string"))
    rows = minhash_dedup.near_duplicates(odd, k).collect()
    assert len(rows) == len(texts) + 2 and [r.kept for r in rows if r.doc_id is None] == [True]
    assert minhash_dedup.near_duplicates(df.limit(0), k).count() == 0


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(8)
    texts = [None, "", "a<|endoftext|>b", "naïve ☃ 日本語 text", "don't we'll  x\n\n y ", "word " * 5000, "the " * 2047, "the " * 2048, *(" ".join(rng.choice(["alpha", "beta", "of", "the"]) for _ in range(rng.randrange(1, 900))) for _ in range(200))]
    df = documents(spark, texts)
    pieces = packing.token_pieces(df.unionByName(df), path, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = packing.packed(pieces).collect()
    want = []
    for d, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        at, i = 0, 0
        while at < len(ids):
            n = (len(ids) % 2048 or 2048) if at == 0 else 2048
            want.append((d, i, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at, i = at + n, i + 1
    assert sorted((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in rows) == sorted(want * 2)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 2048
    assert len(bins) <= 1.03 * sum(r.length for r in rows) / 2048 + 2
    assert packing.packed(pieces.limit(0)).count() == 0


def test_sum_of_squares_chooses_least():
    rng = random.Random(4)
    lengths = np.array([rng.randrange(1, 11) for _ in range(400)])
    placed = packing.sum_of_squares(lengths, 10)
    fill = collections.Counter()
    for n, b in zip(lengths.tolist(), placed.tolist(), strict=True):
        def cost(at, n=n):
            after = collections.Counter(v + n if k == at else v for k, v in fill.items())
            if at is None:
                after[n] += 1
            return sum(c * c for v, c in after.items() if 0 < v < 10)
        options = [None, *(k for k, v in fill.items() if v + n <= 10)]
        assert cost(b if b in fill else None) == min(map(cost, options))
        fill[b] += n
    assert max(fill.values()) <= 10


def test_sentencepiece(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(6)
    texts = [None, "", " ", "  two  spaces ", "▁mark", "日本 ☃ naïve\n\ttab", "<s> <unk> </s>", "x" * 3000, *("".join(rng.choice("aeinrst  ,.öß") for _ in range(80)) for _ in range(60))]
    df = documents(spark, texts)
    out = sentencepieces.decode(sentencepieces.encode(df.unionByName(df), path), path).collect()
    assert len(out) == 2 * len(texts)
    for r in out:
        t = texts[r.doc_id] or ""
        ids = np.frombuffer(r.ids, "<i4").tolist()
        assert ids == sp.encode(t) and r.decoded == t.replace("▁", " ")
    assert sentencepieces.encode(df.limit(0), path).count() == 0


def test_unigram_viterbi_is_best():
    import public_tokenizers

    model = sentencepieces.Model.of(public_tokenizers.path("piece_bpe_32k.model"), "unigram")
    scores = {p: model.scores[i] for p, i in model.ids.items()}

    def best(unit):
        at = [0.0] + [float("-inf")] * len(unit)
        for e in range(1, len(unit) + 1):
            for s in range(e):
                x = unit[s:e]
                if x in scores:
                    at[e] = max(at[e], at[s] + scores[x])
            if unit[e - 1] not in scores:
                at[e] = max(at[e], at[e - 1] + model.unknown_score)
        return at[-1]

    rng = random.Random(9)
    for _ in range(200):
        unit = "▁" + "".join(rng.choice("aeinrstol☃𓀀") for _ in range(rng.randrange(1, 12)))
        parts, _ = model.segments(unit)
        assert "".join(parts) == unit and sum(scores.get(p, model.unknown_score) for p in parts) == pytest.approx(best(unit))


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e12])
def test_topk(spark, scale):
    rng = np.random.RandomState(3)
    x = (rng.randn(500, 16) * scale).round(3 if scale == 1 else 15)
    x[50:80] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None]), (902, [float("nan")] * 16), (903, [float("inf")] * 16), (None, x[0].tolist()), (904, x[1, :9].tolist()), (400, x[400].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit("clash"))
    found = collections.defaultdict(list)
    for r in exact_topk.exact_topk(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    whole = {i: [int(np.floor(1024 * c)) for c in v] for i, v in enumerate(x)} | {904: [int(np.floor(1024 * c)) for c in x[1, :9]] + [0] * 7}
    ids = [*whole, 400]
    held = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    for q in (0, 100, 200, 300, 400):
        scores = sorted((-held(sum(a * b for a, b in zip(whole[i], whole[q], strict=True))), i) for i in ids if i != q)[:10]
        want = [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
        assert sorted(set(found[q])) == want
    assert exact_topk.exact_topk(df.limit(0), df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, at), "test")
        if i < 4:
            assert docs.columns == columns and docs.select("doc_id").distinct().count() == docs.count()
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] == counts[4] <= counts[5]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near dedup", "secret scans", "packing"]


def test_pipeline_takes_empty_tables(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, ""), "test")
    assert docs.count() == 0


def test_a_pair_at_the_threshold_is_hardly_ever_missed():
    from math import comb

    from lodeline.llm import minhash_dedup as m

    assert sum(comb(m.RETAINED, i) * 0.8**i * 0.2 ** (m.RETAINED - i) for i in range(m.SHARED)) < 1e-7
