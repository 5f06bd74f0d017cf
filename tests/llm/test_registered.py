"""Registered queries and the pipeline's stages against plain versions, on the smallest tables and on small fixtures."""

import collections
import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_joins import documents, near_wanted, union
from test_text import TEXTS, WORD, base_spans, lower
from tokenizers import Tokenizer

from lodeline.llm import common, exact_topk, line_dedup, packing, quality_classifier, queries, secret_scans, url_filters

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def line_wanted(texts):
    """(doc, line) to (first doc, first line, links) by comparing all lines."""
    every = [(d, i, x) for d in sorted(texts) for i, x in enumerate((texts[d] or "").split("\n")) if x]
    by_size = collections.defaultdict(list)
    for x in {x for *_, x in every}:
        by_size[len(x)].append(x)
    links = []
    for n in sorted(by_size):
        for more in range(5):
            pairs = itertools.combinations(by_size[n], 2) if not more else itertools.product(by_size[n], by_size.get(n + more, []))
            links += [p for p in pairs if more <= line_dedup.allowed(*p, None) and line_dedup.within(*p, line_dedup.allowed(*p, None))]
    of, n, first = union(links, sorted({x for *_, x in every})), collections.Counter(x for p in links for x in p), {}
    for d, i, x in every:
        first.setdefault(of[x], (d, i))
    return {(d, i): (*first[of[x]], n[x]) for d, i, x in every}


def test_op3(spark, texts):
    rows = queries.QUERIES["op3_line_dedup"](spark, DATA).collect()
    want = line_wanted(texts)
    assert {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.n_links) for r in rows} == want and len(rows) == len(want)
    assert all(r.kept == ((r.doc_id, r.line_no) == (r.class_doc_id, r.class_line_no)) for r in rows)


def test_op4(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = queries.QUERIES["op4_best_fit_packing"](spark, DATA).collect()
    want = []
    for d, t in texts.items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want += [(d, j, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for j, (a, b) in enumerate(itertools.pairwise(cuts))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    assert all(sorted(o for o, _ in b) == [0, *itertools.accumulate(n for _, n in sorted(b))][:-1] and sum(n for _, n in b) <= 2048 for b in bins.values())
    assert len(bins) <= 1.03 * sum(r.length for r in rows) / 2048 + 2


def test_both_tokenizers_read_common_texts_alike():
    slow, fast, _ = packing.Tokenizers.of(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = np.random.RandomState(4)
    common_ = [chr(c) for c in range(0x2122 + 1) if not packing._COMMON.search(chr(c))]
    for _ in range(4000):
        t = "".join(rng.choice(common_ if rng.rand() < 0.5 else list("ab 1'\n\t.süéß"), rng.randint(1, 25)))
        assert slow.encode(t, add_special_tokens=False).ids == fast.encode(t, allowed_special=set(), disallowed_special=()), repr(t)


def test_op5_and_op9(spark, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {d: sp.encode(t or "") for d, t in texts.items()}
    rows = queries.QUERIES["op5_sentencepiece"](spark, DATA).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in rows} == {d: (len(x), zlib.crc32(np.array(x, "<i4").tobytes())) for d, x in want.items()}
    assert all(r.round_trip for r in rows if "▁" not in (texts[r.doc_id] or ""))
    rows = queries.QUERIES["op9_token_counts"](spark, DATA).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {d: (len((texts[d] or "").encode()), len(x), len(x) > 4096) for d, x in want.items()}


def test_op10(spark, texts):
    rows = queries.QUERIES["op10_secret_scans"](spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = base_spans(texts[r.doc_id] or "")
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in found) for i in range(3)]
        assert {f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found} <= set(r.spans.split(",")) | {""}


def test_many_secrets_in_one_text(spark):
    text = "token=abcdefghijklmn " * 3000
    row = secret_scans.digest(secret_scans.secret_scan(documents(spark, [text]))).first()
    assert row.n_assign == 3000 and row.spans.startswith("assign:0:20,assign:21:41,") and row.spans.endswith(f"assign:{21 * 2999}:{21 * 2999 + 20}")


def test_an_owner_with_many_repositories_and_one_with_few(spark):
    rows = [(i, f"key Zx9{'aB3' * 10}", f"r{i}", "o") for i in range(4)] + [(10 + i, f"key Yw8{'cD4' * 10}", f"q{i}", "p") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, repository string, source string")
    found = {r.doc_id: r.spans for r in secret_scans.digest(secret_scans.secret_scan(df, repository="repository")).collect()}
    assert all("owned" in found[i] for i in range(4)) and not any("owned" in found[10 + i] for i in range(9))


# --- quality classifier ---------------------------------------------------------------------------


def plain_votes(text):
    """Measures and votes of one text, word by word."""
    w = [x.encode() for x in WORD.findall(text)]
    raw = text.encode()
    n = len(w)
    some = max(n, 1)
    symbols = set(b"#*$%&|<>{}\\^~=_@")
    stop = {x.lower().encode() for x in quality_classifier.STOP_WORDS} | {x.encode() for x in quality_classifier.STOP_WORDS}
    low = [lower(x.decode()).encode() for x in w]
    grams = [tuple(w[i : i + 3]) for i in range(n - 2)] or ([tuple(w)] if w else [])
    m = [
        sum(b in symbols for b in raw) / some, sum(65 <= b <= 90 for b in raw) / max(sum(map(len, w)), 1), 1 - sum(x in stop for x in low) / some, 1 - len(set(low)) / some,
        1 - len(set(grams)) / max(n - 2, 1), sum(map(len, w)) / some, sum(x[-1:] in (b"!", b"|") or x[-1] in symbols for x in w) / some,
    ]
    votes = [1 if n < 5 else 0 if x > high else 2 if x < least else 1 for x, (least, high) in zip(m, quality_classifier.BOUNDS.tolist(), strict=True)]
    return m, votes, low, w


def plain_em(patterns, rounds=60):
    good = {p: 1 / (1 + math.exp(-2.0 * sum(v - 1 for v in p))) for p in patterns}
    for _ in range(rounds):
        share = [sum(n * (1 - good[p]) for p, n in patterns.items()) + 1, sum(n * good[p] for p, n in patterns.items()) + 1]
        right = {}
        for j, c in itertools.product(range(7), range(2)):
            table = [1.0] * 3
            for p, n in patterns.items():
                table[p[j]] += n * (good[p] if c else 1 - good[p])
            right[j, c] = [x / sum(table) for x in table]
        new = {}
        for p in patterns:
            logs = [math.log(share[c] / sum(share)) + sum(math.log(right[j, c][p[j]]) for j in range(7) if p[j] != 1) for c in range(2)]
            new[p] = 1 / (1 + math.exp(min(max(logs[0] - logs[1], -50), 50)))
        good = new
    return good


def plain_scores(texts, posterior):
    """Scores of a logistic scorer fitted row by row."""
    half = quality_classifier.BUCKETS // 2
    hashed = lambda x: int(common.span_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0])
    rows = []
    for t in texts:
        m, votes, low, w = plain_votes(t)
        count = collections.Counter()
        for a, b in zip(low, w, strict=True):
            count[hashed(a) % half] += 1
            shape = re.sub(rb"(.)\1+", rb"\1", bytes(quality_classifier._SHAPE[np.frombuffer(b, np.uint8)].tolist()), flags=re.S)
            count[half + int(common.mix(np.array([hashed(shape)], np.uint64))[0]) % half] += 1
        x = {k: float(np.float32(v / max(len(w), 1))) for k, v in count.items()}
        x |= {quality_classifier.BUCKETS + 8 * j + int(min(v / high * 4, 7)): 1.0 for j, (v, (_, high)) in enumerate(zip(m, quality_classifier.BOUNDS.tolist(), strict=True))}
        x[quality_classifier.N_WEIGHTS - 1] = 1.0
        rows.append((x, posterior[tuple(votes)], len(w)))
    share = min(max(sum(p for _, p, _ in rows) / len(rows), 0.02), 0.98)
    weights, seen = collections.defaultdict(float), collections.defaultdict(lambda: 1e-8)
    logistic = lambda z: 1 / (1 + math.exp(-min(max(z, -50), 50)))
    for _ in range(quality_classifier.ROUNDS):
        slope = collections.defaultdict(float)
        for x, p, _ in rows:
            error = (logistic(sum(weights[k] * v for k, v in x.items())) - p) * (0.5 / share if p > 0.5 else 0.5 / (1 - share))
            for k, v in x.items():
                slope[k] += error * v / len(rows)
        for k in slope:
            g = slope[k] + 1e-5 * weights[k]
            seen[k] += g * g
            weights[k] -= 0.3 * g / math.sqrt(seen[k])
    return [logistic(sum(weights[k] * v for k, v in x.items())) if n else 1.0 for x, _, n in rows]


def test_op6_against_plain_em_and_scorer(spark, texts):
    own = [t for _, t in sorted(texts.items()) if t and len(t) < 4000][:60] + ["", " ", "a b", "a b"]
    patterns = collections.Counter(tuple(plain_votes(t)[1]) for t in own)
    posterior = plain_em(patterns)
    want = plain_scores(own, posterior)
    rows = {r.doc_id: r for r in quality_classifier.quality_classifier(documents(spark, own)).collect()}
    for i, t in enumerate(own):
        votes = plain_votes(t)[1]
        assert rows[i].pattern == sum(v * 3**j for j, v in enumerate(votes)), t
        assert rows[i].posterior == pytest.approx(posterior[tuple(votes)], abs=1e-9)
        assert rows[i].score == pytest.approx(want[i], abs=1e-4) and rows[i].kept == (rows[i].score >= 0.5)


def test_op6_whole_table(spark, texts):
    rows = queries.QUERIES["op6_quality_classifier"](spark, DATA).collect()
    posterior = plain_em(collections.Counter(tuple(plain_votes(t or "")[1]) for t in texts.values()))
    assert len(rows) == len(texts)
    assert all(r.posterior == pytest.approx(posterior[tuple(plain_votes(texts[r.doc_id] or "")[1])], abs=1e-9) for r in rows)


# --- others ---------------------------------------------------------------------------------------


def test_topk_takes_empty_vectors_and_many_blocks(spark, monkeypatch):
    empty = spark.createDataFrame([(0, []), (1, []), (100, [])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, exact_topk.exact_topk(empty, empty.where("vec_id % 100 = 0")).collect())) == [(0, 1, 1, 0), (0, 2, 100, 0), (100, 1, 0, 0), (100, 2, 1, 0)]
    monkeypatch.setattr(exact_topk, "BLOCK", 64)
    rng = np.random.RandomState(1)
    x = rng.randn(500, 5).round(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = collections.defaultdict(list)
    for r in exact_topk.exact_topk(df, df.where("vec_id % 50 = 0"), 7).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    whole = np.floor(1024 * x).astype(int)
    for q in range(0, 500, 50):
        scores = whole @ whole[q]
        assert found[q] == [(i, int(scores[i])) for i in sorted((i for i in range(500) if i != q), key=lambda i: (-scores[i], i))[:7]]


def test_a_long_list_is_dealt_to_several_cascades(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.where("cast(substring(key, 2) as int) % 3 = 1")
    c = url_filters.cascade(listed, universe, most_bits=1024)
    assert isinstance(c, url_filters.Parts) and len(c.cascades) > 1
    assert universe.where(c.listed(F.col("key")) != F.expr("cast(substring(key, 2) as int) % 3 = 1")).count() == 0


def test_op2_takes_long_urls_and_no_pages(spark):
    urls = ["http://" + "a." * 3000 + "example.com/en/" + "x" * 50_000, "http://example.net/de/8" + "/" * 20_000, None]
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, key string, host string")
    rows = {r.page_id: (r.rule, r.verdict) for r in url_filters.url_filter(df, queries.URL_RULES).collect()}
    assert rows == {0: ("com/en/", "block"), 1: ("example.net/de/8", "block"), 2: (None, "allow")}


def test_documents_in_steps_and_whole_are_the_same():
    one = [x for *x, data, offsets in common.text_steps(pa.array(TEXTS), most=16)]
    assert sum(n for _, n in one) == len(TEXTS) and [at for at, _ in one] == list(itertools.accumulate([0, *(n for _, n in one)]))[:-1]


def test_pipeline_stages_against_plain_versions(spark, texts):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    judged = {r.doc_id: r.kept for r in quality_classifier.quality_classifier(docs).collect()}
    now = common.written(stages["quality classifier"](spark, docs, DATA), "test")
    kept = {r.doc_id: r.text for r in now.collect()}
    assert kept == {d: t for d, t in texts.items() if judged[d]}
    now = common.written(stages["line dedup"](spark, now, DATA), "test")
    first, want = line_wanted(kept), {}
    for d, t in kept.items():
        lines = t.split("\n") if t is not None else []
        left = [x for i, x in enumerate(lines) if (d, i) not in first or first[d, i][:2] == (d, i)]
        if t is None or len(left) == len(lines):
            want[d] = t
        elif "\n".join(left):
            want[d] = "\n".join(left)
    lined = {r.doc_id: r.text for r in now.collect()}
    assert lined == want
    now = common.written(stages["near dedup"](spark, now, DATA), "test")
    order = sorted(lined)
    single = {r.doc_id: r.text for r in now.collect()}
    assert single == {order[i]: lined[order[i]] for i, _, _, keep in near_wanted([lined[d] for d in order], 5) if keep}
    now = common.written(stages["secret scans"](spark, now, DATA), "test")
    clean = {r.doc_id: r.text for r in now.collect()}
    assert clean.keys() == single.keys()
    for d, t in single.items():
        assert not base_spans(clean[d] or "") and (base_spans(t or "") or "[secret]" in (clean[d] or "") or clean[d] == t)
    rows = stages["packing"](spark, now, DATA).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        ids[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert ids == {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in clean.items()}


def test_pipeline_leaves_its_result_alone(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(30)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before = common.tables_so_far()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0 and common.tables_so_far() == before + 1
