"""Quality classifier: expectation-maximisation over overlapping heuristic labellers; their posterior trains a hashed linear scorer.

Every document gets a vote (good, bad, none) of each labeller. Patterns of votes are counted over the
whole corpus; there are at most 3 ** labellers, whatever its size. On these counts EM estimates how
often each labeller is right in each class, and so a posterior for each pattern. Documents of a
bounded sample (TRAINED) with that posterior fit a logistic scorer over hashed words and word shapes,
which then judges every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, lowered, mix, shingles, span_hashes, text_steps, word_spans
from .quality_rules import STOP_WORDS

#: Documents the scorer is fitted on, drawn at random with a fixed seed.
TRAINED = 6_000
BUCKETS = 1 << 13
ROUNDS = 150
REJECT_BELOW = 0.5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#*$%&|<>{}\\^~=_@"]] = True
#: Class of a byte in a word's shape; signs stand for themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[[*range(65, 91)]] = ord("A")
_SHAPE[[*range(97, 123), *range(128, 256)]] = ord("a")
_SHAPE[[*range(48, 58)]] = ord("0")
LABELLERS = ("symbols", "capitals", "stop words", "repeated words", "repeated windows", "word length", "endings")
#: (least, most) of each labeller's measure: bad beyond the outer bound, good within the inner one, no vote between.
BOUNDS = np.array([(0.02, 0.2), (0.15, 0.4), (0.9, 0.97), (0.6, 0.85), (0.2, 0.5), (7.5, 9.5), (0.08, 0.3)])
_stop: list[np.ndarray] = []


def _stop_hashes() -> np.ndarray:
    if not _stop:
        words = [w.encode() for w in dict.fromkeys(STOP_WORDS)]
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        _stop.append(np.sort(span_hashes(data, ends - [len(w) for w in words], ends)))
    return _stop[0]


class Features:
    """Votes and hashed features of the rows of one step."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        rows = len(offsets) - 1
        start, end, row = word_spans(data, offsets)
        n = np.bincount(row, minlength=rows).astype(np.float64)
        self.rows, self.row, self.n = rows, row, n
        some = np.maximum(n, 1)
        word = span_hashes(lowered(data), start, end)
        size = np.bincount(row, end - start, rows)
        sums = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
        capital = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
        stop = _stop_hashes()
        at = np.minimum(np.searchsorted(stop, word), len(stop) - 1)
        known = np.bincount(row, stop[at] == word, rows)
        order = np.lexsort((word, row))
        fresh = np.ones(len(word), bool)
        fresh[1:] = (row[order][1:] != row[order][:-1]) | (word[order][1:] != word[order][:-1])
        distinct = np.bincount(row[order][fresh], minlength=rows)
        windows = np.bincount(shingles(data, offsets, 3)[0], minlength=rows)
        last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
        odd = np.bincount(row, (last == ord("!")) | (last == ord("|")) | _SYMBOL[last], rows) if len(end) else np.zeros(rows)
        self.measures = np.stack([
            (sums[offsets[1:]] - sums[offsets[:-1]]) / some,
            (capital[offsets[1:]] - capital[offsets[:-1]]) / np.maximum(size, 1),
            1 - known / some,
            1 - distinct / some,
            1 - windows / np.maximum(n - 2, 1),
            size / some,
            odd / some,
        ])
        low, high = BOUNDS[:, :1], BOUNDS[:, 1:]
        votes = np.where(self.measures > high, 0, np.where(self.measures < low, 2, 1))
        # Few words say little: no vote.
        self.votes = np.where(n < 5, 1, votes)
        # Words and shapes, in halves of the buckets.
        shape = _SHAPE[data]
        new = np.ones(len(data), bool)
        new[1:] = shape[1:] != shape[:-1]
        new[start] = True
        new &= ~IS_SPACE[data]
        place = np.concatenate([[0], np.cumsum(new)])
        forms = span_hashes(shape[new], place[start], place[end])
        half = np.uint64(BUCKETS // 2 - 1)
        self.buckets = np.concatenate([(word & half).astype(np.int64), (mix(forms) & half).astype(np.int64) + BUCKETS // 2])

    def pattern(self) -> np.ndarray:
        return (self.votes * 3 ** np.arange(len(LABELLERS))[:, None]).sum(0)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Mean weight of a row's words and shapes, with its binned measures, as log-odds."""
        both = np.concatenate([self.row, self.row])
        mean = np.bincount(both, weights[self.buckets], self.rows) / np.maximum(self.n, 1)
        return mean + weights[BUCKETS + self.bins()].sum(0) + weights[-1]

    def bins(self) -> np.ndarray:
        """A bucket for each measure: its eighth of the way to twice the upper bound."""
        eighth = np.minimum(self.measures / BOUNDS[:, 1:] * 4, 7).astype(np.int64)
        return eighth + 8 * np.arange(len(LABELLERS))[:, None]


N_WEIGHTS = BUCKETS + 8 * len(LABELLERS) + 1


def accuracies(patterns: dict[int, int], rounds: int = 60) -> dict[int, float]:
    """Probability of good for each pattern of votes, by expectation-maximisation over their counts."""
    keys = sorted(patterns)
    if not keys:
        return {}
    count = np.array([patterns[k] for k in keys], np.float64)
    votes = np.array([[k // 3**j % 3 for j in range(len(LABELLERS))] for k in keys]).reshape(-1, len(LABELLERS))
    # Begin with the majority; labellers are taken to be right more often than not.
    good = 1 / (1 + np.exp(-2.0 * (votes - 1).sum(1)))
    for _ in range(rounds):
        share = np.array([(count * (1 - good)).sum(), (count * good).sum()]) + 1
        logs = np.tile(np.log(share / share.sum()), (len(keys), 1))
        for j in range(len(LABELLERS)):
            for c, weight in enumerate((1 - good, good)):
                table = np.bincount(votes[:, j], count * weight, 3) + 1
                logs[:, c] += np.where(votes[:, j] == 1, 0, np.log(table / table.sum())[votes[:, j]])
        good = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
    return dict(zip(keys, good.tolist(), strict=True))


def _fit(rows: list, posterior: dict[int, float], rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the scorer by adaptive gradient steps over the sample's sparse rows."""
    weights = np.zeros(N_WEIGHTS)
    if not rows:
        return weights
    at = np.concatenate([np.frombuffer(r["buckets"], "<i4") for r in rows])
    value = np.concatenate([np.frombuffer(r["amounts"], "<f4") for r in rows]).astype(np.float64)
    sizes = [len(r["buckets"]) // 4 for r in rows]
    row = np.repeat(np.arange(len(rows)), sizes)
    target = np.array([posterior[r["pattern"]] for r in rows])
    share = np.clip(target.mean(), 0.02, 0.98)
    balance = np.where(target > 0.5, 0.5 / share, 0.5 / (1 - share))
    seen = np.full(N_WEIGHTS, 1e-8)
    for _ in range(rounds):
        z = np.bincount(row, weights[at] * value, len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) * balance
        slope = np.bincount(at, error[row] * value, N_WEIGHTS) / len(rows) + 1e-5 * weights
        seen += slope**2
        weights -= 0.3 * slope / np.sqrt(seen)
    return weights


def quality_classifier(docs: DataFrame, trained: int = TRAINED, reject_below: float = REJECT_BELOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, pattern and posterior of the labellers, score (probability of good) and kept of every document.

    Null and empty texts have no votes and are kept: nothing speaks against them. Repeated rows and
    null ids are judged each; other columns are left out; an empty table gives no rows.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            for _, _, data, offsets in text_steps(batch.column(0)):
                total += np.bincount(Features(data, offsets).pattern(), minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["pattern", "n"])

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows, data, offsets in text_steps(batch.column(0)):
                f = Features(data, offsets)
                key = np.concatenate([f.row, f.row]) * BUCKETS + f.buckets
                key, n = np.unique(key, return_counts=True)
                of, amount = key // BUCKETS, (n / np.maximum(f.n, 1)[key // BUCKETS]).astype("<f4")
                cuts = np.searchsorted(of, np.arange(rows + 1))
                bins = (BUCKETS + f.bins()).astype("<i4").T
                rest = np.ones(len(LABELLERS) + 1, "<f4").tobytes()
                last = np.array([N_WEIGHTS - 1], "<i4").tobytes()
                buckets = [(key[a:b] % BUCKETS).astype("<i4").tobytes() + bins[i].tobytes() + last for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                amounts = [amount[a:b].tobytes() + rest for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(f.pattern(), pa.int64()), pa.array(buckets, pa.binary()), pa.array(amounts, pa.binary())], ["pattern", "buckets", "amounts"])

    counts = {r["pattern"]: r["n"] for r in own.select("text").mapInArrow(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    posterior = accuracies(counts)
    total = sum(counts.values())
    drawn = own.select("text").where("text is not null")
    drawn = drawn.sample(trained / total, seed=11) if total > trained else drawn
    weights = _fit(drawn.mapInArrow(sparse, "pattern long, buckets binary, amounts binary").limit(2 * trained).collect(), posterior)
    of = docs.sparkSession.sparkContext.broadcast((weights, posterior))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, posterior = of.value
        for batch in batches:
            for at, rows, data, offsets in text_steps(batch.column(1)):
                f = Features(data, offsets)
                pattern = f.pattern()
                score = np.where(f.n > 0, 1 / (1 + np.exp(-np.clip(f.scores(weights), -50, 50))), 1.0)
                given = np.array([posterior.get(p, 0.5) for p in pattern.tolist()], np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), pa.array(pattern, pa.int64()), pa.array(given, pa.float64()), pa.array(score, pa.float64())], ["doc_id", "pattern", "posterior", "score"])

    kind = own.schema["doc_id"].dataType.simpleString()
    judged = own.mapInArrow(judge, f"doc_id {kind}, pattern long, posterior double, score double")
    return judged.withColumn("kept", F.col("score") >= reject_below)
