"""Hard negatives from vantage-point trees over norm-augmented vectors.

A vector x gets one more component, sqrt(M^2 - |x|^2), an anchor q gets 0 there: then |x - q|^2 is
M^2 + |q|^2 - 2 x.q, so a window of scores is an annulus of distances around the anchor and higher
scores are nearer. Tasks gather their rows into blocks and build a tree over each; anchors are held by
the tasks, some at a time, and walk a tree nearest subtree first. A subtree is left out if it lies
outside of every annulus that still asks, or behind what they have found. Distances only steer the
walk, with some slack; whole-number scores decide.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import turns, written

#: Rows of a tree, rows of a leaf, and anchors that are asked at a time.
BLOCK = 1 << 13
LEAF = 128
TURN = 4096
#: Part of M that a distance may be off by rounding.
SLACK = 1e-6


class VantageTree:
    """Tree over whole-number vectors with ids and labels; rows of a subtree stand side by side."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        norms = np.einsum("ij,ij->i", x, x)
        self.most = float(norms.max())
        aside = np.sqrt(self.most - norms)
        order = np.arange(len(ids))
        #: Of each node: rows from and to, its two children.
        self.nodes: list[tuple[int, int, int, int]] = []
        #: And its vantage row (augmented), how far its rows are from that at most, and the shell around the vantage row above.
        points, reach, above_, near, far = [], [], [], [], []
        todo = [(0, len(ids), -1, 0.0, np.inf)]
        while todo:
            low, high, above, least, most = todo.pop()
            own = order[low:high]
            # The row farthest from the first one lies at the rim, where shells are thin.
            p = own[int(np.argmin(x[own] @ x[own[0]] + aside[own] * aside[own[0]]))]
            away = np.sqrt(np.maximum(2 * self.most - 2 * (x[own] @ x[p] + aside[own] * aside[p]), 0))
            node = len(self.nodes)
            points.append(np.append(x[p], aside[p]))
            reach.append(float(away.max()))
            above_.append(max(above, 0))
            near.append(least)
            far.append(most)
            self.nodes.append((low, high, -1, -1))
            if above >= 0:
                a, b, left, right = self.nodes[above]
                self.nodes[above] = (a, b, node, right) if left < 0 else (a, b, left, node)
            if high - low > LEAF:
                half = (high - low) // 2
                by = np.argpartition(away, half)
                order[low:high], away = own[by], away[by]
                todo += [(low + half, high, node, float(away[half]), float(away.max())), (low, low + half, node, float(away.min()), float(away[:half].max()))]
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.points, self.above = np.array(points), np.array(above_)
        self.reach, self.near, self.far = np.array(reach), np.array(near), np.array(far)

    def nearest_first(self, query: np.ndarray) -> Iterator[tuple[float, float, int]]:
        """Leaves as (least and most possible distance, node), nearest first."""
        away = np.sqrt(np.maximum(self.most + float(query @ query) - 2 * (self.points[:, :-1] @ query), 0))
        round_ = away[self.above]
        least = np.maximum.reduce([away - self.reach, self.near - round_, round_ - self.far, np.zeros(len(away))])
        most = np.minimum(away + self.reach, round_ + self.far)
        slack = SLACK * (1 + self.most**0.5)
        heap = [(least[0] - slack, 0)]
        while heap:
            distance, node = heapq.heappop(heap)
            _, _, left, right = self.nodes[node]
            if left < 0:
                yield distance, most[node] + slack, node
                continue
            for child in (left, right):
                heapq.heappush(heap, (max(distance, least[child] - slack), child))


class Best:
    """The k best rows (score, then smaller id) of each window of one anchor."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.scores = [np.zeros(0, np.int64) for _ in low]
        self.ids = [np.zeros(0, np.int64) for _ in low]

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        for w in range(len(self.low)):
            inside = (scores >= self.low[w]) & (scores <= self.high[w])
            if len(self.ids[w]) == self.k:
                inside &= scores >= self.scores[w][-1]
            if inside.any():
                s, i = np.append(self.scores[w], scores[inside]), np.append(self.ids[w], ids[inside])
                order = np.lexsort((i, -s))[: self.k]
                self.scores[w], self.ids[w] = s[order], i[order]

    def asks(self, above: float, below: float) -> bool:
        """Whether a window still takes rows with scores up to ``above`` and from ``below`` on."""
        for w in range(len(self.low)):
            least = self.scores[w][-1] if len(self.ids[w]) == self.k else self.low[w]
            if least <= above and self.high[w] >= below:
                return True
        return False

    def least(self) -> float:
        """Scores below this one are of no use to any window."""
        return min((self.scores[w][-1] if len(self.ids[w]) == self.k else self.low[w]) for w in range(len(self.low)))


def _walk(tree: VantageTree, anchor: int, label: int, query: np.ndarray, best: Best, same: bool) -> None:
    base = tree.most + float(query @ query)
    for distance, most, node in tree.nearest_first(query):
        above, below = (base - max(distance, 0) ** 2) / 2 + 1, (base - most**2) / 2 - 1
        if best.least() > above:
            return
        if not best.asks(above, below):
            continue
        low, high, _, _ = tree.nodes[node]
        fits = (tree.labels[low:high] == label) == same
        fits &= tree.ids[low:high] != anchor
        i = np.flatnonzero(fits) + low
        # Squared norms below 2^53 make every sum of products a whole number that doubles hold.
        best.add(tree.ids[i], (tree.x[i] @ query).astype(np.int64))


class Anchors:
    """Anchors of a turn, in order of ids, with the windows of scores that each asks for."""

    def __init__(self, rows: pa.Table):
        order = np.argsort(rows.column("vec_id").to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        self.ids, self.labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        self.x = _floats(rows.column("x").combine_chunks())
        self.windows: list[tuple[np.ndarray, np.ndarray]] = [(np.array([-(1 << 62)]), np.array([1 << 62]))] * len(self.ids)
        self.positives: list[tuple[np.ndarray, np.ndarray]] = []

    def ask(self, positives: pa.Table, percent: int) -> None:
        """Windows from ``percent`` of the scores of an anchor's positives up to these."""
        anchor, positive, score = (positives.column(c).to_numpy() for c in ("anchor_id", "positive_id", "score"))
        order = np.lexsort((positive, -score, anchor))
        anchor, positive, score = anchor[order], positive[order], score[order]
        cuts = np.searchsorted(anchor, self.ids, "left"), np.searchsorted(anchor, self.ids, "right")
        self.positives = [(positive[a:b], score[a:b]) for a, b in zip(*cuts, strict=True)]
        self.windows = [(-(-percent * s // 100), s) for _, s in self.positives]


def _floats(column: pa.ListArray) -> np.ndarray:
    """Rows of vectors as one array; shorter ones end with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), max(1, int(sizes.max(initial=0)))))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _asked(rows: DataFrame, anchors: Anchors, k: int, same: bool) -> DataFrame:
    """anchor_id, window, vec_id, score: from each task the k best rows of every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(low, high, k) for low, high in anchors.windows]

        def searched(held: list[pa.RecordBatch]) -> None:
            block = pa.Table.from_batches(held)
            x = _floats(block.column("x").combine_chunks())
            width = max(x.shape[1], anchors.x.shape[1])
            x, queries = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (x, anchors.x))
            tree = VantageTree(block.column("vec_id").to_numpy(), block.column("label").to_numpy(), x)
            for i in range(len(queries)):
                if len(best[i].low):
                    _walk(tree, anchors.ids[i], anchors.labels[i], queries[i], best[i], same)

        held, n = [], 0
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                if held and n + len(part) > BLOCK:
                    searched(held)
                    held, n = [], 0
                held.append(part)
                n += len(part)
        if n:
            searched(held)
        sizes = [(i, w, len(b.ids[w])) for i, b in enumerate(best) for w in range(len(b.low))]
        times = np.array([s for *_, s in sizes], np.int64)
        columns = [np.repeat(anchors.ids[[i for i, *_ in sizes]] if sizes else np.zeros(0, np.int64), times), np.repeat(np.array([w for _, w, _ in sizes], np.int32), times)]
        columns += [np.concatenate([np.zeros(0, np.int64), *(v for b in best for v in getattr(b, c))]) for c in ("ids", "scores")]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "window", "vec_id", "score"])

    return rows.mapInArrow(run, "anchor_id long, window int, vec_id long, score long")


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Scores are inner products of floor(scale * x), ties go to the smaller id. An anchor's positives are
    its best other rows of the same label; for each, the best rows of different labels are returned
    whose score is at least ``percent`` of the positive's and at most that. All if there are fewer.

    Rows with a null id, label or vector, or with a null or non-finite component take no part; shorter
    and empty vectors end with zeros; repeated rows are candidates each, but a positive is asked for once
    and an anchor too, by its least label and vector. Rows with the anchor's id aren't its candidates.
    Other columns are left out, whatever they are called; no rows or no anchors give no rows. A vector
    whose squared norm is beyond 2^53 stops the job, as scores would no longer be exact.
    """

    def usable(df: DataFrame) -> DataFrame:
        x = F.transform(F.col(embedding), lambda v: F.floor(v.cast("double") * scale).cast("double"))
        odd = F.exists(F.col(embedding), lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
        own = df.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(embedding).isNotNull()).where(~odd)
        own = own.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), x.alias("x"))
        norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
        return own.where(F.when(norm < 2.0**53, True).otherwise(F.raise_error(F.lit("a vector is too long for exact scores")).cast("boolean")))

    rows = written(usable(vectors), "vectors")
    asked = written(usable(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("best")).select("vec_id", "best.*"), "anchors")
    out = None
    for turn in turns(asked, "vec_id", TURN):
        now = Anchors(turn)
        order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
        found = _asked(rows, now, positives, same=True).withColumn("r", F.row_number().over(order)).where(F.col("r") <= positives)
        now.ask(found.select("anchor_id", F.col("vec_id").alias("positive_id"), "score").distinct().toArrow(), percent)
        pairs = [(int(a), w, int(p), int(s)) for a, (own, scores) in zip(now.ids, now.positives, strict=True) for w, (p, s) in enumerate(zip(own, scores, strict=True))]
        pairs = vectors.sparkSession.createDataFrame(pairs, "anchor_id long, window int, positive_id long, positive_score long")
        order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
        found = _asked(rows, now, negatives, same=False).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        part = written(found.join(F.broadcast(pairs), ["anchor_id", "window"]), "negatives")
        out = part if out is None else out.unionByName(part)
    columns = ["anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")]
    if out is None:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out.select(*columns)
