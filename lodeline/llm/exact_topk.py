"""Exact top-k search by inner product over a bit-sliced index.

A block of vectors keeps, for each attribute, the highest bits of its values as bitmaps over rows. A
query adds these bitmaps, weighted by its own components, with carry-save bitmap arithmetic; the sums
stay bit-sliced. Walking from the most significant slice down gives the k-th highest sum, rows that
the low bits left out could lift past it are the boundary, and their exact scores decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates of a block, and queries that are asked of it at a time.
BLOCK = 1 << 13
QUERIES = 1 << 10
#: Highest bits of each attribute that are sliced.
SLICED = 6


class BitSlicedIndex:
    """Bitmaps of a block of integer vectors (rows x attributes)."""

    def __init__(self, vectors: np.ndarray, sliced: int = SLICED):
        self.vectors = vectors
        self.rows = len(vectors)
        self.low = vectors.min(0)
        above = vectors - self.low
        self.most = above.max(0)
        bits = max(1, int(self.most.max()).bit_length())
        self.shift = max(0, bits - sliced)
        self.sliced = bits - self.shift
        self.full = (1 << bits) - 1
        pad = -self.rows % 64
        high = np.pad(above >> self.shift, ((0, pad), (0, 0)))
        planes = (high[None] >> np.arange(self.sliced)[:, None, None]) & 1
        packed = np.packbits(planes.astype(np.uint8), axis=1, bitorder="little")
        self.slices = np.ascontiguousarray(packed.transpose(2, 0, 1)).view(np.uint64)
        valid = np.zeros(self.rows + pad, np.uint8)
        valid[: self.rows] = 1
        self.valid = np.packbits(valid, bitorder="little").view(np.uint64)

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of the sum of |component| times the attribute's high bits, complemented where it is negative."""
        columns: list[list[np.ndarray]] = []
        for attribute, weight in enumerate(query.tolist()):
            rest = abs(weight)
            planes = self.slices[attribute]
            if weight < 0:
                planes = ~planes & self.valid
            place = 0
            while rest:
                if rest & 1:
                    while len(columns) < place + self.sliced:
                        columns.append([])
                    for b in range(self.sliced):
                        columns[place + b].append(planes[b])
                rest >>= 1
                place += 1
        out, place = [], 0
        while place < len(columns):
            own = columns[place]
            carries = []
            while len(own) > 2:
                fresh = []
                for i in range(0, len(own) - 2, 3):
                    x, y, z = own[i : i + 3]
                    half = x ^ y
                    fresh.append(half ^ z)
                    carries.append((x & y) | (half & z))
                own = fresh + own[len(own) - len(own) % 3 :]
            if len(own) == 2:
                carries.append(own[0] & own[1])
                own = [own[0] ^ own[1]]
            if carries:
                if place + 1 == len(columns):
                    columns.append([])
                columns[place + 1].extend(carries)
            out.append(own[0] if own else np.zeros_like(self.valid))
            place += 1
        return out

    def boundary(self, query: np.ndarray, k: int, allowed: np.ndarray) -> np.ndarray:
        """Rows of ``allowed`` (a bitmap) that can be among its k best."""
        count = int(np.bitwise_count(allowed).sum())
        if count <= k:
            return self._rows(allowed)
        sums = self.sums(query)
        above, equal, value = np.zeros_like(allowed), allowed, 0
        for place in reversed(range(len(sums))):
            higher = equal & sums[place]
            if int(np.bitwise_count(above | higher).sum()) >= k:
                equal, value = higher, value | 1 << place
            else:
                above, equal = above | higher, equal & ~sums[place]
        # Low bits left out lift a sum by less than 2 ** shift for each unit of weight.
        least = value - (((1 << self.shift) - 1) * int(np.abs(query).sum()) >> self.shift)
        if least <= 0:
            return self._rows(allowed)
        above, equal = np.zeros_like(allowed), allowed
        for place in reversed(range(len(sums))):
            if least >> place & 1:
                equal = equal & sums[place]
            else:
                above, equal = above | (equal & sums[place]), equal & ~sums[place]
        return self._rows(above | equal)

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.rows])


def _floored(column: pa.ListArray, width: int) -> np.ndarray:
    """Components as whole numbers, ``width`` of each row; shorter vectors end with zeros."""
    out = np.zeros((len(column), width), np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), sizes)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    use = at < width
    out[row[use], at[use]] = values[use]
    return np.floor(1024 * out)


class Block:
    """Candidates of one block: ids, whole numbers, and the index once a query asks for it."""

    def __init__(self, rows: list[pa.RecordBatch]):
        ids = pa.chunked_array([r.column(2) for r in rows]).to_numpy()
        vectors = pa.chunked_array([r.column(3) for r in rows]).combine_chunks()
        self.ids = ids.astype(np.int64)
        self.x = _floored(vectors, max(1, int(np.diff(vectors.offsets.to_numpy()).max())))
        self.most = max(1.0, float(np.abs(self.x).max()))
        self.index: BitSlicedIndex | None = None
        self.whole = None

    def best(self, asked: pa.RecordBatch, k: int) -> tuple[list, list, list]:
        q = _floored(asked.column(3), self.x.shape[1])
        out: tuple[list, list, list] = ([], [], [])
        small = self.most * max(1.0, float(np.abs(q).max())) * self.x.shape[1] < 2.0**61
        if small and self.index is None:
            self.whole = self.x.astype(np.int64)
            self.index = BitSlicedIndex(self.whole)
        for own, query in zip(asked.column(2).to_pylist(), q.astype(np.int64) if small else q, strict=True):
            if small:
                others = np.zeros(len(self.index.valid) * 64, np.uint8)
                others[: len(self.ids)] = self.ids != own
                rows = self.index.boundary(query, k, np.packbits(others, bitorder="little").view(np.uint64))
                score = self.whole[rows] @ query
                order = np.lexsort((self.ids[rows], -score))[:k]
            else:
                # Whole numbers beyond 64 bits: exact, without the index; scores are held to the range of long.
                rows = np.flatnonzero(self.ids != own)
                exact = [sum(int(a) * int(b) for a, b in zip(v, query, strict=True)) for v in self.x[rows]]
                score = np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in exact], np.int64)
                order = np.lexsort((self.ids[rows], -score.astype(object)))[:k]
            out[0].extend([own] * len(order))
            out[1].extend(self.ids[rows][order].tolist())
            out[2].extend(score[order].tolist())
        return out


def _block(n: int) -> Column:
    """One of n blocks for each row of a table, whatever its id: rows that share one are dealt out too."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products of floor(1024 * x), ties to the smaller id.

    Candidates are all rows but those with the query's own id. Vectors that are null, hold null or
    non-finite components, or have no id, take no part; shorter and empty ones end with zeros; repeated
    rows are candidates each, but a query id is asked once, by its least vector; scores beyond the range
    of long are held to it; other columns of any name are left out; no vectors or no queries give no rows.

    Candidates are shuffled once, into blocks of bounded size. The queries stream by each block behind
    its candidates, in bounded batches, and only k rows a query leave it.
    """

    def usable(df: DataFrame) -> DataFrame:
        x = F.transform(F.col(embedding), lambda v: v.cast("double"))
        odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        return df.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(~odd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for batch in batches:
            of, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(of) != 0) | (np.diff(asks) != 0)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                if of[low] != now:
                    now, held, block = of[low], [], None
                if not asks[low]:
                    held.append(part)
                    continue
                if block is None and held:
                    block, held = Block(held), []
                if block is not None:
                    for at in range(0, len(part), QUERIES):
                        found = block.best(part.slice(at, QUERIES), k)
                        yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], ["query_id", "vec_id", "score"])

    candidates = usable(vectors)
    asked = usable(queries).groupBy("vec_id").agg(F.min("x").alias("x"))
    n = max(1, -(-candidates.count() // BLOCK))
    left = candidates.select(_block(n).alias("block"), F.lit(0).alias("asks"), "vec_id", "x")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.lit(1).alias("asks"), "vec_id", "x")
    rows = left.unionByName(right).repartition(n, "block").sortWithinPartitions("block", "asks")
    met = rows.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
