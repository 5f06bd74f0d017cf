"""Ranked lexical search as a blocked sparse matrix product.

Documents are indexed once: each task turns its documents into blocks of a term-document matrix (terms,
and for each its documents and how often it stands there), without a shuffle. Items are asked some at
a time. A block's rows of asked terms become int64 impacts, and each row of the item-term matrix merges
the impact rows of its terms (Gustavson's order) in one dense row over the block's documents. Best
rows are kept while blocks go by, so a task hands on k rows an item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lowered, span_hashes, text_steps, turns, written

#: Bytes of text of a block (a longer document is a block of its own).
BLOCK_BYTES = 4 << 20
#: Entries of the item-term matrix that are asked at a time; every task holds them.
TURN = 1 << 18
#: Fixed values of the score: share of a document's length in percent, saturation, scale of impacts.
LENGTH_SHARE, SATURATION, SCALE, WEIGHT = 90, 8, 1_000_000, 1000

_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every term: a maximal run of letters and digits of ASCII and of all other characters, only A-Z lower-cased."""
    inside = _IN_TERM[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begin = np.flatnonzero(inside & (cut[:-1] | ~np.append(False, inside[:-1])))
    end = np.flatnonzero(inside & (cut[1:] | ~np.append(inside[1:], False))) + 1
    return np.searchsorted(offsets, begin, "right") - 1, span_hashes(lowered(data), begin, end)


def term_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The blocks: ids and lengths of documents with a term; terms, ends of their rows, and in these documents and frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, rows, data, offsets in text_steps(batch.column(1), BLOCK_BYTES):
                row, term = terms_of(data, offsets)
                length = np.bincount(row, minlength=rows)
                some = np.flatnonzero(length)
                if not len(some):
                    continue
                own = np.cumsum(length > 0) - 1
                order = np.lexsort((row, term))
                row, term = own[row[order]], term[order]
                new = np.append(True, (term[1:] != term[:-1]) | (row[1:] != row[:-1]))
                tf = np.diff(np.append(np.flatnonzero(new), len(row)))
                row, term = row[new], term[new]
                head = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
                cells = [ids.slice(at, rows).take(pa.array(some)).cast(pa.int64()).to_pylist(), length[some].tolist()]
                cells += [x.tobytes() for x in (term[head], np.append(head[1:], len(row)).astype(np.int32), row.astype(np.int32), tf.astype(np.int32))]
                kinds = [pa.list_(pa.int64())] * 2 + [pa.binary()] * 4
                yield pa.RecordBatch.from_arrays([pa.array([len(some)], pa.int64()), pa.array([int(length.sum())], pa.int64()), *(pa.array([c], k) for c, k in zip(cells, kinds, strict=True))], ["n", "l", "ids", "lengths", "terms", "ends", "docs", "tf"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(run, "n long, l long, ids array<long>, lengths array<long>, terms binary, ends binary, docs binary, tf binary")


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, term (hash) and how often the item has it; texts of one id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows, data, offsets in text_steps(batch.column(1)):
                row, term = terms_of(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows).take(pa.array(row)), pa.array(term.view(np.int64))], ["item_id", "term"])

    own = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(run, "item_id long, term long").groupBy("item_id", "term").agg(F.count("*").alias("times"))


def _frequencies(blocks: DataFrame, asked: np.ndarray) -> np.ndarray:
    """Documents that hold each of the asked terms (sorted hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(asked), np.int64)
        for batch in batches:
            for terms, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms, ends = np.frombuffer(terms, np.uint64), np.frombuffer(ends, np.int32)
                at, has = _places(terms, asked)
                df[has] += np.diff(ends, prepend=0)[at]
        i = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(df[i])], ["i", "df"])

    found = blocks.select("terms", "ends").mapInArrow(run, "i long, df long").groupBy("i").agg(F.sum("df").alias("df"))
    out = np.zeros(len(asked), np.int64)
    for row in found.toLocalIterator():
        out[row.i] = row.df
    return out


def _places(terms: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``terms`` and in ``asked`` (both sorted) of what they have in common."""
    at = np.minimum(np.searchsorted(terms, asked), len(terms) - 1)
    has = np.flatnonzero(terms[at] == asked)
    return at[has], has


class Asked:
    """Rows of the item-term matrix: sorted terms with weights, and each item's terms and multiplicities."""

    def __init__(self, rows: pa.Table, once: bool):
        item, term, times = (rows.column(c).to_numpy() for c in ("item_id", "term", "times"))
        order = np.argsort(item, kind="stable")
        self.items, item = np.unique(item[order], return_inverse=True)
        self.terms, self.term = np.unique(term[order].view(np.uint64), return_inverse=True)
        self.times = np.ones(len(order), np.int64) if once else times[order]
        self.ends = np.searchsorted(item, np.arange(len(self.items)), "right")
        self.weights = np.zeros(0, np.int64)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, ties by smaller id."""
    i = np.flatnonzero(score > 0)
    if len(i) > 4 * k:
        least = np.partition(score[i], len(i) - k)[len(i) - k]
        i = i[score[i] >= least]
    return i[np.lexsort((ids[i], -score[i]))[:k]]


def _product(blocks: DataFrame, asked: Asked, n: int, total: int, k: int) -> DataFrame:
    """item_id, doc_id, score: k rows an item from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked.items)
        for batch in batches:
            for j in range(len(batch)):
                ids, lengths = batch.column(0)[j].values, batch.column(1)[j].values.to_numpy()
                terms, ends, docs, tf = (np.frombuffer(batch.column(c)[j].as_py(), kind) for c, kind in ((2, np.uint64), (3, np.int32), (4, np.int32), (5, np.int32)))
                known = np.asarray(ids.is_valid())
                ids = ids.fill_null(0).to_numpy()
                m = 100 - LENGTH_SHARE + (LENGTH_SHARE * lengths * n) // total
                at, has = _places(terms, asked.terms)
                place = np.full(len(asked.terms), -1)
                place[has] = np.arange(len(has))
                rows = []
                for t, q in zip(at.tolist(), has.tolist(), strict=True):
                    part = slice(ends[t - 1] if t else 0, ends[t])
                    often = tf[part].astype(np.int64)
                    rows.append((docs[part], asked.weights[q] * ((1000 * SCALE * often) // (1000 * often + SATURATION * m[docs[part]]))))
                low = 0
                for i, high in enumerate(asked.ends.tolist()):
                    score = np.zeros(len(ids), np.int64)
                    for p, times in zip(place[asked.term[low:high]].tolist(), asked.times[low:high].tolist(), strict=True):
                        if p >= 0:
                            score[rows[p][0]] += times * rows[p][1]
                    low = high
                    score[~known] = 0
                    if len(best[i][0]) == k:
                        score[score < best[i][1][-1]] = 0
                    top = _best(score, ids, k)
                    if len(top):
                        own, at_score = np.append(best[i][0], ids[top]), np.append(best[i][1], score[top])
                        order = np.lexsort((own, -at_score))[:k]
                        best[i] = own[order], at_score[order]
        sizes = np.array([len(b[0]) for b in best], np.int64)
        columns = [np.repeat(asked.items, sizes), *(np.concatenate([np.zeros(0, np.int64), *(b[c] for b in best)]) for c in (0, 1))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["item_id", "doc_id", "score"])

    return blocks.select("ids", "lengths", "terms", "ends", "docs", "tf").mapInArrow(run, "item_id long, doc_id long, score long")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, once: bool = True, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k highest-scoring documents with a score above 0, ties to the smaller id.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), its impact in a document with frequency tf
    and length n weight * (10^9 tf div (1000 tf + 8 (10 + 90 n N div L))); N counts documents with a term,
    L their terms. An item counts each term once, or with ``once`` false as often as it has it.

    Null texts have no terms. Texts of one item id are one item, those without an id none; every row of
    ``docs`` is a document of its own (equal rows are ranked each), rows without an id are counted but
    not ranked. Other columns of any name are left out; empty tables give no rows. Terms are equal if
    64-bit hashes of them are.
    """
    spark = docs.sparkSession
    blocks = written(term_blocks(docs, doc_id, text), "blocks")
    n, total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    wanted = written(item_terms(items, item_id, text), "item-terms")
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for rows in turns(wanted, "item_id", TURN) if n else ():
        asked = Asked(rows, once)
        df = _frequencies(blocks, asked.terms)
        asked.weights = np.array([math.floor(WEIGHT * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        found = found.unionByName(written(_product(blocks, asked, n, total, k), "ranked"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
