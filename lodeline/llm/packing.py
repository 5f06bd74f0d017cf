"""Best-fit packing by sums of squares: documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Pieces and bytes that are packed together; sequences less than LOOSE full are packed again with others'.
GROUP = 20_000
BLOCK_BYTES = 48 << 20
LOOSE = 0.97
#: Scripts in which both libraries split words alike; a text with anything else takes the slower library.
_COMMON = re.compile("[^\x00-ʯͰ-ϿЀ-ӿ‐-‧‰-⁞€™]")


class Tokenizers:
    """Per Python worker, kept between tasks."""

    held: dict = {}

    @classmethod
    def of(cls, json_path: str, ranks_path: str | None, pattern: str | None):
        key = (json_path, ranks_path)
        if key not in cls.held:
            from tokenizers import Tokenizer

            slow, fast = Tokenizer.from_file(json_path), None
            if ranks_path:
                import base64

                import tiktoken

                with open(ranks_path, "rb") as f:
                    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
                fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            special = [t.content for t in slow.get_added_tokens_decoder().values()]
            cls.held[key] = (slow, fast, special)
        return cls.held[key]


def token_pieces(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, size: int = 2048, end: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length and ids (unsigned 32-bit, little-endian).

    A document is its ids with ``end`` behind; one of more than ``size`` is cut so that only its first
    piece may be shorter. A null text is empty: one piece that is ``end`` alone. ``ranks_path`` names
    the same vocabulary for a faster library, taken for texts that both read alike. Repeated rows and
    null ids are cut each, other columns of any name are left out, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slow, fast, special = Tokenizers.of(json_path, ranks_path, pattern)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for low in range(0, len(batch), 256):
                rows, piece, start, length, ids = [], [], [], [], []
                for i, t in enumerate(texts.slice(low, 256).to_pylist()):
                    t = t or ""
                    if fast is not None and not _COMMON.search(t) and not any(s in t for s in special):
                        own = np.asarray(fast.encode_to_numpy(t, allowed_special=set(), disallowed_special=()), "<u4")
                    else:
                        own = np.asarray(slow.encode(t, add_special_tokens=False).ids, "<u4")
                    own = np.append(own, np.array([end], "<u4"))
                    cuts = [0, *range(len(own) % size or size, len(own) + 1, size)]
                    for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append(low + i)
                        piece.append(j)
                        start.append(a)
                        length.append(b - a)
                        ids.append(own[a:b].tobytes())
                yield pa.RecordBatch.from_arrays([names.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def sum_of_squares(lengths: np.ndarray, size: int) -> np.ndarray:
    """The sequence of each length, in the order given: where the squared counts of open sequences by fill grow least.

    Of equal choices the fullest sequence takes the piece, a new one last.
    """
    count = np.zeros(size + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(size + 1)]
    out = np.empty(len(lengths), np.int64)
    fresh = 0
    for i, n in enumerate(lengths.tolist()):
        # By fill before: moving a sequence from h to h + n changes the sum by 2 * (count[h + n] - count[h] + 1).
        after = 2 * count[n : size + 1] + 1
        after[-1] = 0
        before = count[: size + 1 - n]
        change = after - 2 * before + 1
        change[0] = after[0]
        change[1:][before[1:] == 0] = np.iinfo(np.int64).max
        h = len(change) - 1 - int(np.argmin(change[::-1]))
        if h:
            bin_ = open_at[h].pop()
            count[h] -= 1
        else:
            bin_, fresh = fresh, fresh + 1
        out[i] = bin_
        if h + n < size:
            open_at[h + n].append(bin_)
            count[h + n] += 1
    return out


def _placed(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, offset and the whole sequence's tokens of each length, packed longest first; more than ``size`` is a sequence of its own."""
    order = np.argsort(-lengths, kind="stable")
    over = int((lengths > size).sum())
    seq = np.empty(len(lengths), np.int64)
    seq[order[:over]] = np.arange(over)
    seq[order[over:]] = over + sum_of_squares(lengths[order[over:]], size)
    fill = np.bincount(seq, lengths).astype(np.int64)
    at = order[np.argsort(seq[order], kind="stable")]
    ends = np.cumsum(lengths[at])
    offset = np.empty(len(lengths), np.int64)
    offset[at] = ends - lengths[at] - (np.cumsum(fill) - fill)[seq[at]]
    return seq, offset, fill[seq]


def packed(pieces: DataFrame, size: int = 2048, group: int = GROUP) -> DataFrame:
    """The pieces (a length and any other columns) with sequence_id and offset.

    Each task packs its own pieces in blocks of ``group`` or BLOCK_BYTES, longest first, so that they
    are not shuffled. Sequences that end less than LOOSE full are packed once more, dealt into groups
    by a hash of their place. Both rounds are tasks of bounded size; no length, not even a very common
    one, meets in one task. Repeated rows and null ids are packed each, a null length takes no room, a
    piece longer than ``size`` is alone in its sequence, columns named like the new ones are replaced,
    and an empty table gives no rows.
    """
    pieces = pieces.drop("sequence_id", "offset", "fill")
    fields, at = pieces.columns, pieces.columns.index("length")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema), "sequence_id long", "offset long", "fill long"])

    def block(held: list[pa.RecordBatch], base: int) -> tuple[pa.Table, int]:
        rows = pa.Table.from_batches(held)
        seq, offset, fill = _placed(rows.column(at).fill_null(0).to_numpy().astype(np.int64), size)
        for name, value in (("sequence_id", base + seq), ("offset", offset), ("fill", fill)):
            rows = rows.append_column(name, pa.array(value, pa.int64()))
        return rows, base + int(seq.max()) + 1

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 34
        held: list[pa.RecordBatch] = []
        rows = n_bytes = 0
        for batch in batches:
            for low in range(0, len(batch), 1024):
                held.append(batch.slice(low, 1024))
                rows, n_bytes = rows + len(held[-1]), n_bytes + held[-1].nbytes
                if rows >= group or n_bytes >= BLOCK_BYTES:
                    done, base = block(held, base)
                    yield from done.to_batches(1024)
                    held, rows, n_bytes = [], 0, 0
        if rows:
            yield from block(held, base)[0].to_batches(1024)

    def again(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        seq, offset, fill = _placed(pdf["length"].fillna(0).to_numpy(np.int64), size)
        return pdf[fields].assign(sequence_id=(np.int64(1) << 62) | (np.int64(key[0]) << 34) | seq, offset=offset, fill=fill)

    first = written(pieces.mapInArrow(own, schema), "packed")
    loose = first.where(F.col("fill") < size * LOOSE)
    dealt = loose.withColumn("__grp", F.pmod(F.xxhash64("sequence_id", "offset"), F.lit(max(1, -(-loose.count() // group)))).cast("int"))
    second = dealt.groupBy("__grp").applyInPandas(again, schema)
    return first.where(F.col("fill") >= size * LOOSE).unionByName(second).drop("fill")
