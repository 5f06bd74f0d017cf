"""Token counts: a broadcast table of frequent pre-token lengths in front of worker caches; no pre-token is shuffled.

A pre-token is a run of spaces with what follows up to the next one. No piece holds a space after
another character, so the tokens of a text are those of its pre-tokens.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_steps

#: Documents whose pre-tokens are counted for the broadcast table, and its entries.
SAMPLE_DOCUMENTS = 2_000
FREQUENT = 1 << 15
#: Entries of a worker's own cache; beyond, it starts again.
CACHED = 400_000
_SPACE = 0x20
#: The character that stands for a space inside pieces.
_MARK = "▁".encode()


class Counters:
    """Per Python worker: the model and what it has encoded; kept between tasks."""

    models: dict = {}
    caches: dict = {}

    @classmethod
    def of(cls, path: str):
        if path not in cls.models:
            import sentencepiece

            cls.models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
            cls.caches[path] = {}
        return cls.models[path], cls.caches[path]


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pre-tokens of the rows as binary strings, and how many each row has; together they are the rows."""
    space = data == _SPACE
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(first)
    cuts = np.append(start, len(data)).astype(np.int64)
    units = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
    return units, np.searchsorted(start, offsets[1:], "left") - np.searchsorted(start, offsets[:-1], "left")


def _lengths(units: list[bytes], model) -> list[int]:
    """Tokens of each pre-token that stands after another one, so that its first space is its own."""
    alone = [u.decode() for u in units]
    # The library puts one space before a text; a pre-token brings it along.
    ids = model.encode([u[1:] if u[:1] == " " else u for u in alone], num_threads=1)
    return [len(x) if u != " " else 1 for u, x in zip(alone, ids, strict=True)]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document, as the SentencePiece library counts.

    Null and empty texts have no bytes and no tokens; repeated rows and null ids are counted each;
    other columns are left out. Texts that hold the library's own space mark are encoded whole.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for _, _, data, offsets in text_steps(batch.column(0)):
                counts = pc.value_counts(pre_tokens(data, offsets)[0])
                seen.update(dict(zip(counts.field(0).to_pylist(), counts.field(1).to_pylist(), strict=True)))
        best = seen.most_common(FREQUENT)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in best], pa.binary()), pa.array([n for _, n in best], pa.int64())], ["unit", "n"])

    total = own.count()
    sample = own.select("text").sample(min(1.0, SAMPLE_DOCUMENTS / max(1, total)), seed=7) if total > SAMPLE_DOCUMENTS else own.select("text")
    seen: Counter = Counter()
    for row in sample.mapInArrow(tally, "unit binary, n long").toLocalIterator():
        seen[bytes(row["unit"])] += row["n"]
    model, _ = Counters.of(model_path)
    frequent = [u for u, _ in seen.most_common(FREQUENT)]
    table = spark.sparkContext.broadcast(dict(zip(frequent, _lengths(frequent, model), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = Counters.of(model_path)
        near = table.value
        for batch in batches:
            for at, rows, data, offsets in text_steps(batch.column(1)):
                units, each = pre_tokens(data, offsets)
                coded = pc.dictionary_encode(units)
                distinct = coded.dictionary.to_pylist()
                lengths = [near.get(u) or cache.get(u) for u in distinct]
                missing = [u for u, n in zip(distinct, lengths, strict=True) if n is None]
                if missing:
                    if len(cache) + len(missing) > CACHED:
                        cache.clear()
                    fresh = dict(zip(missing, _lengths(missing, model), strict=True))
                    lengths = [fresh[u] if n is None else n for u, n in zip(distinct, lengths, strict=True)]
                    cache.update(fresh if len(fresh) <= CACHED else {})
                per = np.asarray(lengths, np.int64)[coded.indices.to_numpy()] if len(units) else np.zeros(0, np.int64)
                sums = np.concatenate([[0], np.cumsum(per)])
                ends = np.cumsum(each)
                n = sums[ends] - sums[ends - each]
                whole = data.tobytes()
                # A text that starts without a space gets one; one that starts with spaces gets one more.
                for i in range(rows):
                    own_bytes = whole[offsets[i] : offsets[i + 1]] if data[offsets[i] : offsets[i] + 1].tobytes() == b" " else b""
                    if own_bytes:
                        head = int(np.argmax(np.append(data[offsets[i] : offsets[i + 1]] != _SPACE, True)))
                        stop = int(np.argmax(np.append(data[offsets[i] + head : offsets[i + 1]] == _SPACE, True))) + head
                        first = own_bytes[:stop]
                        n[i] += len(model.encode(first.decode())) - _lengths([first], model)[0]
                if _MARK in whole:
                    for i in range(rows):
                        one = whole[offsets[i] : offsets[i + 1]]
                        if _MARK in one:
                            n[i] = len(model.encode(one.decode()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), pa.array(np.diff(offsets), pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
