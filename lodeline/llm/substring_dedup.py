"""Removal of repeated passages by recompression.

Recompression rewrites every text over growing symbols: a run of one symbol gets one name, then pairs
get names whose first symbol falls in the left class and whose second in the right one. Whether two
neighbours become a pair depends on these two alone, so equal passages get equal symbols except for a
few at their ends, and how far a symbol must be from the ends of a passage to be certain is counted
along. A name is a hash of what it stands for, hence the same in every task.

A Spark round then asks which names stand only once: such a symbol, where it is certain, rules out all
windows around it. The windows left are shared ones, but for a few, and these are named by their own
words (128 bits); those that stand once are taken off again. Both rounds aggregate by name and return
places of single names only, so a passage that everybody copies costs a row a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, span_hashes, text_steps, word_spans, written

#: Words of a piece of a long text (places of symbols have 16 bits), and words that are rewritten at a time.
PIECE = 60_000
STEP_WORDS = 1 << 19
#: Texts up to which what is known of them is broadcast, and bytes of it; beyond, a shuffled join.
BROADCAST_TEXTS = 1_000_000
BROADCAST_BYTES = 48 << 20


def namings(window: int) -> str:
    """Runs (r) and pairs (p) to name, so that symbols have about a sixth of a window's words.

    Each naming of pairs makes symbols about 4/3 times as long. Two more would leave an eighth of the
    windows of 35 words without a certain symbol, two less double the symbols.
    """
    pairs = max(1, round(math.log(max(window, 7) / 6) / math.log(4 / 3)))
    return "".join("p" if i % 6 else "rp" for i in range(pairs))


def _left(name: np.ndarray, naming: int) -> np.ndarray:
    """Whether a symbol is of the left class in this naming."""
    return (mix(name ^ np.uint64((naming + 1) * 0x2545F4914F6CDD1D & (1 << 64) - 1)) >> np.uint64(40)) & np.uint64(1) == 1


def recompressed(words: np.ndarray, piece: np.ndarray, plan: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names and starts of the symbols of some pieces, and for each place which symbols are certain.

    Of a passage that starts at word i, symbols are certain from ``first[i]`` on, of one that ends before
    word j, up to ``last[j]``: whatever stands around it, they are the same.
    """
    n = len(words)
    name, start, of = words, np.arange(n), piece
    first, last = np.arange(n + 1), np.arange(n + 1)

    def symbols() -> tuple[np.ndarray, np.ndarray]:
        head = np.zeros(n, bool)
        head[start] = True
        return np.cumsum(head) - 1, np.append(start[1:], n)

    for i, kind in enumerate(plan):
        beside = of[1:] == of[:-1]
        if kind == "r":
            head = np.append(True, (name[1:] != name[:-1]) | ~beside)
            length = np.diff(np.append(np.flatnonzero(head), len(name)))
            name, start, of = name[head], start[head], of[head]
            with np.errstate(over="ignore"):
                name = np.where(length > 1, mix(name + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), name)
            at, end = symbols()
            # The run at an end of a passage may go on outside of it.
            first = np.where(first < n, end[at[np.minimum(first, n - 1)]], n)
            last = np.where(last > 0, start[at[np.maximum(last, 1) - 1]], 0)
        else:
            left = _left(name, i)
            at, end = symbols()
            x = at[np.minimum(first, n - 1)]
            first = np.where((first < n) & ~left[x], end[x], first)
            x = at[np.maximum(last, 1) - 1]
            last = np.where((last > 0) & left[x], start[x], last)
            pair = np.append(left[:-1] & ~left[1:] & beside, False)
            with np.errstate(over="ignore"):
                name = np.where(pair, mix(mix(name) + np.append(name[1:], np.uint64(0)) * np.uint64(0xC2B2AE3D27D4EB4F)), name)
            stays = np.append(True, ~pair[:-1])
            name, start, of = name[stays], start[stays], of[stays]
    return name, start, first, last


def _pieces(words: np.ndarray, count: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, first word in its row, first word in ``words`` and length of pieces, some at a time.

    Pieces of one text overlap by a word less than a window, so every window lies in one piece.
    """
    step = PIECE - window + 1
    begin = np.cumsum(count) - count
    many = np.where(count >= window, np.maximum(1, -(-(count - window + 1) // step)), 0)
    row = np.repeat(np.arange(len(count)), many)
    base = (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * step
    size = np.minimum(PIECE, count[row] - base)
    at = 0
    ends = np.cumsum(size)
    while at < len(row):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_WORDS, "right")))
        yield row[at:end], base[at:end], begin[row[at:end]] + base[at:end], size[at:end]
        at = end


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of ``counts`` values each as binary."""
    cuts = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """x1, x2: 128 bits that stand for a text; copies have the same."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.xxhash64(body).alias("x1"), F.xxhash64(F.lit(35), body, F.length(body)).alias("x2"), body.alias("text"))


def symbol_table(docs: DataFrame, window: int, text: str = "text") -> DataFrame:
    """x1, x2, base, n and the symbols of every piece: names, and the first and last window (of the piece) that each is certain in.

    Symbols that are certain in no window are left out, and so are texts shorter than a window.
    """
    plan = namings(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows, data, offsets in text_steps(batch.column(2)):
                begin, end, of = word_spans(data, offsets)
                words = span_hashes(data, begin, end)
                for row, base, first_word, size in _pieces(words, np.bincount(of, minlength=rows), window):
                    own, heads = words[_ranges(first_word, size)], np.cumsum(size) - size
                    piece = np.repeat(np.arange(len(row)), size)
                    name, start, first, last = recompressed(own, piece, plan)
                    k = piece[start]
                    low = np.maximum(np.searchsorted(last, np.append(start[1:], len(own)), "left") - window - heads[k], 0)
                    high = np.minimum(np.searchsorted(first, start, "right") - 1 - heads[k], size[k] - window)
                    sure = low <= high
                    counts = np.bincount(k[sure], minlength=len(row))
                    columns = [batch.column(j).slice(at, rows).take(pa.array(row)) for j in (0, 1)]
                    columns += [pa.array(base, pa.int64()), pa.array(size, pa.int32())]
                    columns += [_binary(name[sure], counts), _binary(low[sure].astype(np.uint16), counts), _binary(high[sure].astype(np.uint16), counts)]
                    yield pa.RecordBatch.from_arrays(columns, ["x1", "x2", "base", "n", "names", "low", "high"])

    return _keyed(docs, text).mapInArrow(run, "x1 long, x2 long, base long, n int, names binary, low binary, high binary")


def _single_symbols(pieces: DataFrame) -> DataFrame:
    """at and singles: of each piece the symbols whose name stands nowhere else."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                names = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
                sizes = np.array([len(x) for x in names], np.int64)
                at, i = np.repeat(part.column(0).to_numpy(), sizes), _ranges(np.zeros(len(sizes), np.int64), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(at), pa.array(i, pa.int32())], ["name", "at", "i"])

    places = pieces.select("at", "names").mapInArrow(each, "name long, at long, i int")
    once = places.groupBy("name").agg(F.count("*").alias("c"), F.min("at").alias("at"), F.min("i").alias("i")).where("c = 1")
    return once.groupBy("at").agg(F.collect_list("i").alias("singles"))


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def _left_windows(pieces: DataFrame, singles: DataFrame, window: int) -> DataFrame:
    """at, x1, x2, base, and starts and ends of the ranges of windows without a single symbol that is certain in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, low, high = (batch.column(j).to_pylist() for j in (4, 5, 6))
            single = batch.column(7)
            kept, starts, ends = [], [], []
            for j in range(len(batch)):
                edge = np.zeros(sizes[j] - window + 2, np.int32)
                if single[j].is_valid:
                    i = single[j].values.to_numpy()
                    np.add.at(edge, np.frombuffer(low[j], np.uint16)[i].astype(np.int64), 1)
                    np.add.at(edge, np.frombuffer(high[j], np.uint16)[i].astype(np.int64) + 1, -1)
                a, b = _spans(np.cumsum(edge)[:-1] == 0)
                if len(a):
                    kept.append(j)
                    starts.append(a.astype(np.int32).tobytes())
                    ends.append(b.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(pa.array(kept, pa.int64())) for j in range(4)), pa.array(starts, pa.binary()), pa.array(ends, pa.binary())], ["at", "x1", "x2", "base", "starts", "ends"])

    joined = pieces.join(singles, "at", "left").select("at", "x1", "x2", "base", "n", "low", "high", "singles")
    return joined.mapInArrow(run, "at long, x1 long, x2 long, base long, starts binary, ends binary")


def _single_windows(left: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """at and singles: of each piece the windows left whose words stand nowhere else in that order."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows, data, offsets in text_steps(batch.column(4)):
                begin, end, of = word_spans(data, offsets)
                words = span_hashes(data, begin, end)
                count = np.bincount(of, minlength=rows)
                own = batch.slice(at, rows)
                a = [np.frombuffer(x, np.int32).astype(np.int64) for x in own.column(2).to_pylist()]
                b = [np.frombuffer(x, np.int32).astype(np.int64) for x in own.column(3).to_pylist()]
                shift = (np.cumsum(count) - count) + own.column(1).to_numpy()
                size = np.concatenate(b) - np.concatenate(a)
                piece = np.repeat(np.arange(rows), [len(x) for x in a])
                place, place_of = _ranges(np.concatenate(a), size), np.repeat(piece, size)
                for low in range(0, len(place), 1 << 18):
                    i, of_ = place[low : low + (1 << 18)], place_of[low : low + (1 << 18)]
                    one, two = np.zeros(len(i), np.uint64), np.zeros(len(i), np.uint64)
                    with np.errstate(over="ignore"):
                        for j in range(window):
                            w = words[shift[of_] + i + j]
                            one, two = (one + w) * np.uint64(0x9E3779B97F4A7C15), (two ^ w) * np.uint64(0xFF51AFD7ED558CCD) + (two >> np.uint64(29))
                    yield pa.RecordBatch.from_arrays([pa.array(mix(one).view(np.int64)), pa.array(mix(two).view(np.int64)), own.column(0).take(pa.array(of_)), pa.array(i, pa.int32())], ["f1", "f2", "at", "i"])

    joined = left.join(texts, ["x1", "x2"]).select("at", "base", "starts", "ends", "text")
    places = joined.mapInArrow(each, "f1 long, f2 long, at long, i int")
    once = places.groupBy("f1", "f2").agg(F.count("*").alias("c"), F.min("at").alias("at"), F.min("i").alias("i")).where("c = 1")
    return once.groupBy("at").agg(F.collect_list("i").alias("singles"))


def _covered(left: DataFrame, singles: DataFrame, window: int) -> DataFrame:
    """x1, x2, begin, end: ranges of words (of the text) that a repeated window covers, a list of each for a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, end = [], []
            single, base = batch.column(5), batch.column(2).to_numpy()
            for j, (a, b) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                a, b = np.frombuffer(a, np.int32).astype(np.int64), np.frombuffer(b, np.int32).astype(np.int64)
                repeated = np.zeros(int(b[-1]), bool)
                repeated[_ranges(a, b - a)] = True
                if single[j].is_valid:
                    repeated[single[j].values.to_numpy()] = False
                a, b = _spans(repeated)
                begin.append((a + base[j]).tolist())
                end.append((b + base[j] + window - 1).tolist())
            kinds = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(begin, kinds), pa.array(end, kinds)], ["x1", "x2", "begin", "end"])

    joined = left.join(singles, "at", "left").select("x1", "x2", "base", "starts", "ends", "singles")
    found = joined.mapInArrow(run, "x1 long, x2 long, begin array<long>, end array<long>").where(F.size("begin") > 0)
    return found.groupBy("x1", "x2").agg(F.flatten(F.collect_list("begin")).alias("begin"), F.flatten(F.collect_list("end")).alias("end"))


def _without(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of rows with their text and the ranges of words to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows, data, offsets in text_steps(batch.column(1)):
                own = batch.slice(at, rows)
                begin, end, of = word_spans(data, offsets)
                count = np.bincount(of, minlength=rows)
                head = np.cumsum(count) - count
                edge = np.zeros(len(begin) + 1, np.int64)
                for j, (whole, a, b) in enumerate(zip(own.column(2).to_pylist(), own.column(3).to_pylist(), own.column(4).to_pylist(), strict=True)):
                    if whole and count[j]:
                        a, b = [0], [count[j]]
                    if a:
                        np.add.at(edge, np.asarray(a) + head[j], 1)
                        np.add.at(edge, np.asarray(b) + head[j], -1)
                kept = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
                # A kept word and, unless it is its row's last, the white space behind it, as one space.
                more = np.append(of[kept][1:] == of[kept][:-1], False) if len(kept) else np.zeros(0, bool)
                out = data.copy()
                out[end[kept][more]] = 0x20
                bytes_ = np.zeros(len(data) + 2, np.int32)
                np.add.at(bytes_, begin[kept], 1)
                np.add.at(bytes_, end[kept] + more, -1)
                stays = np.cumsum(bytes_)[: len(data)] > 0
                sizes = np.bincount(of[kept], weights=end[kept] - begin[kept] + more, minlength=rows).astype(np.int64)
                texts = _binary(out[stays], sizes).cast(pa.string())
                left = np.bincount(of[kept], minlength=rows)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(count, pa.int64()), pa.array(count - left, pa.int64()), texts], ["doc_id", "n_words", "n_removed", "kept_text"])

    return docs.select("doc_id", "text", "whole", "begin", "end").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def _bounded(df: DataFrame, size: str) -> DataFrame:
    """``df`` marked for a broadcast if it has few rows and bytes; size: SQL for the bytes of a row."""
    rows, bytes_ = df.agg(F.count("*"), F.coalesce(F.sum(F.expr(size)), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_TEXTS and bytes_ <= BROADCAST_BYTES else df


def substring_dedup(docs: DataFrame, window: int = 35, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words, joined by one space) of every row.

    Words ``[^\\x20\\x09-\\x0D]+`` are removed that a window of ``window`` consecutive words covers which
    also starts anywhere else, in the same text or another one; windows are judged on the input. Null
    and empty texts have no words; ids may be null and repeat: every row is a text of its own, and rows
    with equal texts repeat each other. Other columns are left out, whatever they are called; an empty
    table gives no rows. ``window`` is 2 at least. Texts of any length are rewritten in bounded pieces.
    """
    if not 2 <= window <= PIECE // 2:
        raise ValueError(f"window is 2 to {PIECE // 2} words")
    pieces = written(symbol_table(docs, window, text).withColumn("at", F.monotonically_increasing_id()), "symbols")
    # Copies of whole texts stand for each other: one of them is rewritten on, all of them go.
    same = written(pieces.groupBy("x1", "x2", "base").agg(F.min("at").alias("at"), F.count("*").alias("copies")), "texts")
    own = pieces.join(_bounded(same.select("at"), "16"), "at", "left_semi")
    left = written(_left_windows(own, _single_symbols(own), window), "windows")
    keyed = _keyed(docs, text)
    some = left.select("x1", "x2").distinct()
    texts = keyed.join(_bounded(some, "24"), ["x1", "x2"], "left_semi").groupBy("x1", "x2").agg(F.first("text").alias("text"))
    covered = _covered(left, _single_windows(left, texts, window), window)
    copied = same.where("base = 0 and copies > 1").select("x1", "x2", F.lit(True).alias("whole"))
    known = written(copied.join(covered, ["x1", "x2"], "full"), "ranges")
    known = known.withColumns({c: F.when(F.col("whole").isNull(), F.col(c)) for c in ("begin", "end")})
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = ids.withColumns({"x1": F.xxhash64(body), "x2": F.xxhash64(F.lit(35), body, F.length(body))})
    return _without(rows.join(_bounded(known, "40 + 16 * coalesce(size(begin), 0)"), ["x1", "x2"], "left"))
