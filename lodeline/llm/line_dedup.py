"""Line dedup: lines within a small edit distance, joined over segments.

With at most ``edits`` edits between two lines, one of the shorter line's ``edits`` + 1 segments stands
in the longer line unchanged, with as many edits before it as segments. Lengths are cut into classes;
all lines of a class have segments of one width, the first ones counted from the start of the line and
the others from its end. So every distinct line offers its segments under class and number, and the
few substrings of itself that can be such a segment of an equal or shorter line are the same whatever
that line's length. Lines that meet anywhere are dealt by segment, a crowded one in blocks of bounded
size; pairs of two blocks whose letters allow it are verified by banded bit-parallel edit distance
where they are dealt to, and only links leave that task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, mix, span_hashes, text_steps, written

#: Edits at most, and characters of the shorter line for each of them.
EDITS, EACH = 4, 20
#: A class of lengths ends where they are this part longer than its first one.
WIDER = 5
#: Bits of parities that are compared before a pair is made: one for each small letter, the other
#: ASCII characters share the rest. Bytes of longer characters don't count.
PARITIES = 40
_BITS = np.array([1 << (c - 97 if 97 <= c <= 122 else 26 + c % 14) if c < 128 else 0 for c in range(256)], np.int64)
#: Lines of one segment up to which all are held against each other; others meet again by finer segments.
CROWD = 512
#: How many times more of these there are, and their least characters.
FINER, NARROW = 3, 5
#: Bytes of lines whose finer segments are made at a time.
STEP = 1 << 16
#: Lines of one segment that are one block, where even the finer ones are crowded.
BLOCK = 1024
#: Lines of candidate pairs up to which their texts are found by broadcast; beyond, by a shuffled join.
BROADCAST_IDS = 1_000_000


def _unlike(x: str, y: str) -> tuple[str, str]:
    """Both without what they begin and end with alike."""
    n = min(len(x), len(y))
    low, high = 0, n
    while low < high:
        half = (low + high + 1) // 2
        low, high = (half, high) if x[low:half] == y[low:half] else (low, half - 1)
    x, y = x[low:], y[low:]
    n, low, high = min(len(x), len(y)), 0, min(len(x), len(y))
    while low < high:
        half = (low + high + 1) // 2
        low, high = (half, high) if x[len(x) - half : len(x) - low] == y[len(y) - half : len(y) - low] else (low, half - 1)
    x, y = x[: len(x) - low], y[: len(y) - low]
    return x, y


def within(x: str, y: str, edits: int) -> bool:
    """Whether the edit distance of x and y is at most ``edits``: a band of diagonals as bits, one word an error level."""
    if abs(len(x) - len(y)) > edits:
        return False
    x, y = _unlike(x, y)
    if not x or not y:
        return max(len(x), len(y)) <= edits
    places: dict[str, int] = {}
    for i, c in enumerate(x):
        places[c] = places.get(c, 0) | 1 << (i + edits)
    band = (1 << (2 * edits + 1)) - 1
    # Bit j of level e: so far, j - edits more characters of x than of y are used, with e edits.
    levels = [((1 << (e + 1)) - 1) << edits & band for e in range(edits + 1)]
    for i, c in enumerate(y):
        equal = places.get(c, 0) >> i & band
        fresh = [levels[0] & equal]
        for e in range(1, edits + 1):
            fresh.append((levels[e] & equal | levels[e - 1] | levels[e - 1] >> 1 | fresh[e - 1] << 1) & band)
        levels = fresh
        if not levels[edits]:
            return False
    return bool(levels[edits] >> (edits + len(x) - len(y)) & 1)


def all_within(pairs: list[tuple[str, str]], edits: np.ndarray) -> np.ndarray:
    """``within`` of many pairs at once: the same bits of the same band, a step for all pairs at a time."""
    out = np.zeros(len(pairs), bool)
    cut, sizes = [], []
    for i, (x, y) in enumerate(pairs):
        x, y = _unlike(x, y)
        if not x or not y:
            out[i] = max(len(x), len(y)) <= edits[i]
        elif abs(len(x) - len(y)) <= edits[i]:
            cut.append((i, x, y))
            sizes.append((len(x), len(y)))
    if not cut:
        return out
    most = int(edits.max())
    sizes = np.array(sizes)
    order = np.argsort(sizes[:, 1], kind="stable")
    for low in range(0, len(cut), 1024):
        part = order[low : low + 1024]
        long = int(sizes[part, 1].max())
        # x is padded so that the band of diagonals around any place of y lies inside.
        xs, ys = np.full((len(part), long + 2 * most + 1), -1, np.int32), np.full((len(part), long), -2, np.int32)
        for r, c in enumerate(part.tolist()):
            _, x, y = cut[c]
            codes = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.int32)[: long + most + 1]
            xs[r, most : most + len(codes)] = codes
            ys[r, : len(y)] = np.frombuffer(y.encode("utf-32-le", "surrogatepass"), np.int32)
        of, lx, ly = np.array([cut[c][0] for c in part.tolist()]), sizes[part, 0], sizes[part, 1]
        band, bits = (1 << (2 * most + 1)) - 1, 1 << np.arange(2 * most + 1)
        levels = [np.full(len(part), ((1 << (e + 1)) - 1) << most & band, np.int64) for e in range(most + 1)]
        for i in range(long):
            equal = (xs[:, i : i + 2 * most + 1] == ys[:, i, None]) @ bits
            fresh = [levels[0] & equal]
            for e in range(1, most + 1):
                fresh.append((levels[e] & equal | levels[e - 1] | levels[e - 1] >> 1 | fresh[e - 1] << 1) & band)
            levels = fresh
            end = np.flatnonzero(ly == i + 1)
            if len(end):
                out[of[end]] = np.stack(levels)[edits[of[end]], end] >> (most + lx[end] - ly[end]) & 1
            if i % 8 == 7:
                use = np.flatnonzero((levels[most] != 0) & (ly > i + 1))
                if not len(use):
                    break
                xs, ys, of, lx, ly, levels = xs[use], ys[use], of[use], lx[use], ly[use], [v[use] for v in levels]
    return out


def _bounds(edits: int | None) -> list[tuple[int, int, int]]:
    """(edits, least and most length of the shorter line): one flat bound, or for None one edit for every EACH characters, EDITS at most."""
    if edits is not None:
        return [(edits, 1, 1 << 40)]
    return [(k, k * EACH, (k + 1) * EACH - 1 if k < EDITS else 1 << 40) for k in range(1, EDITS + 1)]


def allowed(x: str, y: str, edits: int | None) -> int:
    """The edits that two lines may be apart; the shorter one decides."""
    return min(EDITS, min(len(x), len(y)) // EACH) if edits is None else edits


def _length_classes(edits: int | None) -> np.ndarray:
    """Rows of edits, least and most length: the classes of lengths that can have a partner, shortest first."""
    out = []
    for k, least, most in _bounds(edits):
        while least <= most:
            last = min(most, least + max(1, least // WIDER) - 1)
            out.append((k, least, last))
            least = last + 1
    return np.array(out, np.int64)


class Lines:
    """The lines of one step of texts: row, number, start, end (bytes), characters, digest."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least: int):
        rows = len(offsets) - 1
        breaks = np.flatnonzero(data == 10)
        of = np.searchsorted(offsets, breaks, "right") - 1
        n = np.bincount(of, minlength=rows) + 1
        row = np.repeat(np.arange(rows), n)
        number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start, end = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
        start[number == 0], start[number > 0] = offsets[:-1], breaks + 1
        last = number == np.repeat(n, n) - 1
        end[last], end[~last] = offsets[1:], breaks
        self.data = data
        self.begin = np.flatnonzero((data & 0xC0) != 0x80)
        self.first = np.searchsorted(self.begin, start)
        size = np.searchsorted(self.begin, end) - self.first
        use = np.flatnonzero(size >= max(1, least))
        self.row, self.number, self.start, self.end, self.first, self.size = (x[use] for x in (row, number, start, end, self.first, size))
        self.begin = np.append(self.begin, len(data))
        raw = data.tobytes()
        self.digests = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)]

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        both = np.frombuffer(b"".join(self.digests), "<i8").reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()

    def asked(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each distinct line that can have a partner: its place, then the place of each of its keys' lines with the keys.

        A key is a hash of a segment, its number and class; the lowest bit tells whether it is the
        line's own or one that it asks for.
        """
        once: dict[bytes, int] = {}
        for i, d in enumerate(self.digests):
            once.setdefault(d, i)
        use = np.fromiter(once.values(), np.int64, len(once))
        use = use[self.size[use] >= classes[0, 1]]
        n, first = self.size[use], self.first[use]
        own = np.searchsorted(classes[:, 1], n, "right") - 1
        spans, back = [], 0
        while True:
            # A line asks its own class, and shorter ones as far as their lines may be partners.
            at = own - back
            near = np.flatnonzero((at >= 0) & (n <= classes[at, 2] + classes[at, 0]))
            if not len(near):
                break
            for k in np.unique(classes[at[near], 0]).tolist():
                who = near[classes[at[near], 0] == k]
                spans += self._spans(classes, at[who], who, n[who], first[who], k, back == 0)
            back += 1
        if not spans:
            return use, np.zeros((2, 0), np.int64)
        who, start, end, tag = (np.concatenate(x) for x in zip(*spans, strict=True))
        value = mix(span_hashes(self.data, start, end) ^ mix((tag >> 1).astype(np.uint64))) & ~np.uint64(1) | (tag & 1).astype(np.uint64)
        return use, np.stack([who, value.view(np.int64)])

    def _spans(self, classes: np.ndarray, at: np.ndarray, who: np.ndarray, n: np.ndarray, first: np.ndarray, k: int, own: bool) -> list:
        wide = classes[at, 1] // (k + 1)
        # How much longer than a line of the class: between these.
        low, high = np.maximum(0, n - classes[at, 2]), np.minimum(k, n - classes[at, 1])
        out = []
        for i in range(k + 1):
            from_start = 2 * i <= k
            for shift in range(-min(i, k - i) if from_start else i - k, (i if from_start else min(i, k - i)) + 1):
                # i edits stand before the segment and k - i at most behind it; the lengths must allow that.
                if from_start:
                    ok = (shift >= low - (k - i)) & (shift <= high + (k - i))
                    place = i * wide + shift
                else:
                    ok = (shift >= -i - high) & (shift <= i - low)
                    place = n - (k + 1 - i) * wide + shift
                ok &= (place >= 0) & (place + wide <= n)
                if i:
                    # Where lines are shorter than their segments are many, the first one is empty and meets all.
                    ok &= wide > 0
                ok = np.flatnonzero(ok)
                head = first[ok] + place[ok]
                out.append((who[ok], self.begin[head], self.begin[head + wide[ok]], at[ok] << 5 | i << 1 | (own and shift == 0)))
        return out


    def finely_asked(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Like asked, over more segments than there are edits; a line's place, key and how many segments of its own hold one of any partner.

        Any edits + 1 of a line's own segments hold one that stands in the longer line unchanged. As none
        is known to be the one, it may be shifted by as many characters as edits can explain.
        """
        n = self.size
        own = np.searchsorted(classes[:, 1], n, "right") - 1
        out, back = [], 0
        while True:
            at = own - back
            near = np.flatnonzero((at >= 0) & (own >= 0) & (n <= classes[at, 2] + classes[at, 0]))
            if not len(near):
                break
            for of in np.unique(at[near]).tolist():
                who = near[at[near] == of]
                k, least, most = classes[of].tolist()
                count = max(k + 1, min(FINER * (k + 1), least // NARROW))
                wide = least // count
                size, first = n[who], self.first[who]
                low, high = np.maximum(0, size - most), np.minimum(k, size - least)
                for i in range(count):
                    from_start = 2 * i < count
                    for shift in range(-k, k + 1):
                        sign = shift if from_start else -shift
                        place = (i * wide if from_start else size - (count - i) * wide) + shift
                        ok = np.flatnonzero((sign >= -((k - low) // 2)) & (sign <= (k + high) // 2) & (place >= 0) & (place + wide <= size) & (wide > 0))
                        head = first[ok] + np.broadcast_to(place, size.shape)[ok]
                        mine = int(back == 0 and shift == 0)
                        out.append((who[ok], self.begin[head], self.begin[head + wide], np.full(len(ok), (of << 6 | i) << 1 | mine), np.full(len(ok), k + 1)))
            back += 1
        if not out:
            return (np.zeros(0, np.int64),) * 3
        who, start, end, tag, need = (np.concatenate(x) for x in zip(*out, strict=True))
        value = mix(span_hashes(self.data, start, end) ^ mix(~(tag >> 1).astype(np.uint64))) & ~np.uint64(1) | (tag & 1).astype(np.uint64)
        return who, value.view(np.int64), need


def lines_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 1) -> DataFrame:
    """doc_id, line_no, h and g (128-bit hash) of every \\n-split line of ``least`` characters or more, at least one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows, data, offsets in text_steps(batch.column(1)):
                lines = Lines(data, offsets, least)
                h, g = lines.ids()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows).take(pa.array(lines.row)), pa.array(lines.number, pa.int32()), pa.array(h), pa.array(g)], ["doc_id", "line_no", "h", "g"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, line_no int, h long, g long")


def _keys(docs: DataFrame, edits: int | None, text: str, least: int) -> DataFrame:
    """h, g and keys of each line that can have a partner; see Lines.asked. Lines of several steps are there as often."""
    classes = _length_classes(edits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_steps(batch.column(0)):
                lines = Lines(data, offsets, least)
                use, (who, value) = lines.asked(classes)
                value = value[np.argsort(who, kind="stable")]
                cuts = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(use)))])
                keys = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(value))
                h, g = lines.ids()
                yield pa.RecordBatch.from_arrays([pa.array(h[use]), pa.array(g[use]), keys], ["h", "g", "keys"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "h long, g long, keys array<long>")


def _lines_at(docs: DataFrame, places: DataFrame, doc_id: str, text: str) -> DataFrame:
    """h, g, parity and line of the lines at ``places`` (h, g, first), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, g = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            raw = [(x or "").encode() for x in batch.column(2).to_pylist()]
            ids = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in raw), "<i8").reshape(-1, 2)
            odd = np.concatenate([[np.int64(0)], np.bitwise_xor.accumulate(_BITS[np.frombuffer(b"".join(raw), np.uint8)])])
            ends = np.cumsum([0, *map(len, raw)])
            # A document may be there in several rows, with other texts: the digest tells whose line it is.
            same = pa.array((ids[:, 0] == h) & (ids[:, 1] == g))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(odd[ends[1:]] ^ odd[ends[:-1]]), batch.column(2)], ["h", "g", "parity", "line"]).filter(same)

    at = places.groupBy(F.col("first.doc_id").alias("__of")).agg(F.collect_list(F.struct(F.col("first.line_no").alias("no"), "h", "g")).alias("__places"))
    found = docs.select(F.col(doc_id).alias("__own"), F.col(text).alias("__text")).join(at, F.col("__own").eqNullSafe(F.col("__of")))
    each = found.select(F.split("__text", "\n").alias("split"), F.explode("__places").alias("p")).select("p.h", "p.g", F.get("split", F.col("p.no")).alias("line"))
    lines = each.mapInArrow(run, "h long, g long, parity long, line string")
    return lines.groupBy("h", "g").agg(F.first("parity").alias("parity"), F.first("line").alias("line"))


def _candidates(rows: list[tuple], edits: int | None) -> Iterator[tuple]:
    """(a, b, edits, x, y) of pairs that may be linked among rows (block, own, h, g, parity, line) of one segment; of two blocks only pairs of both."""
    two = rows[0][0] != rows[-1][0]
    n = np.array([len(r[5]) for r in rows])
    odd = np.array([r[4] for r in rows], np.int64)
    block, own = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], bool)
    most = np.zeros(len(rows), np.int64)
    for k, least, last in _bounds(edits):
        most[(n >= least) & (n <= last)] = k
    for i in range(len(rows) - 1):
        m = np.minimum(most[i], most[i + 1 :])
        longer = np.abs(n[i + 1 :] - n[i])
        # An insertion changes one parity, any other edit two at most.
        ok = (longer <= m) & (np.bitwise_count(odd[i + 1 :] ^ odd[i]) + longer <= 2 * m) & (own[i] | own[i + 1 :])
        if two:
            ok &= block[i + 1 :] != block[i]
        for j in (np.flatnonzero(ok) + i + 1).tolist():
            a, b = sorted((rows[i][2:4], rows[j][2:4]))
            if a != b:
                yield a, b, min(most[i], most[j]), rows[i][5], rows[j][5]


def line_links(docs: DataFrame, edits: int | None = None, doc_id: str = "doc_id", text: str = "text", least: int = 1, firsts: DataFrame | None = None) -> DataFrame:
    """(a, b) ids (h, g) of distinct lines within ``edits`` edits; None: within one edit for every EACH characters, EDITS at most.

    Lines meet by half of their ids and their keys, equal ones once, in a semi-join whose sides
    adaptive execution splits; whole texts are fetched for lines that meet another one only, from
    their first places (``firsts``: h, g, first), and decide.
    """
    if firsts is None:
        firsts = _firsts(lines_of(docs, doc_id, text, least))
    once = _keys(docs, edits, text, least).groupBy("h", "g").agg(F.first("keys").alias("keys"))
    asked = once.select("h", F.explode("keys").alias("k")).select("h", F.shiftright("k", 1).alias("key"), F.col("k").bitwiseAND(F.lit(1)).alias("own"))
    # Without new names on either side, both are one and the same exchange.
    x, y = asked.alias("x"), asked.alias("y")
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.h") != F.col("y.h")) & (F.col("x.own") + F.col("y.own") > 0)
    live = written(x.join(y, met, "left_semi"), "line-keys")
    ids = written(live.select("h").distinct(), "line-ids")
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = written(_lines_at(docs, firsts.join(few, "h", "left_semi"), doc_id, text), "line-texts")
    crowds = live.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD)
    crowds = written(crowds.select("key"), "line-crowds")
    if not crowds.take(1):
        return _dealt(live, texts, edits)
    calm = _dealt(live.join(crowds, "key", "left_anti"), texts, edits)
    busy = written(live.join(crowds, "key", "left_semi").select("h").distinct(), "line-busy")
    return calm.unionByName(_dealt(_finer(texts.join(busy, "h", "left_semi"), edits), texts, edits)).distinct()


def _finer(texts: DataFrame, edits: int | None) -> DataFrame:
    """h, key and own of lines by finer segments: each offers only its rarest ones, as many as hold one of any partner."""
    classes = _length_classes(edits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows, data, offsets in text_steps(batch.column(1), STEP):
                who, value, need = Lines(data, offsets, 1).finely_asked(classes)
                h = batch.column(0).slice(at, rows).to_numpy()
                for low in range(0, len(who), 1 << 18):
                    part = slice(low, low + (1 << 18))
                    yield pa.RecordBatch.from_arrays([pa.array(h[who[part]]), pa.array(value[part] >> 1), pa.array(value[part] & 1), pa.array(need[part], pa.int32())], ["h", "key", "own", "need"])

    asked = written(texts.select("h", "line").mapInArrow(run, "h long, key long, own long, need int").distinct(), "finer-keys")
    often = asked.groupBy("key").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("h").orderBy("n", "key"))
    own = asked.where("own = 1").join(often, "key").withColumn("own", (rank <= F.col("need")).cast("long"))
    every = asked.where("own = 0").select("h", "key", "own").unionByName(own.select("h", "key", "own")).groupBy("h", "key").agg(F.max("own").alias("own"))
    every = written(every, "finer-rows")
    some = every.groupBy("key").agg(F.max("own").alias("most"), F.count("*").alias("n")).where("most = 1 AND n > 1").select("key")
    return written(every.join(some, "key", "left_semi"), "finer-rows")


def _dealt(live: DataFrame, texts: DataFrame, edits: int | None) -> DataFrame:
    """(a, b) of the lines of live (h, key, own) that share a key, one of them as its own, and are near enough."""
    crowds = live.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = live.join(crowds, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "own", "h")
    rows = dealt.join(texts, "h").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "block")
    rows = rows.select("key", "low", "high", "block", "own", "h", "g", "parity", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, asked = None, [], {}

        def decided() -> pa.RecordBatch:
            pairs = list(asked)
            close = all_within([x[1:] for x in asked.values()], np.array([x[0] for x in asked.values()], np.int64)) if pairs else []
            asked.clear()
            flat = np.array([(*a, *b) for (a, b), ok in zip(pairs, close, strict=True) if ok], np.int64).reshape(-1, 4)
            return pa.RecordBatch.from_arrays([pa.array(flat[:, i]) for i in range(4)], ["a", "ag", "b", "bg"])

        def group() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                for a, b, *pair in _candidates(held, edits):
                    asked[a, b] = pair
                    if len(asked) >= 4096:
                        yield decided()

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for of, row in zip(zip(*columns[:3], strict=True), zip(*columns[3:], strict=True), strict=True):
                if of != now:
                    yield from group()
                    now, held = of, []
                held.append(row)
        yield from group()
        yield decided()

    df = rows.mapInArrow(run, "a long, ag long, b long, bg long").distinct()
    return df.select(F.struct(F.col("a").alias("h"), F.col("ag").alias("g")).alias("a"), F.struct(F.col("b").alias("h"), F.col("bg").alias("g")).alias("b"))


def _firsts(lines: DataFrame) -> DataFrame:
    """h, g and first (doc_id, line_no) of each distinct line."""
    return lines.groupBy("h", "g").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))


def line_classes(docs: DataFrame, edits: int | None = None, doc_id: str = "doc_id", text: str = "text", least: int = 1) -> DataFrame:
    """A row for each line of ``least`` characters or more, at least one: doc_id, line_no, class_doc_id, class_line_no, n_links, kept.

    The class of a line is all that links reach; it is named by its first line in (doc_id, line_no)
    order, which alone is kept. n_links counts the other distinct lines within ``edits`` edits of it (None: as for line_links).
    Lines too short for an edit (see line_links) are in one class with their exact copies. Null and
    empty texts have no lines, null ids come first, a repeated row is the same document, other columns
    of any name are left out, and an empty table gives no rows.
    """
    each = written(lines_of(docs, doc_id, text, least), "lines")
    firsts = written(_firsts(each), "line-firsts")
    links = written(line_links(docs, edits, doc_id, text, least, firsts), "line-links")
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    classes = components(links).select(F.col("node").alias("id"), F.col("component").alias("class"))
    linked = classes.join(degree, "id").select("id.h", "id.g", "class", "n_links").join(firsts, ["h", "g"])
    lead = linked.groupBy("class").agg(F.min("first").alias("lead"))
    # Few lines have links: the others are their own class, and need no join for it.
    led = linked.join(lead, "class").select("h", "g", "n_links", "lead")
    named = firsts.join(led, ["h", "g"], "left").select("h", "g", F.coalesce("lead", "first").alias("first"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    df = each.join(named, ["h", "g"])
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no"))
    return df.select("doc_id", "line_no", F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").alias("class_line_no"), "n_links", kept.alias("kept"))


def without_duplicate_lines(docs: DataFrame, edits: int | None = None, doc_id: str = "doc_id", text: str = "text", least: int = 1) -> DataFrame:
    """The documents without lines that are not the first of their class; what is left empty by that goes, other columns stay.

    Lines of fewer than ``least`` characters stay. Null texts and those that were empty stay as they
    are; equal rows are one document, and rows with a null or repeated id and different texts are
    documents each; an empty table gives no rows; columns may have any names but those beginning with
    two underscores.
    """
    keyed = docs.withColumn("__row", F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("text")))
    drop = line_classes(keyed, edits, "__row", text, least).where("not kept").groupBy(F.col("doc_id").alias("__of")).agg(F.collect_set("line_no").alias("__lines"))
    df = keyed.join(drop, F.col("__row").eqNullSafe(F.col("__of")), "left")
    left = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains("__lines", i)), "\n")
    df = df.withColumn(text, F.when(F.col("__lines").isNull(), F.col(text)).otherwise(left))
    return df.where(F.col("__lines").isNull() | (F.col(text) != "")).select(*docs.columns)
