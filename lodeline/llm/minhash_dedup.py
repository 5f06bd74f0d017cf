"""MinHash near-dedup: bottom-k sketches of one hash function, inverted lists, union sketches, exact Jaccard.

A pair with Jaccard similarity 0.8 shares about 51 of the 64 values that the bottom-64 sketch of its
union retains (binomial; fewer than 33 has a chance of 8e-8 at exactly 0.8, which vanishes above).
So a pair must meet in lists of retained values often enough. Pairs that share a value of a list up
to LONG_LIST come from there. Others share only values of longer lists, which takes documents with
that many of them: copies with many variants, or texts that are mostly one passage. For these alone
the whole sets are filed under their rarest shingles, where passages don't count. Two that have such a
shingle as the rarest common one share no more than what is left from it on in either set, which tells
how large a partner may be; whoever is left without one leaves the list. One centre of each list at a
time draws its copies into a component, and only pairs whose components still differ are held against
each other in the end. No group is expanded into all its pairs, no list is cut, and every link that
joins different components is tested.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, lowered, mix, shingles, text_steps, written

RETAINED = 64
#: Values of the union's bottom-64 that a pair must share.
SHARED = 33
LONG_LIST = 16
#: Ids up to which the documents of candidate pairs are found by broadcast; beyond, by a shuffled join.
BROADCAST_IDS = 1_000_000
#: Bits of a set's parities. Each shingle that only one of two sets has changes one bit at most, so
#: similar sets differ in few; the comparison loses nothing.
ODD = 1024
_ODD = [f"o{i}" for i in range(ODD // 64)]
#: Pairs of different components that a list's member may leave for the end, after the last round of centres.
PAIRS_EACH = 64
_SIGN = np.uint64(1 << 63)


def sketches(docs: DataFrame, words: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (shingles), h1, h2 (hash of the whole set) and its bottom-k sketch, lowest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows, data, offsets in text_steps(batch.column(1)):
                row, value = shingles(lowered(data), offsets, words)
                n = np.bincount(row, minlength=rows)
                ends = np.cumsum(n)
                rank = np.arange(len(row)) - np.repeat(ends - n, n)
                with np.errstate(over="ignore"):
                    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(value ^ np.uint64(salt)))]) for salt in (0, 0x5851F42D4C957F2D)]
                    h1, h2 = ((s[ends] - s[ends - n]).view(np.int64) for s in sums)
                kept = (value ^ _SIGN).view(np.int64)[rank < RETAINED]
                cuts = np.concatenate([[0], np.cumsum(np.minimum(n, RETAINED))])
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(kept, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), pa.array(n, pa.int64()), pa.array(h1), pa.array(h2), lists], ["doc_id", "n", "h1", "h2", "sketch"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sketch array<long>")


def _whole_sets(docs: DataFrame, ids: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """doc_id and all shingles, as sorted 64-bit values, of the documents in ``ids``; written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows, data, offsets in text_steps(batch.column(1)):
                row, value = shingles(lowered(data), offsets, words)
                cuts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])
                sets = [value[cuts[i] : cuts[i + 1]].tobytes() for i in range(rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), pa.array(sets, pa.binary())], ["doc_id", "whole"])

    ids = written(ids.distinct(), "ids")
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(few, "doc_id", "left_semi")
    return written(own.mapInArrow(run, "doc_id long, whole binary"), "sets")


def _meet(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.intersect1d(x, y, assume_unique=True).size
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out.append(i)
            yield batch.select([0, 1]).take(pa.array(out, pa.int64()))

    left = sets.select(F.col("doc_id").alias("a"), F.col("whole").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("whole").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _heads(sets: DataFrame, percent: int) -> DataFrame:
    """(v, rep, n, c, typical, m): the rarest shingles of each set, enough that a similar pair shares one; m: how many have it.

    Of n shingles a pair within ``percent`` leaves out at most n - ceil(percent * n / 100), so it meets
    among one more than that, rarest first. What everybody copies is never rare, unless it is nearly
    all of a text. c: how many shingles that others have too come from this one on. A pair meets in
    the list of the rarest shingle that it shares, so it shares at most the c of either there; a set
    for which even the smallest of a list is then too large isn't in that list. typical: mean
    frequency of a text's shingles, its own ones as none, highest for what others vary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                sets = [np.frombuffer(x, np.uint64) for x in batch.column(1).slice(low, 256).to_pylist()]
                sizes = np.array([len(x) for x in sets], np.int64)
                rep = np.repeat(np.asarray(batch.column(0).slice(low, 256)), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], ["rep", "n", "v"])

    each = sets.mapInArrow(run, "rep long, n long, v long")
    common = each.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("rep")
    ranked = each.join(common, "v").select("rep", "n", "v", F.row_number().over(own.orderBy("df", "v")).alias("r"), F.count("*").over(own).alias("all"), (F.sum("df").over(own) / F.col("n")).alias("typical"))
    # A text's own shingles come first; r counts only those that others have too.
    rare = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.col("all"))
    heads = written(ranked.where(F.col("r") <= rare).select("v", "rep", "n", (F.col("all") - F.col("r") + 1).alias("c"), "typical"), "heads")
    small = heads.groupBy("v").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1")
    heads = written(heads.join(small, "v").where((100 + percent) * F.col("c") >= percent * (F.col("n") + F.col("least"))).drop("m", "least"), "heads")
    many = heads.groupBy("v").agg(F.count("*").alias("m")).where("m > 1")
    return written(heads.join(many, "v"), "heads")


def _alike(x: Column, y: Column, percent: int) -> Column:
    """Whether the union of two sketches allows the similarity: exact for whole sets, with a margin else."""
    union = F.slice(F.array_sort(F.array_union(x, y)), 1, RETAINED)
    shared = F.size(F.array_intersect(F.array_intersect(x, y), union))
    whole = (F.size(x) < RETAINED) & (F.size(y) < RETAINED)
    return F.when(whole, 100 * F.size(F.array_intersect(x, y)) >= percent * F.size(F.array_union(x, y))).otherwise(shared >= F.least(F.lit(SHARED), F.size(union)))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) and kept (the id is its component's).

    Linked are documents with 100 * intersection >= percent * union of their sets of ``words``-word
    shingles. Rows without words have an empty set and are linked with nothing; so are rows without an
    id, whose component is null and which are kept. Repeated rows are the same document and share its
    component. Other columns are left out; an empty table gives no rows.
    """
    signed = written(sketches(docs, words, doc_id, text), "sketches")
    groups = signed.where("doc_id is not null and n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
    reps = written(groups, "texts")
    # Sketches are whole sets on both sides only if every similar text has one.
    needs = F.when(100 * F.col("n") <= percent * RETAINED, F.ceil(F.col("n") * percent / 100)).otherwise(F.lit(SHARED)).cast("int")

    values = reps.select("rep", "n", F.explode("sketch").alias("v"))
    lists = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    shared = written(values.join(lists, "v"), "lists")
    hot = shared.groupBy("rep").agg(F.count_if(F.col("df") > LONG_LIST).alias("h"), F.count("*").alias("c"))
    # Values that no other text has can't be shared: what a document has left must still be enough.
    shared = written(shared.join(hot, "rep").where(F.col("c") >= needs), "lists")
    similar = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")

    short = shared.where(F.col("df") <= LONG_LIST).select("v", F.col("rep").alias("a"), "n", "h")
    met = short.join(short.select("v", F.col("a").alias("b"), F.col("n").alias("m"), F.col("h").alias("k")), "v").where(F.col("a") < F.col("b")).where(similar)
    enough = F.when(F.greatest("n", "m") <= RETAINED, F.ceil(F.greatest("n", "m") * percent / 100)).otherwise(F.lit(SHARED))
    pairs = met.groupBy("a", "b", "n", "m", "h", "k").agg(F.count("*").alias("c")).where(F.col("c") + F.least("h", "k") >= enough).select("a", "b")

    own = reps.select("rep", "sketch")

    def filtered(pairs: DataFrame) -> DataFrame:
        x = own.select(F.col("rep").alias("a"), F.col("sketch").alias("x"))
        y = own.select(F.col("rep").alias("b"), F.col("sketch").alias("y"))
        return written(pairs.join(x, "a").join(y, "b").where(_alike(F.col("x"), F.col("y"), percent)).select("a", "b"), "pairs")

    tested = filtered(pairs)
    crowded = written(shared.where(F.col("h") >= needs).select(F.col("rep").alias("doc_id")).distinct(), "crowded")
    ids = tested.select(F.col("a").alias("doc_id")).unionByName(tested.select(F.col("b").alias("doc_id"))).unionByName(crowded)
    sets = _whole_sets(docs, ids, words, doc_id, text)
    links = written(_meet(tested, sets, percent), "links")
    if crowded.take(1):
        links = _crowded_links(links, tested, sets.join(crowded, "doc_id", "left_semi"), sets, similar, percent, filtered)
    merged = components(links).withColumnRenamed("node", "rep")

    named = reps.select("n", "h1", "h2", "rep").join(merged, "rep", "left").select("n", "h1", "h2", F.coalesce("component", "rep").alias("component"))
    found = signed.select("doc_id", "n", "h1", "h2").join(named, ["n", "h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _parities(sets: DataFrame) -> DataFrame:
    """rep and ODD bits of its set: whether an odd number of its shingles falls on each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.zeros((len(batch), ODD), np.uint8)
            for i, x in enumerate(batch.column(1).to_pylist()):
                bits[i] = np.bincount((np.frombuffer(x, np.uint64) & np.uint64(ODD - 1)).astype(np.int64), minlength=ODD) & 1
            words = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(w) for w in words.T)], ["rep", *_ODD])

    return sets.mapInArrow(run, ", ".join(["rep long", *(f"{o} long" for o in _ODD)])).dropDuplicates(["rep"])


def _crowded_links(links: DataFrame, tested: DataFrame, crowded: DataFrame, sets: DataFrame, similar: Column, percent: int, filtered) -> DataFrame:
    """The links and those among documents of long lists, as far as these join different components.

    A round holds one centre of each list, the most typical of those that the last centre hasn't
    drawn into its component, against all members of other components. Once few pairs of different
    components are left for each member, or a round links nothing more, all of these are held against
    each other.
    """
    heads = _heads(crowded, percent)
    # c and d bound the intersection, see _heads.
    fits = similar & ((100 + percent) * F.least("c", "d") >= percent * (F.col("n") + F.col("m")))
    label, last, before = None, None, float("inf")

    def labelled() -> DataFrame:
        now = heads.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        each = now.groupBy("v", "component").agg(F.count("*").alias("x")).groupBy("v").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
        return now.join(each.where("s * s > q").select("v", ((F.col("s") * F.col("s") - F.col("q")) / 2).alias("pairs")), "v")

    while True:
        # Before the first round every text is a component of its own.
        now = written(heads.withColumn("component", F.col("rep")) if label is None else labelled(), "labelled")
        if label is not None:
            left, members = now.agg(F.sum(F.col("pairs") / F.col("m")), F.count("*")).first()
            if not left or left <= PAIRS_EACH * members or left > 0.7 * before:
                break
            before = left
        free = now if last is None else now.join(last, "v", "left").where("old IS NULL OR old <> component")
        centre = free.groupBy("v").agg(F.max_by(F.struct("rep", "n", "c", "component"), F.struct("typical", -F.col("rep"))).alias("best"))
        centre = written(centre.select("v", F.col("best.rep").alias("centre"), F.col("best.n").alias("m"), F.col("best.c").alias("d"), F.col("best.component").alias("other")), "centres")
        star = now.drop("m").join(centre, "v").where("component <> other").where(fits).select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
        fresh = filtered(star.join(tested, ["a", "b"], "left_anti"))
        found = written(_meet(fresh, sets, percent), "links")
        tested = tested.unionByName(fresh)
        links = links.unionByName(found)
        # Stars stand for the links so far.
        label = components(links if label is None else label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))
        if before < float("inf") and not found.take(1):
            now = written(labelled(), "labelled")
            break
        last = centre.join(label.withColumnRenamed("node", "centre"), "centre", "left").select("v", F.coalesce("component", "centre").alias("old"))
    now = now.join(_parities(crowded), "rep")
    now = written(now.select("v", F.col("rep").alias("a"), "n", "c", "component", *_ODD), "labelled")
    other = now.select("v", F.col("a").alias("b"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("component").alias("other"), *(F.col(o).alias(f"y{o}") for o in _ODD))
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col(o).bitwiseXOR(F.col(f"y{o}"))) for o in _ODD))
    near = (100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("m"))
    cross = now.join(other, "v").where("a < b AND component <> other").where(fits).where(near).select("a", "b").distinct()
    fresh = filtered(cross.join(tested, ["a", "b"], "left_anti"))
    return links.unionByName(_meet(fresh, sets, percent)) if fresh.take(1) else links
