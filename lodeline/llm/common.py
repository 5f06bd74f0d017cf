"""What the corpus operators share: tables, the shared folder, word hashing in Arrow batches, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression of the white space that ends a word: space and 09 to 0D.
SPACES = r"[ \t-\r]+"
#: Bytes of text that one vectorised step inside a task takes (a longer document is a step of its own).
STEP_BYTES = 1 << 20


def visible(spark: SparkSession) -> None:
    """Python workers find this library where the driver has it, whatever folder they start in."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    visible(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset and Spark runs on one machine (tests) a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there and lost executors cost nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodeline/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths of the tables written, oldest first.
_tables: list[str] = []


def tables_so_far() -> int:
    return len(_tables)


def released(spark: SparkSession, since: int, until: int | None = None) -> None:
    """Removes the tables that ``written`` wrote from number ``since`` up to ``until``; nothing may read them any more."""
    jvm = spark.sparkContext._jvm
    for path in _tables[since:until]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    del _tables[since:until]


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def turns(df: DataFrame, key: str, entries: int) -> Iterator[pa.Table]:
    """The rows of a written table in turns of about ``entries`` rows, all rows of a key in one turn.

    Each turn is small enough for the driver and for every task; an empty table has no turn.
    """
    n = -(-df.count() // entries)
    for turn in range(n):
        part = df if n == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(n)) == turn)
        rows = part.toArrow()
        if len(rows):
            yield rows


def partitions_for(df: DataFrame, least: int = 1) -> int:
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


# --- text as numpy arrays -------------------------------------------------------------------------

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.RandomState(20_240_229).randint(0, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, STEP_BYTES), b, np.uint64))]) for b in (_BASE, _UNBASE)]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def text_steps(column: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, UTF-8 bytes, byte offsets of the rows), each of about ``most`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_string(column.type) else column.view(pa.large_binary())
    column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end - at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and row of every word of the rows."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = ~IS_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = solid[heads]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = solid[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return data | (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; equal spans have equal hashes wherever they stand."""
    up, down = _powers_to(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * up[: len(data)])])
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct k-word shingle, sorted by row and hash; a row with fewer words has one, of them all."""
    start, end, row = word_spans(data, offsets)
    rows = len(offsets) - 1
    w = span_hashes(data, start, end)
    count = np.bincount(row, minlength=rows)
    with np.errstate(over="ignore"):
        total, n = np.zeros(max(0, len(w) - k + 1), np.uint64), max(0, len(w) - k + 1)
        for j in range(k):
            total = (total + w[j : j + n]) * _BASE
        whole = row[:n] == row[k - 1 : k - 1 + n] if n else np.zeros(0, bool)
        at, value = row[:n][whole], mix(total[whole])
        few = np.flatnonzero((count > 0) & (count < k))
        if len(few):
            first = np.concatenate([[0], np.cumsum(count)])[few]
            short = np.zeros(len(few), np.uint64)
            for j in range(k - 1):
                has = count[few] > j
                short[has] = (short[has] + w[first[has] + j]) * _BASE
            at = np.concatenate([at, few])
            value = np.concatenate([value, mix(short + count[few].astype(np.uint64))])
    order = np.lexsort((value, at))
    at, value = at[order], value[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (value[1:] != value[:-1])
    return at[new], value[new]


# --- components -----------------------------------------------------------------------------------


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node below another one has just that edge: each component is a star around its smallest node."""
    twice = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
    return not twice.take(1) and not edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").take(1)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of the links; component: the smallest node reachable.

    Alternating large-star and small-star rounds: each is a few aggregations and joins with keys that
    adaptive execution can split; no component is ever gathered in one task or the driver. Links with
    a null end are ignored; repeated links and loops do no harm; no links give no rows.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = written(edges, "edges")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = written(small.where("u <> v").distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
