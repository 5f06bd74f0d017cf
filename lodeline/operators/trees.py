"""Trees as rows of paths, and the digest of a tree's canonical text."""

from __future__ import annotations

import hashlib
import json
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Characters that the canonical text escapes besides those of every JSON text; fixed values.
ESCAPED = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", "\u2028": "\\u2028", "\u2029": "\\u2029"}
_ESCAPES = str.maketrans(ESCAPED)


def _quoted(text: str) -> str:
    return json.dumps(text, ensure_ascii=False).translate(_ESCAPES)


def _scalar(kind: str, value: str | None) -> str:
    """A leaf as the canonical text has it: null, booleans and numbers bare, anything else a string."""
    if kind == "null" or value is None:
        return "null"
    if kind == "bool":
        return "true" if value.lower() in ("true", "yes", "on") else "false"
    if kind == "int":
        return str(int(value.replace("_", ""), 0 if value.lower().startswith(("0x", "0o", "0b", "-0x")) else 10))
    if kind == "float":
        return _number(float(value.replace("_", "")))
    return _quoted(value)


def _number(x: float) -> str:
    """The shortest decimal that reads back as x; with an exponent below 1e-6 and from 1e21 on."""
    if x == 0 or 1e-6 <= abs(x) < 1e21:
        text = format(x, "f") if x == int(x) else repr(x)
        if "e" in text:
            digits, _, power = text.partition("e")
            text = format(x, f".{len(digits.partition('.')[2]) - int(power)}f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    digits, _, power = repr(x).partition("e")
    return f"{digits.removesuffix('.0')}e{power[0] if power[0] in '+-' else '+'}{power.lstrip('+-0')}"


def _texts(rows: Iterator[tuple]) -> Iterator[str]:
    """The pieces of one tree's text, of rows (keys, kind, value) in canonical order."""
    stack: list[list] = []
    for keys, kind, value in rows:
        while len(stack) > len(keys) or stack and stack[-1][0] != keys[: len(stack) - 1]:
            yield stack.pop()[1]
        while len(stack) < len(keys):
            # What isn't there as a row of its own is a map.
            if stack:
                yield _before(stack[-1], keys[len(stack) - 1])
            stack.append([keys[: len(stack)], "}", False])
            yield "{"
        if stack:
            yield _before(stack[-1], keys[-1])
        if kind in ("map", "seq"):
            stack.append([keys, "}" if kind == "map" else "]", False])
            yield "{" if kind == "map" else "["
        else:
            yield _scalar(kind, value)
    while stack:
        yield stack.pop()[1]


def _before(parent: list, key: str) -> str:
    first, parent[2] = not parent[2], True
    return ("" if first else ",") + (_quoted(key) + ":" if parent[1] == "}" else "")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tree, keys, kind, value), parents before children, with a place that sorts canonically: steps below a sequence are padded.

    A node's own row, if there is one, is the first of its rows. So the row where a level's step last
    changed tells whether it is a sequence; of what came before only the last row is kept.
    """
    last, known = None, np.zeros(0, bool)
    for batch in batches:
        if not batch.num_rows:
            continue
        # The last row of what came before stands in front.
        both = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        ids, keys = both.column(0).to_pylist(), both.column(1)
        size = pc.list_value_length(keys).to_numpy(zero_copy_only=False).astype(np.int64)
        steps, first = keys.flatten(), np.cumsum(size) - size
        code = steps.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        seq = pc.fill_null(pc.equal(both.column(2), "seq"), False).to_numpy(zero_copy_only=False)
        at = np.arange(len(size))
        new = np.ones(len(size), bool)
        new[1:] = np.fromiter(map(operator.ne, ids[1:], ids[:-1]), bool, len(size) - 1)
        items, ahead = np.zeros(len(code), bool), np.zeros(size[-1] + 1, bool)
        for level in range(int(size.max()) + 1):
            # Rows that reach this level; a step that begins here is new where it or one above it is.
            if level:
                deep = np.flatnonzero(size >= level)
                step = np.full(len(size), -1, np.int64)
                step[deep] = code[first[deep] + level - 1]
                new[1:] |= step[1:] != step[:-1]
            begun = np.maximum.accumulate(np.where(new, at, 0))
            inside = seq[begun] & (size[begun] == level)
            if last is not None and level < len(known):
                inside[begun == 0] = known[level]
            below = np.flatnonzero(size > level)
            items[first[below] + level] = inside[below]
            if level < len(ahead):
                ahead[level] = inside[-1]
        place = pc.if_else(pa.array(items), pc.utf8_lpad(steps, 12, "0"), steps)
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)).astype(np.int32)), place)
        out = pa.RecordBatch.from_arrays([*both.columns, places], [*both.schema.names, "place"])
        yield out if last is None else out.slice(1)
        last, known = both.slice(len(size) - 1), ahead


def tree_digests(rows: DataFrame, tree: str = "tree", keys: str = "keys", kind: str = "kind", value: str = "value") -> DataFrame:
    """(tree, digest): SHA-256 of the canonical text of each tree of (tree, keys, kind, value), a row for each key.

    ``keys`` is the way from the root, [] for the root itself, which is a map where it has no row; kinds
    are map, seq, null, bool, int, float, and anything else for strings. The canonical text is JSON
    without spaces, with the keys of maps in the order of their bytes. Trees aren't put together
    anywhere: Spark shuffles their rows once and sorts them twice within partitions, parents before children to
    tell items of sequences from keys of maps, then items by number, and each tree's text
    streams into its digest. Keys are there once; null trees take no part.
    """
    own = rows.where(F.col(tree).isNotNull()).select(F.col(tree).alias("tree"), F.col(keys).alias("keys"), F.col(kind).alias("kind"), F.col(value).alias("value"))
    above = own.repartition("tree").sortWithinPartitions("tree", "keys")
    placed = above.mapInArrow(_placed, StructType([*above.schema.fields, StructField("place", ArrayType(StringType()))]))
    sorted_ = placed.sortWithinPartitions("tree", "place").select("tree", "keys", "kind", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                steps, ends = batch.column(1).flatten().to_pylist(), np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)).tolist()
                ways = (steps[a:b] for a, b in zip([0, *ends], ends, strict=False))
                yield from zip(batch.column(0).to_pylist(), ways, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)

        rows, done = each(), []
        ahead = next(rows, None)
        while ahead is not None:
            now, digest = ahead[0], hashlib.sha256()

            def own_rows() -> Iterator[tuple]:
                nonlocal ahead
                while ahead is not None and ahead[0] == now:  # noqa: B023
                    yield ahead[1:]
                    ahead = next(rows, None)

            for piece in _texts(own_rows()):
                digest.update(piece.encode())
            done.append((now, digest.hexdigest()))
            if len(done) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done])], ["tree", "digest"])
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done])], ["tree", "digest"])

    return sorted_.mapInArrow(run, StructType([StructField("tree", sorted_.schema["tree"].dataType), StructField("digest", StringType())]))
