"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass.

At each position the automaton's output links give every piece that ends there, longest first; each
relaxes the best score of the position from that of its start. Unigram models add the scores of
pieces. Byte-pair models rank merges instead, and a segmentation is theirs exactly if each two
neighbours are (merging the two alone gives them back). There a step costs 1 if it joins pieces that
merging would not leave apart and nothing else: the model's own segmentation of every prefix is the
only one that costs nothing, so it has the best score at each position. Pre-tokens (spaces with what
follows up to the next one) are independent; each worker keeps the last ones.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_steps
from .token_counts import pre_tokens

MARK = "▁"
#: Pre-tokens and neighbours that a worker keeps in each of two generations.
CACHED = 1 << 18
PAIRS = 1 << 20
#: Characters that no piece covers count from here, above every piece's number.
_ALONE = 1 << 24


class Recent:
    """A cache of at most twice ``most`` entries: what wasn't asked for while ``new`` filled up once goes."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def put(self, key, value):
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value
        return value

    def aged(self, key):
        """What was known of a key that isn't in ``new``, or None; it is new again."""
        value = self.old.get(key)
        return value if value is None else self.put(key, value)


class Model:
    """Pieces, scores and bytes of a model file, and the automaton over them."""

    held: dict = {}

    def __init__(self, path: str, kind: str | None = None):
        import ahocorasick
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        n = own.get_piece_size()
        self.pieces = [own.id_to_piece(i) for i in range(n)]
        self.scores = [own.get_score(i) for i in range(n)]
        plain = [i for i in range(n) if not (own.is_control(i) or own.is_unknown(i) or own.is_unused(i) or own.is_byte(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.unknown = own.unk_id()
        self.bytes = [own.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = all(own.is_byte(i) for i in self.bytes)
        # Merge ranks fall one by one; probabilities don't.
        self.merges = kind == "bpe" or kind is None and all(float(self.scores[i]).is_integer() for i in plain)
        order = sorted(self.ids, key=lambda x: -self.scores[self.ids[x]])
        self.ranks = dict(zip(order, range(len(order)), strict=True))
        self.unknown_score = min(self.scores[i] for i in plain) - 10
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (len(piece), i, piece))
        self.automaton.make_automaton()
        self.cache, self.pairs = Recent(CACHED), Recent(PAIRS)
        text = [b"" if own.is_control(i) else bytes([self.bytes.index(i)]) if own.is_byte(i) else " ⁇ ".encode() if own.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.text_ends = np.cumsum([len(x) for x in text])
        self.text_sizes = np.array([len(x) for x in text])

    @classmethod
    def of(cls, path: str, kind: str | None = None) -> Model:
        if (path, kind) not in cls.held:
            cls.held[path, kind] = cls(path, kind)
        return cls.held[path, kind]

    def apart(self, a: str, b: str) -> int:
        """0 if merging the characters of a + b, best merge first, ends with a and b; else -1."""
        parts, rank, never = list(a + b), self.ranks.get, len(self.ranks)
        ranks = [rank(x + y, never) for x, y in zip(parts, parts[1:], strict=False)]
        edge = len(a)
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            if i == edge - 1:
                return -1
            if i < edge:
                edge -= 1
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], never)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], never)
        return 0 if len(parts) == 2 and edge == 1 else -1

    def segments(self, unit: str) -> tuple[list[str], list[int]]:
        """The best pieces of a pre-token with their numbers; a character that no piece covers stands alone, numbered from _ALONE."""
        n, merges, scores, pairs = len(unit), self.merges, self.scores, self.pairs
        ends: list[list[tuple[int, int, str]]] = [[] for _ in range(n)]
        for last, found in self.automaton.iter(unit):
            ends[last].append(found)
        best, back, number = [0.0] * (n + 1), [""] * (n + 1), [0] * (n + 1)
        for e in range(1, n + 1):
            links = ends[e - 1]
            if not links or links[-1][0] > 1:
                links = [*links, (1, _ALONE + ord(unit[e - 1]), unit[e - 1])]
            most = float("-inf")
            for size, i, piece in links:
                start = e - size
                score = best[start]
                if not merges:
                    score += self.unknown_score if i >= _ALONE else scores[i]
                elif start and score > most:
                    key = number[start] << 32 | i
                    known = pairs.new.get(key)
                    if known is None:
                        known = pairs.aged(key)
                        if known is None:
                            known = pairs.put(key, self.apart(back[start], piece))
                    score += known
                if score > most:
                    most, back[e], number[e] = score, piece, i
                    if merges and not score:
                        # No step gains anything here: 0 is the best there is.
                        break
            best[e] = most
        pieces, numbers, e = [], [], n
        while e:
            pieces.append(back[e])
            numbers.append(number[e])
            e -= len(back[e])
        return pieces[::-1], numbers[::-1]

    def encode(self, unit: str) -> list[int]:
        pieces, numbers = self.segments(unit)
        if max(numbers, default=0) < _ALONE:
            return numbers
        ids: list[int] = []
        for piece, i in zip(pieces, numbers, strict=True):
            ids += [i] if i < _ALONE else [self.bytes[b] for b in piece.encode()] if self.fallback else [self.unknown]
        return ids

    def packed(self, unit: bytes) -> bytes:
        return array("i", self.encode(unit.decode(errors="replace").replace(" ", MARK))).tobytes()


def _gathered(flat: np.ndarray, ends: np.ndarray, sizes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` named by ``of``, one after the other, and where each ends."""
    n = sizes[of]
    stop = np.cumsum(n)
    total = int(stop[-1]) if len(stop) else 0
    at = np.arange(total) + np.repeat(ends[of] - sizes[of] - (stop - n), n)
    return flat[at], stop


def _encoded(model: Model, names: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """Names, texts (null: empty), ids of all rows one after the other and the places where rows are cut, step by step."""
    column = pc.fill_null(texts, "")
    spaced = pc.replace_substring(column, MARK, " ")
    spaced = pc.if_else(pc.equal(pc.binary_length(spaced), 0), spaced, pc.binary_join_element_wise(" ", spaced, ""))
    for at, rows, data, offsets in text_steps(spaced):
        units, each = pre_tokens(data, offsets)
        coded = pc.dictionary_encode(units)
        found = []
        for u in coded.dictionary.to_pylist():
            ids = model.cache.new.get(u)
            if ids is None:
                ids = model.cache.aged(u)
                if ids is None:
                    ids = model.cache.put(u, model.packed(u))
            found.append(ids)
        sizes = np.array([len(x) // 4 for x in found], np.int64)
        flat = np.frombuffer(b"".join(found), "<i4")
        ids, stop = _gathered(flat, np.cumsum(sizes), sizes, coded.indices.to_numpy()) if len(units) else (flat, np.zeros(0, np.int64))
        cuts = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(each)])]
        yield names.slice(at, rows), column.slice(at, rows).cast(pa.string()), ids, cuts


def _decoded(model: Model, ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
    out, stop = _gathered(model.text, model.text_ends, model.text_sizes, ids)
    ends = np.concatenate([[0], stop])[cuts]
    raw = out.tobytes()
    return pa.array([raw[a + (raw[a : a + 1] == b" ") : b].decode(errors="replace") for a, b in zip(ends, ends[1:], strict=False)], pa.string())


def _binary(ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])


def encode(docs: DataFrame, model_path: str, kind: str | None = None, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, text (null: empty) and ids (signed 32-bit, little-endian) of every document; with ``decoded`` also their text.

    As the library does, one space goes before a text that isn't empty, and the space mark is a space.
    Repeated rows and null ids are encoded each; other columns are left out; an empty table gives no rows.
    """
    names = ["doc_id", "text", "ids", "decoded"][: 4 if decoded else 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(model_path, kind)
        for batch in batches:
            for own, texts, ids, cuts in _encoded(model, batch.column(0), batch.column(1)):
                more = [_decoded(model, ids, cuts)] if decoded else []
                yield pa.RecordBatch.from_arrays([own, texts, _binary(ids, cuts), *more], names)

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text string, ids binary" + ", decoded string" * decoded)


def decode(coded: DataFrame, model_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows with the text of ``ids``: pieces joined, marks as spaces, byte pieces as bytes, the first space gone.

    Null ids are an empty text; a column named ``into`` is replaced; an empty table gives no rows.
    """
    coded = coded.drop(into)
    fields = coded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(model_path)
        for batch in batches:
            for at, rows, data, offsets in text_steps(batch.column(fields.index(ids))):
                texts = _decoded(model, np.frombuffer(data.tobytes(), "<i4"), offsets // 4)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, rows) for c in batch.columns), texts], [*fields, into])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)
    return coded.mapInArrow(run, f"{kinds}, `{into}` string")
