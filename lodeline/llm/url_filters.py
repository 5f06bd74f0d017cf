"""URL filters: a cascade of Bloom filters that answers exact membership of a list, without joins.

Level 0 encodes the listed keys, level 1 the keys of the corpus that pass level 0 without being
listed, level 2 the listed keys that pass level 1, and so on until nothing passes wrongly. For every
key of the corpus the first level that does not hold it tells whether it is listed. Only level 0 asks
the corpus; the keys that go on are written. The levels are literals in the plan: their size follows
the list, not the corpus, is checked, and a list too long for one cascade is dealt to several by key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "://([^/?#]*)([^?#]*)"
#: Bits of a level; a list that needs more is dealt to several cascades.
MOST_BITS = 1 << 24


@dataclass(frozen=True)
class Level:
    bits: tuple[int, ...]
    n_bits: int
    n_hashes: int
    seed: int

    def _position(self, key: Column, i: int | Column) -> Column:
        i = F.lit(i).cast("long") if isinstance(i, int) else i.cast("long")
        first = F.pmod(F.xxhash64(F.lit(self.seed), key), F.lit(self.n_bits).cast("long"))
        step = F.pmod(F.xxhash64(key, F.lit(self.seed)), F.lit(self.n_bits).cast("long"))
        return F.pmod(first + i * step, F.lit(self.n_bits).cast("long"))

    def holds(self, key: Column) -> Column:
        # A cast of a literal is folded into one array before any row is read.
        words = F.split(F.lit(",".join(map(str, self.bits))), ",").cast("array<bigint>")
        found = F.lit(True)
        for i in range(self.n_hashes):
            at = self._position(key, i)
            found = found & (F.call_function("shiftrightunsigned", F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return found


def _bits_for(n: int, rate: float) -> int:
    return max(64, 64 * math.ceil(1.4427 * n * math.log2(1 / rate) / 64))


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    n_bits = _bits_for(n, rate)
    level = Level((), n_bits, max(1, round(math.log2(1 / rate))), seed)
    at = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(level.n_hashes - 1))).alias("i")).select(level._position(F.col("key"), F.col("i")).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits")).collect()
    held = {r["word"]: r["bits"] for r in words}
    return Level(tuple(held.get(w, 0) for w in range(n_bits // 64)), n_bits, level.n_hashes, seed)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def listed(self, key: Column) -> Column:
        """Whether a key of the universe is listed; exact. A null key is not."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            answer = F.when(self.levels[i].holds(key), answer).otherwise(F.lit(i % 2 == 1))
        return F.coalesce(F.when(key.isNotNull(), answer), F.lit(False))


@dataclass(frozen=True)
class Parts:
    """Cascades of a list that was dealt by a hash of its keys."""

    cascades: tuple[Cascade, ...]

    def listed(self, key: Column) -> Column:
        part, answer = _part(key, len(self.cascades)), F.lit(False)
        for i, c in enumerate(self.cascades):
            answer = F.when(part == i, c.listed(key)).otherwise(answer)
        return answer


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts))


def cascade(listed: DataFrame, universe: DataFrame, most_bits: int = MOST_BITS) -> Cascade | Parts:
    """Levels for the column ``key`` of ``listed`` over that of ``universe``, the complete keys of the corpus.

    Only what passes a level by mistake is shuffled, about as many keys as are listed, and each level
    asks the keys written by the one before. Null and repeated keys do no harm; an empty list gives no
    level, so nothing is listed; a list that needs more than ``most_bits`` is dealt to several cascades.
    """
    holds = written(listed.where("key is not null").select("key").distinct(), "listed")
    n = holds.count()
    if not n:
        return Cascade(())
    size = max(n, universe.count())
    parts = -(-_bits_for(n, min(0.5, max(1e-6, n / size))) // most_bits)
    if parts > 1:
        own = lambda df, i: df.where(_part(F.col("key"), parts) == i)
        return Parts(tuple(cascade(own(holds, i), own(universe, i), 2 * most_bits) for i in range(parts)))
    levels: list[Level] = []
    inside, outside = holds, None
    while n:
        rate = min(0.5, max(1e-6, n / size)) if not levels else 0.5
        levels.append(_level(inside, n, rate, len(levels)))
        if outside is None:
            wrong = universe.select("key").where(F.col("key").isNotNull() & levels[-1].holds(F.col("key"))).distinct().join(holds, "key", "left_anti")
        else:
            wrong = outside.where(levels[-1].holds(F.col("key")))
        inside, outside = written(wrong, "passing"), inside
        n = inside.count()
    return Cascade(tuple(levels))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path up to ``?``, ``#`` or the end."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _URL, 1), UPPER, LOWER), F.regexp_extract(url, _URL, 2)


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], page_id: str = "page_id", url: str = "url", otherwise: str = "allow") -> DataFrame:
    """Each page with host, path, the longest rule that fits and its verdict; without one, ``otherwise``: no key of its is listed.

    A rule is a host and a path prefix written together; it fits the host, its subdomains and every
    path that starts with the prefix. Keys of a url are its host endings joined with its path
    beginnings, for the few (labels, characters) that the rules have; two cascades, of allowing and
    blocking rules, are asked for each. Of rules of one length the later string wins; of one that
    both allows and blocks, allow. Null urls and those without ``://`` have empty host and path;
    repeated rows are judged each, other columns of any name are left out, an empty table gives no rows.
    """
    host, path = host_and_path(F.col(url))
    df = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    shapes = sorted({(r.partition("/")[0].count(".") + 1, len(r) - len(r.partition("/")[0])) for r, _ in rules})
    if not shapes:
        return df.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(otherwise)})
    keys = F.array(*(F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, m)) for n, m in shapes))
    df = df.withColumn("keys", F.array_distinct(keys))
    universe = df.select(F.explode("keys").alias("key"))
    spark = pages.sparkSession
    listed = lambda v: spark.range(1).select(F.explode(F.array(*(F.lit(r) for r, x in rules if x == v)).cast("array<string>")).alias("key"))
    of = {v: cascade(listed(v), universe) for v in ("allow", "block")}
    fits = F.filter("keys", lambda x: of["allow"].listed(x) | of["block"].listed(x))
    best = F.array_max(F.transform(fits, lambda x: F.struct(F.length(x).alias("n"), x.alias("rule"))))
    df = df.withColumn("rule", best["rule"])
    verdict = F.when(of["allow"].listed(F.col("rule")), "allow").when(F.col("rule").isNotNull(), "block").otherwise(otherwise)
    return df.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
