"""Versions as sortable keys, and constraints compiled to ranges of such keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WHOLE = r"^v?([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\z"
_PARTIAL = r"^[vV=]?([0-9]+)(?:\.([0-9]+|[xX*]))?(?:\.([0-9]+|[xX*]))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\z"
_ANY = r"^[xX*](\.[xX*]){0,2}\z"
#: Digits of a number in a version.
_DIGITS = 18
#: Below and above every key.
LOWEST, HIGHEST = "", "~~"


def _number(digits: Column) -> Column:
    """A number as text that sorts as numbers do: how many digits, then the digits."""
    bare = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.concat(F.lpad(F.length(bare).cast("string"), 3, "0"), bare)


def _marks(text: Column) -> Column:
    """What follows the numbers: a release is above its pre-releases; their marks are numbers, then words, each with an end below all others."""
    # Words get a letter in front, which is above the digits that numbers begin with.
    parts = F.transform(F.filter(F.split(text, r"\."), lambda x: x != ""), lambda x: F.when(x.rlike("[^0-9]"), F.concat(F.lit("w"), x)).otherwise(_number(x)))
    return F.when(text == "", "~").otherwise(F.concat(F.lit("-"), F.array_join(parts, "\x01"), F.lit("\x01")))


def version_key(version: Column) -> Column:
    """A text that sorts as the version does; metadata after ``+`` doesn't count. Null where it is no version."""
    part = [F.regexp_extract(version, _WHOLE, i) for i in (1, 2, 3, 4)]
    short = F.greatest(*(F.length(p) for p in part[:3])) <= _DIGITS
    numbers = [_number(F.when(p == "", "0").otherwise(p)) for p in part[:3]]
    return F.when(version.rlike(_WHOLE) & short, F.concat(*numbers, _marks(part[3])))


def is_release(key: Column) -> Column:
    return F.endswith(key, F.lit("~"))


def compiled_constraints(df: DataFrame, constraint: str = "constraint") -> DataFrame:
    """(constraint, low, high, pre, holes) of each distinct constraint: a version meets it within [low, high) of any row.

    Pre-releases only do where ``pre``; ``holes`` are ranges (low, high) that a row leaves out. Alternatives
    are joined by ``||``, and each is comparisons joined by commas or spaces: ``=``, ``!=``, ``<``, ``<=``,
    ``=<``, ``>``, ``>=``, ``=>``, ``~``, ``~>`` and ``^`` before a version, whose minor and patch may be missing
    or ``x``, ``X``, ``*``; ``a - b`` is both bounds. A partial version stands for all that complete it. A
    pre-release meets a comparison only if that names a pre-release too. What can't be read is met by
    nothing, and neither is null.
    """
    texts = df.select(F.col(constraint).alias("constraint")).where("constraint IS NOT NULL").distinct()
    sides = texts.select("constraint", F.posexplode(F.split(F.trim("constraint"), r"\|\|")).alias("side", "text"))
    # Both ends of a range first, then one comparison after the other.
    plain = F.regexp_replace(F.regexp_replace(F.trim("text"), r"(\S+)\s+-\s+(\S+)", ">=$1 <=$2"), r"([<>=!~^]+)\s+", "$1")
    terms = sides.select("constraint", "side", F.explode(F.split(F.trim(F.regexp_replace(plain, r"[\s,]+", " ")), " ")).alias("term"))
    t = terms.select("constraint", "side", F.regexp_extract("term", "^([<>=!~^]*)", 1).alias("sign"), F.regexp_replace("term", "^[<>=!~^]+", "").alias("text"))
    part = [F.regexp_extract("text", _PARTIAL, i) for i in (1, 2, 3, 4)]
    number = lambda p: F.coalesce(p.try_cast("bigint"), F.lit(0))
    t = t.select("constraint", "side", "sign", "text", *(number(p).alias(n) for p, n in zip(part, ("a", "b", "c"), strict=False)), part[1].rlike("[0-9]").alias("minor"), part[2].rlike("[0-9]").alias("patch"), part[3].alias("marks"))
    of = lambda *n: F.concat(*(_number(F.lit(x).cast("string") if isinstance(x, int) else x.cast("string")) for x in n))
    a, b, c = (F.col(x) for x in "abc")
    bound = F.concat(of(a, b, c), _marks(F.col("marks")))
    # The first version that isn't covered any more: by what is written, and by what the signs allow.
    major, small = of(a + 1, 0, 0), of(a, b + 1, 0)
    whole = F.when(~F.col("minor"), major).when(~F.col("patch"), small)
    caret = F.when((a > 0) | ~F.col("minor"), major).when((b > 0) | ~F.col("patch"), small).otherwise(of(a, b, c + 1))
    tilde = F.when(~F.col("minor"), major).otherwise(small)
    t = t.withColumn("bound", bound).withColumn("after", F.concat("bound", F.lit("\x00"))).withColumn("whole", whole)
    lowest, highest, sign = F.lit(LOWEST), F.lit(HIGHEST), F.col("sign")
    past = F.coalesce("whole", "after")
    every = sign.isin("~", "~>") & F.col("whole").isNull() & (a == 0) & (b == 0) & (c == 0)
    low = F.when(every | sign.isin("!=", "<", "<=", "=<"), lowest).when(sign == ">", past).otherwise(F.col("bound"))
    high = (
        F.when(every | sign.isin("!=", ">", ">=", "=>"), highest).when(sign.isin("", "=", "<=", "=<"), past).when(sign == "<", F.col("bound"))
        .when(sign == "^", caret).when(sign.isin("~", "~>"), tilde).otherwise(lowest)
    )
    any_ = F.col("text").rlike(_ANY)
    known = any_ | (F.col("text") == "") & (sign == "") | F.col("text").rlike(_PARTIAL)
    free = any_ | (F.col("text") == "")
    t = t.select(
        "constraint", "side", known.alias("known"), F.when(free, F.when(sign.isin("!=", "<", ">"), highest).otherwise(lowest)).otherwise(low).alias("low"), F.when(free, highest).otherwise(high).alias("high"),
        (~free & (F.col("marks") != "")).alias("pre"), F.when(~free & (sign == "!="), F.struct(F.col("bound").alias("low"), past.alias("high"))).alias("hole"),
    )
    ranges = t.groupBy("constraint", "side").agg(F.max("low").alias("low"), F.min("high").alias("high"), F.bool_and("pre").alias("pre"), F.collect_set("hole").alias("holes"), F.bool_and("known").alias("known"))
    unread = ranges.where("NOT known").select("constraint").distinct()
    return ranges.join(unread, "constraint", "left_anti").where("low < high").select("constraint", "low", "high", "pre", "holes")


def meets(key: Column, low: Column, high: Column, pre: Column, holes: Column) -> Column:
    """Whether a version's key is within a row of a compiled constraint."""
    inside = (key >= low) & (key < high) & (is_release(key) | pre)
    return inside & ((F.size(holes) == 0) | ~F.exists(holes, lambda h: (key >= h["low"]) & (key < h["high"])))


def met(df: DataFrame, version: str, constraint: str, into: str = "fits") -> DataFrame:
    """``df`` with whether each row's version meets its constraint.

    Distinct constraints are compiled, distinct pairs decided by an equi-join and a range, and rows find
    their pair's answer.
    """
    pairs = df.select(F.col(version).alias("__v"), F.col(constraint).alias("__c")).distinct()
    ranges = compiled_constraints(df, constraint).withColumnRenamed("constraint", "__c")
    keyed = pairs.withColumn("__k", version_key(F.col("__v")))
    good = keyed.join(ranges, "__c").where(meets(F.col("__k"), F.col("low"), F.col("high"), F.col("pre"), F.col("holes"))).select("__v", "__c").distinct().withColumn("__met", F.lit(True))
    out = df.join(good, (F.col(version) == F.col("__v")) & (F.col(constraint) == F.col("__c")), "left")
    return out.withColumn(into, F.coalesce("__met", F.lit(False))).drop("__v", "__c", "__met")
