"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of

SYMBOLS = "[#*$%&|<>]"
#: Frequent function words, in the letters they are written with; fixed values.
STOP_WORDS = (
    "the of and to in is was for on that with by as at it from be this an are or a not "
    "der die und von zu den das mit ein eine für auf ist im des dem nicht sich es auch "
    "le la les de des et un une du en que pour dans est qui sur au par pas plus "
    "el los las y del que en una por con para su se lo no más como al"
).split()
#: (rule, measure, least, most): a document is kept if every measure lies within its bounds; null: unbounded.
RULES = (
    ("mean_word_length", "word_chars / n_words", 1.5, 20.0),
    ("symbols_per_word", "n_symbols / n_words", None, 0.25),
    ("capitals", "n_capitals / word_chars", None, 0.4),
    ("stop_words", "n_stop_words / n_words", 0.01, None),
    ("duplicate_lines", "n_dup_lines / n_lines", None, 0.5),
)
_POSITION_BITS = 24


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The measures of every whole text beside the columns ``keep``; null text has no words.

    n_repeat_words: word positions inside 3-word windows that the text holds twice or more, the first
    included. Windows are compared by 64-bit hashes, found by sorting one array of longs in each row
    (hash bits above, position below) and then comparing whole hashes of those whose upper bits meet.
    """
    i, own = F.col, [F.col(c).alias(f"k{j}") for j, c in enumerate(keep)]
    names = [f"k{j}" for j in range(len(keep))]
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*own, t.alias("t"), words_of(F.col(text)).alias("w"))
    df = df.select(
        *names,
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("lines"),
        F.size(F.filter("w", lambda x: x.isin(*STOP_WORDS, *(x.capitalize() for x in STOP_WORDS)))).cast("long").alias("n_stop_words"),
        F.regexp_count("t", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.when(F.size("w") > 2, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda p: F.xxhash64(F.get("w", p), F.get("w", p + 1), F.get("w", p + 2)))).otherwise(F.array().cast("array<bigint>")).alias("g"),
    )
    base = [*names, "n_words", "word_chars", "n_symbols", "n_stop_words", "n_capitals", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines")]
    low = (1 << _POSITION_BITS) - 1
    repeats = F.size("g") > F.size(F.array_distinct("g"))
    df = df.select(*base, F.when(repeats, F.col("g")).otherwise(F.array().cast("array<bigint>")).alias("g"))
    df = df.select(*[c for c in df.columns if c != "g"], "g", F.sort_array(F.transform("g", lambda h, p: h.bitwiseAND(F.lit(~low)).bitwiseOR(p.cast("long").bitwiseAND(F.lit(low))))).alias("p"))
    done = [c for c in df.columns if c not in ("g", "p")]

    def same(x: Column, y: Column) -> Column:
        return F.shiftright(x, _POSITION_BITS) == F.shiftright(y, _POSITION_BITS)

    meets = F.filter("p", lambda x, k: F.coalesce(same(x, F.get("p", k - 1)), F.lit(False)) | F.coalesce(same(x, F.get("p", k + 1)), F.lit(False)))
    df = df.select(*done, "g", F.when(F.size("g") <= low, F.transform(meets, lambda x: x.bitwiseAND(F.lit(low)).cast("int"))).otherwise(F.transform("g", lambda h, p: p)).alias("c"))
    df = df.select(*done, F.sort_array(F.transform("c", lambda p: F.struct(F.get("g", p).alias("h"), p.alias("p")))).alias("s"))
    twice = F.filter("s", lambda x, k: F.coalesce(x["h"] == F.get("s", k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("s", k + 1)["h"], F.lit(False)))
    df = df.select(*done, F.sort_array(F.transform(twice, lambda x: x["p"])).alias("r"))
    covered = F.aggregate(F.transform("r", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("r", k + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda s, x: s + x)
    df = df.select(*done, covered.alias("n_repeat_words"))
    return df.select(*(i(n).alias(c) for n, c in zip(names, keep, strict=True)), *(c for c in df.columns if c not in names))


def verdict(rules: tuple = RULES) -> Column:
    """The threshold table as one boolean expression over the measures; a measure without a value passes."""
    passes = []
    for _, measure, least, most in rules:
        part, _, whole = measure.partition(" / ")
        value = F.expr(f"{part} / nullif({whole}, 0)")
        ok = F.lit(True)
        if least is not None:
            ok = ok & (value >= least)
        if most is not None:
            ok = ok & (value <= most)
        passes.append(F.coalesce(ok, F.lit(True)))
    return reduce(lambda x, y: x & y, passes, F.lit(True))


def quality_rules(docs: DataFrame, rules: tuple = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each document with its measures, ``base_failed`` and ``kept``.

    A null or empty text has no words and fails; repeated rows are judged each; other columns of any
    name are left out; an empty table gives no rows.
    """
    df = measured(docs, text, keep)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
