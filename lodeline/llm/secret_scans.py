"""Secret scans: patterns give spans, and corpus-wide ownership frequency adds those that one owner alone holds.

All work is DataFrame functions: matches and what lies between them give the positions of spans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def _either(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
#: Base kinds in their order: pattern, the group whose length counts, its least length.
KINDS = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))
#: What else may be a credential: long runs that mix letters and digits.
RUN = "[A-Za-z0-9+/_=-]{20,}+"
#: Owners, and repositories of theirs, up to which a value counts as theirs; beyond it is a widely copied example.
MOST_OWNERS, MOST_REPOSITORIES = 2, 8
#: Spans that are appended to at a time; full ones are put aside, so that the work grows with the matches.
PART = 512
SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


def spans(text: Column, pattern: str, group: int, least: int, rank: int) -> Column:
    """Spans (code points, end exclusive) of leftmost non-overlapping matches whose group has ``least`` characters."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    lengths = F.zip_with(F.slice(between, 1, F.size(whole)), F.zip_with(whole, value, lambda w, v: F.struct(w.alias("w"), v.alias("v"))), lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m["w"]).alias("n"), m["v"].alias("v")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("part"), F.array().cast(f"array<{SPAN}>").alias("full"))

    def step(acc: Column, m: Column) -> Column:
        first = acc["at"] + m["gap"]
        span = F.struct(first.alias("start"), F.lit(rank).alias("rank"), (first + m["n"]).alias("end"), m["v"].alias("value"))
        holds, filled = F.length(m["v"]) >= least, F.size(acc["part"]) >= PART
        part = F.when(~holds, acc["part"]).when(filled, F.array(span)).otherwise(F.array_append(acc["part"], span))
        return F.struct((first + m["n"]).alias("at"), part.alias("part"), F.when(holds & filled, F.array_append(acc["full"], acc["part"])).otherwise(acc["full"]).alias("full"))

    found = F.aggregate(lengths, start, step, lambda acc: F.flatten(F.array_append(acc["full"], acc["part"])))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def joined(found: Column, names: tuple[str, ...]) -> Column:
    """``kind:start:end`` of the spans by start, then kind, joined with commas."""
    kinds = F.array(*(F.lit(n) for n in names))
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _overlaps(x: Column, base: Column) -> Column:
    return F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))


def found_in(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: str = "source", owner: str = "source") -> DataFrame:
    """doc_id, base spans, further candidates, repository and owner of each document, written once."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(F.col(doc_id).alias("doc_id"), F.col(repository).alias("repository"), F.col(owner).alias("owner"), t.alias("t"), F.xxhash64(t).alias("text_hash"))
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        # Short runs of hex are all over prose; longer ones alone can match.
        quick = pattern if kind != "hex" else "[0-9a-f]{16}"
        df = df.withColumn(kind, F.when(F.col("t").rlike(quick), spans(F.col("t"), pattern if kind != "hex" else "[0-9a-f]{16,}+", group, least, rank)).otherwise(F.array().cast(SPAN)))
    df = df.withColumn("base", F.concat(*(k[0] for k in KINDS)))
    run = spans(F.col("t"), RUN, 0, 20, len(KINDS))
    more = F.filter(run, lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Z]") & x["value"].rlike("[a-z]"))
    df = df.withColumn("more", F.when(F.col("t").rlike(RUN), more).otherwise(F.array().cast(SPAN)))
    df = df.withColumn("more", F.filter("more", lambda x: ~_overlaps(x, F.col("base"))))
    return df.select("doc_id", "text_hash", "repository", "owner", "base", "more")


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repositories, n_owners of every candidate value of the corpus; unknown owners count as one."""
    values = found.select("repository", "owner", F.explode(F.array_distinct(F.transform(F.concat("base", "more"), lambda x: F.md5(x["value"].cast("binary"))))).alias("hash"))
    each = values.select("hash", F.coalesce("repository", F.lit("")).alias("repository"), F.coalesce("owner", F.lit("")).alias("owner")).distinct()
    return each.groupBy("hash").agg(F.count_distinct("repository").alias("n_repositories"), F.count_distinct("owner").alias("n_owners"))


def secret_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: str = "source", owner: str = "source", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """Each document's spans: base ones, and runs mixing letters and digits that few owners hold.

    Columns: doc_id, base and found (arrays of start, rank of the kind, end, value), n_live and n_copied
    (base values that few, or many, owners hold). Null or empty texts have no spans; repeated rows and
    null ids are scanned each; a null owner is an owner of its own kind; other columns are left out;
    an empty table gives no rows.
    Ownership is counted over distinct (value, owner) pairs, so a value repeated by one hot source
    weighs one; joins are by value and by document, which adaptive execution can split.
    """
    found = written(found_in(docs, doc_id, text, repository, owner), "spans")
    known = ownership(found).where((F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories)).select("hash")
    held = found.where(F.size(F.concat("base", "more")) > 0).select("doc_id", F.explode(F.array_distinct(F.transform(F.concat("base", "more"), lambda x: F.md5(x["value"].cast("binary"))))).alias("hash")).distinct()
    live = held.join(known, "hash").groupBy("doc_id").agg(F.collect_set("hash").alias("live")).withColumnRenamed("doc_id", "of")
    df = found.join(live, F.col("doc_id").eqNullSafe(F.col("of")), "left").withColumn("live", F.coalesce("live", F.array().cast("array<string>")))
    is_live = lambda x: F.array_contains("live", F.md5(x["value"].cast("binary")))
    return df.select(
        "doc_id",
        "text_hash",
        "base",
        F.concat("base", F.filter("more", is_live)).alias("found"),
        F.size(F.filter("base", is_live)).cast("long").alias("n_live"),
        F.size(F.filter("base", lambda x: ~is_live(x))).cast("long").alias("n_copied"),
    )


def redacted(docs: DataFrame, mark: str = "[secret]", doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with every span found replaced by ``mark``; null texts stay null, other columns as they are."""
    scan = secret_scan(docs, doc_id, text, **options).where(F.size("found") > 0)
    marks = scan.groupBy(F.col("doc_id").alias("__of"), F.col("text_hash").alias("__hash")).agg(F.first("found").alias("__found"))
    t = F.col(text)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        out = F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.substring(t, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    clean = F.aggregate(F.array_sort("__found"), start, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    df = docs.join(marks, F.col(doc_id).eqNullSafe(F.col("__of")) & (F.xxhash64(F.coalesce(t, F.lit(""))) == F.col("__hash")), "left")
    return df.withColumn(text, F.when(F.col("__found").isNull(), t).otherwise(clean)).select(*docs.columns)


def digest(df: DataFrame) -> DataFrame:
    """Counts of each base kind, the SHA-256 of the base spans and all spans as text."""
    base, every = tuple(k[0] for k in KINDS), (*(k[0] for k in KINDS), "owned")

    def of(rank: int) -> Column:
        return F.size(F.filter("base", lambda x: x["rank"] == rank)).cast("long")

    counts = [of(rank).alias(f"n_{kind}") for rank, kind in enumerate(base)]
    return df.select("doc_id", *counts, F.sha2(joined(F.col("base"), base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found"), every).alias("spans"), "n_live", "n_copied")
