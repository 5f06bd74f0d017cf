"""Documents inside template files: regions between separators, without what only defines or controls.

A file falls into pieces (actions, comments and the text between them) and these into the lines they
touch; everything else is a sweep over places: running sums give offsets, running counts the document,
and aggregates over a document's pieces where it begins, ends, and whether it says anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .documents import ACTION

#: A comment, or any other action.
TOKEN = r"(?s)\{\{-?\s*/\*.*?\*/\s*-?\}\}|" + ACTION.removeprefix("(?s)")
#: Keywords of actions that write nothing themselves.
SILENT = ("if", "range", "with", "else", "end", "define")
_MARKER = r"^(?:---|\.\.\.)(?:[ \t]\s*(?:#.*)?)?\r?\z"


def template_pieces(templates: DataFrame) -> DataFrame:
    """(artifact_id, piece, text, token, start, stop, line, kind, defining, define_start, define_stop) of the pieces of ``source``.

    Offsets are bytes, lines count from 1. kind: the keyword of an action, ``comment``, or null.
    defining: whether the piece belongs to a ``define`` that is closed, whose range its first piece holds.
    """
    cut = templates.where(F.col("source") != "").select("artifact_id", F.monotonically_increasing_id().alias("file"), F.regexp_extract_all("source", F.lit(TOKEN), F.lit(0)).alias("found"), F.split("source", TOKEN, -1).alias("between"))
    pair = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("between") - 1).alias("nth"), F.col("between"), F.col("found")))
    each = cut.select("artifact_id", "file", pair.alias("x")).select("artifact_id", "file", F.explode(F.array(F.struct((F.col("x.nth") * 2).alias("piece"), F.col("x.between").alias("text"), F.lit(False).alias("token")), F.struct((F.col("x.nth") * 2 + 1).alias("piece"), F.col("x.found").alias("text"), F.lit(True).alias("token")))).alias("p"))
    each = each.select("artifact_id", "file", "p.*").where("text IS NOT NULL AND text <> ''")
    sofar = Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    word = F.regexp_extract("text", r"^\{\{-?\s*(/\*|[a-z]+\b)", 1)
    kind = F.when(F.col("token"), F.when(word == "/*", "comment").otherwise(F.nullif(word, F.lit(""))))
    at = each.withColumn("stop", F.sum(F.octet_length("text")).over(sofar)).withColumn("line", F.sum(breaks).over(sofar) - breaks + 1).withColumn("kind", kind)
    at = at.withColumn("start", F.col("stop") - F.octet_length("text"))
    step = F.when(F.col("kind").isin("define", "block", "if", "range", "with"), 1).when(F.col("kind") == "end", -1).otherwise(0)
    at = at.withColumn("step", step).withColumn("level", F.sum("step").over(sofar) + (F.col("step") < 0).cast("int"))
    # Of those that open or close on one level, each closes the one before it.
    turn = Window.partitionBy("file", "level", F.col("step") != 0).orderBy("piece")
    ends = F.when((F.col("kind") == "define") & (F.lead("kind").over(turn) == "end"), F.lead("stop").over(turn))
    at = at.withColumn("define_stop", ends).withColumn("define_start", F.when(F.col("define_stop").isNotNull(), F.col("start")))
    at = at.withColumn("defining", F.coalesce(F.max("define_stop").over(sofar) >= F.col("stop"), F.lit(False)))
    return at.drop("step", "level")


def _fragments(pieces: DataFrame) -> DataFrame:
    """The pieces cut at line feeds: (piece, nth) and their start, line and ``part`` of the text."""
    parts = F.posexplode(F.split("text", "\n", -1)).alias("nth", "part")
    each = pieces.select("artifact_id", "file", "piece", "token", "kind", "defining", F.col("start").alias("base"), F.col("line").alias("first"), parts)
    sofar = Window.partitionBy("file", "piece").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("start", F.col("base") + F.sum(F.octet_length("part") + 1).over(sofar) - F.octet_length("part") - 1)
    return each.withColumn("line", F.col("first") + F.col("nth"))


def template_regions(templates: DataFrame) -> DataFrame:
    """(artifact_id, nth, start, stop, first_line) of the documents of each template file (artifact_id, source), nth from 0.

    Lines of ``---`` or ``...`` separate documents, unless they begin inside an action or a ``define``.
    A ``define`` (with the white space that it trims) at the beginning or end of a document isn't part of it.
    Documents of which nothing is left but white space, comments, and actions that only control are no
    regions. Offsets are bytes; empty files have none.
    """
    pieces = template_pieces(templates)
    fragments = _fragments(pieces)
    line, place = Window.partitionBy("file", "line"), F.struct("piece", "nth")
    first = place == F.min(F.when(F.col("part") != "", place)).over(line)
    # Behind a comment's sign a separator's line may hold anything.
    alone = (F.count_if(F.col("part") != "").over(line) == 1) | F.contains("part", F.lit("#"))
    marks = fragments.withColumn("boundary", F.coalesce(first & alone & ~F.col("token") & ~F.col("defining") & F.col("part").rlike(_MARKER), F.lit(False)))
    marks = marks.withColumn("apart", F.bool_or("boundary").over(line)).withColumn("end", F.max(F.col("start") + F.octet_length("part")).over(line))
    solid = F.col("part").rlike(r"\S")
    blank = F.octet_length(F.regexp_extract("part", r"^\s*", 0))
    tail = F.octet_length(F.regexp_extract("part", r"\s*\z", 0))
    rows = marks.withColumn("lead", F.when(solid, F.col("start") + blank)).withColumn("trail", F.when(solid, F.col("start") + F.octet_length("part") - tail))
    sweep = Window.partitionBy("file").orderBy("piece", "nth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("document", F.sum(F.col("boundary").cast("int")).over(sweep))
    written = ~F.col("defining") & ~F.col("apart")
    shown = written & ~F.coalesce(F.col("kind").isin("comment", *SILENT), F.lit(False))
    seen = F.when(shown & solid, F.struct("lead", F.regexp_extract("part", r"(\S)", 1).alias("sign")))
    says = rows.groupBy("file", "document", "line").agg(F.min(seen).alias("first")).where("first IS NOT NULL AND first.sign <> '#'").select("file", "document", F.col("first.lead").alias("said"), "line")
    after = F.max(F.when(F.col("boundary"), F.col("end") + 1))
    docs = rows.groupBy("artifact_id", "file", "document").agg(
        F.coalesce(after, F.lit(0)).alias("start"), F.max(F.col("start") + F.octet_length("part")).alias("stop"),
        F.min(F.when(written, F.col("lead"))).alias("head"), F.max(F.when(written, F.col("trail"))).alias("tail"), F.max(F.when(F.col("boundary"), F.col("start"))).alias("mark"),
    )
    # A document ends where the separator of the next one begins.
    docs = docs.withColumn("stop", F.coalesce(F.lead("mark").over(Window.partitionBy("file").orderBy("document")), "stop"))
    ranges = _define_ranges(pieces)
    # Which document a range stands in: the last that begins before it.
    spots = docs.select("file", "document", F.col("start").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))
    spots = spots.unionByName(ranges.select("file", F.lit(None).cast("long").alias("document"), (F.col("b") - 1).alias("at"), F.lit(1).alias("kind"), "a", "b"))
    placed = spots.withColumn("document", F.last("document", ignorenulls=True).over(Window.partitionBy("file").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))).where("kind = 1").select("file", "document", "a", "b")
    trims = docs.join(placed, ["file", "document"]).groupBy("file", "document").agg(
        F.max(F.when((F.col("a") < F.col("head")) & (F.col("b") <= F.col("stop")), F.col("b"))).alias("low"), F.min(F.when(F.col("a") >= F.col("tail"), F.col("a"))).alias("high")
    )
    docs = docs.join(trims, ["file", "document"], "left")
    docs = docs.withColumn("start", F.greatest("start", F.coalesce("low", "start"))).withColumn("stop", F.least("stop", F.coalesce("high", "stop")))
    kept = docs.join(says, ["file", "document"]).where("said >= start AND said < stop").groupBy("artifact_id", "file", "document").agg(F.min("start").alias("start"), F.min("stop").alias("stop"), F.min("line").cast("int").alias("first_line"))
    nth = F.row_number().over(Window.partitionBy("file").orderBy("document")) - 1
    return kept.select("artifact_id", nth.alias("nth"), "start", "stop", "first_line")


def _define_ranges(pieces: DataFrame) -> DataFrame:
    """(file, a, b) of what defines take, with the white space that they trim; ranges that touch are one."""
    order = Window.partitionBy("file").orderBy("piece")
    near = pieces.withColumn("before", F.lag(F.when(~F.col("token"), F.col("text"))).over(order)).withColumn("after", F.lead(F.when(~F.col("token"), F.col("text"))).over(order))
    left = F.when(F.startswith("text", F.lit("{{-")), F.octet_length(F.regexp_extract("before", r"[ \t\r\n]*\z", 0)))
    right = F.when(F.endswith("text", F.lit("-}}")), F.octet_length(F.regexp_extract("after", r"^[ \t\r\n]*", 0)))
    opens = near.where("define_start IS NOT NULL").select("file", (F.col("define_start") - F.coalesce(left, F.lit(0))).alias("a"), F.col("define_stop").alias("stop"))
    closes = near.where("kind = 'end'").select("file", "stop", F.coalesce(right, F.lit(0)).alias("more"))
    spans = opens.join(closes, ["file", "stop"]).select("file", "a", (F.col("stop") + F.col("more")).alias("b"))
    before = Window.partitionBy("file").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.max("b").over(before) < F.col("a"), F.lit(True))
    island = F.sum(fresh.cast("int")).over(Window.partitionBy("file").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("island", island).groupBy("file", "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("island")
