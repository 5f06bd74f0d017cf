"""Which of several declarations counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pick_by_precedence(df: DataFrame, keys: list[str], priority: str, target: str) -> DataFrame:
    """keys, the target of highest priority where it is the only one, and how many there are there."""
    top = df.withColumn("__rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(priority)))).where("__rank = 1")
    best = top.groupBy(*keys).agg(F.count("*").alias("candidates"), F.min(target).alias("__target"))
    return best.select(*keys, F.when(F.col("candidates") == 1, F.col("__target")).alias(target), "candidates")


def resolve_references(references: DataFrame, declarations: DataFrame, keys: list[str], priority: str, target: str) -> DataFrame:
    """References with their target and a status: resolved, ambiguous or missing."""
    picked = pick_by_precedence(declarations, keys, priority, target)
    status = F.when(F.col("candidates").isNull(), "missing").when(F.col("candidates") > 1, "ambiguous").otherwise("resolved")
    return references.join(picked, keys, "left").withColumn("status", status)


def agreed_boolean(df: DataFrame, keys: list[str], priority: str, value: str) -> DataFrame:
    """The boolean of highest priority; null where equals in rank disagree."""
    top = df.where(F.col(value).isNotNull()).withColumn("__rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(priority)))).where("__rank = 1")
    return top.groupBy(*keys).agg(F.min(value).alias("__low"), F.max(value).alias("__high")).select(*keys, F.when(F.col("__low") == F.col("__high"), F.col("__low")).alias(value))


def tag_vote(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """On where a tag says so or none says off."""
    return df.groupBy(*keys).agg(F.coalesce(F.bool_or(value), F.lit(False)).alias("__on"), F.coalesce(F.bool_or(~F.col(value)), F.lit(False)).alias("__off")).select(*keys, (F.col("__on") | ~F.col("__off")).alias("enabled"))


def enabled(votes: DataFrame, conditions: DataFrame, keys: list[str], position: str = "position", value: str = "value") -> DataFrame:
    """The first condition found decides, else the tags' vote."""
    first = conditions.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, position).alias("__first"))
    return votes.join(first, keys, "full").select(*keys, F.coalesce("__first", "enabled", F.lit(True)).alias("enabled"))


def winner_fold(definitions: DataFrame, keys: list[str], order: list, target: str, empty: str) -> DataFrame:
    """Each name's winner when definitions load in order: a later one that isn't empty replaces, an empty one only fills."""
    place = F.struct(*order)
    best = definitions.groupBy(*keys).agg(
        F.max_by(target, F.when(~F.col(empty), place)).alias("__last"),
        F.min_by(target, F.when(F.col(empty), place)).alias("__first"),
        F.count("*").alias("definitions"),
    )
    return best.select(*keys, F.coalesce("__last", "__first").alias(target), "definitions")


def ordinals(df: DataFrame, keys: list[str], order: list, into: str = "ordinal", width: int = 4) -> DataFrame:
    """Zero-padded positions from 0 within each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    text = n.cast("string")
    return df.withColumn(into, F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text))


def occurrences(df: DataFrame, place: list[str], order: list, into: str = "nth") -> DataFrame:
    """Numbers (from 1) of facts at one place, in the order met."""
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*place).orderBy(*order)))
