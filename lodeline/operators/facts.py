"""Algebra of facts: unions that check for conflicts, integrity, staleness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conflicts(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Keys that the union of the frames holds with different values."""
    every = reduce(DataFrame.unionByName, frames)
    rest = [c for c in every.columns if c not in keys]
    return every.groupBy(*keys).agg(F.count_distinct(F.struct(*[F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in rest])).alias("versions")).where("versions > 1")


def conflict_checked_union(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """The union of facts, each key once; raises where two frames disagree, before anything is returned."""
    found = conflicts(frames, keys).take(5)
    if found:
        raise ValueError(f"conflicting facts: {[tuple(r) for r in found]}")
    return reduce(DataFrame.unionByName, frames).dropDuplicates(keys)


def filled_targets(facts: DataFrame, patch: DataFrame, key: str, target: str) -> DataFrame:
    """Facts whose missing target the patch gives; a column ``conflict`` where the two, or patches of one fact, differ."""
    p = patch.where(F.col(target).isNotNull()).groupBy(key).agg(F.min(target).alias("__new"), F.max(target).alias("__other"))
    df = facts.join(p, key, "left")
    clash = F.coalesce((F.col(target) != F.col("__new")) | (F.col("__new") != F.col("__other")), F.lit(False))
    return df.withColumn("conflict", clash).withColumn(target, F.coalesce(target, "__new")).drop("__new", "__other")


def dangling(edges: DataFrame, nodes: DataFrame, node: str = "id", src: str = "src", dst: str = "dst") -> DataFrame:
    """(src, dst, missing) of edges with an end that is no node."""
    known = nodes.select(F.col(node).alias("__id")).distinct()
    ends = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.explode(F.array(F.struct(F.lit("src").alias("missing"), F.col(src).alias("__id")), F.struct(F.lit("dst").alias("missing"), F.col(dst).alias("__id")))).alias("e")).select("src", "dst", "e.missing", "e.__id")
    return ends.join(known, "__id", "left_anti").select("src", "dst", "missing")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def containment(nodes: DataFrame, edges: DataFrame, node: str, dst: str) -> DataFrame:
    """Nodes that don't have exactly one edge from a parent, with how many they have."""
    n = edges.groupBy(F.col(dst).alias(node)).agg(F.count("*").alias("parents"))
    return nodes.select(node).distinct().join(n, node, "left").select(node, F.coalesce("parents", F.lit(0)).cast("long").alias("parents")).where("parents <> 1")


def broken_ordinals(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Keys whose ordinals aren't 0, 1, 2 and so on, each once."""
    stats = df.groupBy(*keys).agg(F.min(ordinal).alias("low"), F.max(ordinal).alias("high"), F.count("*").alias("n"), F.count_distinct(ordinal).alias("distinct_n"))
    return stats.where("low <> 0 OR high <> n - 1 OR distinct_n <> n")


def merged_nodes(nodes: DataFrame, node: str = "id", labels: str = "labels") -> DataFrame:
    """One row per node: the sorted union of its contributions' labels."""
    return nodes.groupBy(node).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(labels)))).alias(labels), F.count("*").alias("contributions"))


def property_conflicts(properties: DataFrame, node: str = "id", name: str = "name", value: str = "value") -> DataFrame:
    return properties.groupBy(node, name).agg(F.count_distinct(value).alias("versions")).where("versions > 1")


def stale(existing: DataFrame, desired: DataFrame, keys: list[str]) -> DataFrame:
    """What exists and is wanted no more."""
    return existing.join(desired.select(*keys).distinct(), keys, "left_anti")


def guarded(inventory: DataFrame, existing: DataFrame, key: str, digest: str, content: str) -> DataFrame:
    """The inventory with content blanked where another digest is known already; of several known ones any that differs counts."""
    e = existing.groupBy(key).agg(F.min(digest).alias("__known"), F.max(digest).alias("__other"))
    clash = F.coalesce((F.col(digest) != F.col("__known")) | (F.col(digest) != F.col("__other")), F.lit(False))
    return inventory.join(e, key, "left").withColumn("conflict", clash).withColumn(content, F.when(clash, F.lit("")).otherwise(F.col(content))).drop("__known", "__other")


def span_violations(df: DataFrame, start: str = "start", end: str = "end", size: str = "size") -> DataFrame:
    """Spans that begin before 0, end before they begin, or end beyond the content."""
    return df.where((F.col(start) < 0) | (F.col(end) < F.col(start)) | (F.col(end) > F.col(size)))


def alias_violations(aliases: DataFrame, nodes: DataFrame, alias: str, target: str, node: str) -> DataFrame:
    """(alias, target, rule) of aliases whose target is another alias, or nothing."""
    names = aliases.select(F.col(alias).alias(target)).distinct()
    chains = aliases.join(names, target, "left_semi").select(alias, target, F.lit("chain").alias("rule"))
    lost = aliases.join(names, target, "left_anti").join(nodes.select(F.col(node).alias(target)).distinct(), target, "left_anti")
    return chains.unionByName(lost.select(alias, target, F.lit("missing").alias("rule")))
