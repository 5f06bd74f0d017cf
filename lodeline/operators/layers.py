"""Values in layers, and what a render needs before it can begin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import semantic_id


def layered_values(layers: DataFrame, profile: str = "profile", ordinal: str = "ordinal", path: str = "path", value: str = "value") -> DataFrame:
    """(profile, path, value) that holds after all layers (leaves of their trees), the one of highest ordinal above all.

    A later layer replaces a leaf by its own leaf, by a tree that begins there, or by a leaf further up.
    Paths meet their beginnings in equi-joins; of equal ordinals the greater value counts.
    """
    last = layers.groupBy(F.col(profile).alias("profile"), F.col(path).alias("path")).agg(F.max(F.struct(F.col(ordinal).alias("o"), F.col(value).alias("v"))).alias("m"))
    last = last.select("profile", "path", F.col("m.o").alias("o"), F.col("m.v").alias("value"))
    parts = F.split("path", r"\.")
    ways = F.transform(F.slice(F.sequence(F.lit(0), F.size(parts) - 1), 2, F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    above = last.select("profile", "o", F.col("path").alias("leaf"), F.explode(ways).alias("path"))
    # What stands above a leaf, and the latest leaf below a place.
    higher = above.join(last.select("profile", "path", F.col("o").alias("later")), ["profile", "path"]).where("later > o").select("profile", F.col("leaf").alias("path"))
    lower = above.groupBy("profile", "path").agg(F.max("o").alias("later"))
    beaten = last.join(lower, ["profile", "path"]).where("later > o").select("profile", "path")
    gone = higher.unionByName(beaten).distinct()
    return last.join(gone, ["profile", "path"], "left_anti").select("profile", "path", "value")


def missing_dependencies(dependencies: DataFrame, children: DataFrame) -> DataFrame:
    """(owner, name) of declared dependencies (owner, name) for which no chart of that name is vendored (parent, child_name)."""
    vendored = children.select(F.col("parent").alias("owner"), F.col("child_name").alias("name")).distinct()
    return dependencies.select("owner", "name").distinct().join(vendored, ["owner", "name"], "left_anti")


def default_profiles(charts: DataFrame, app: str) -> DataFrame:
    """(profile, chart, name) of the profile that every chart has without a configuration."""
    own = charts.select("chart").distinct()
    return own.select(semantic_id(F.lit(app), "default-profile", F.col("chart")).alias("profile"), "chart", F.lit("default").alias("name"))


def numbered(resources: DataFrame, render: str, identity: str, ordinal: str) -> DataFrame:
    """The resources of a render, each under an identity of its own: later ones at one identity carry the number of their document."""
    n = F.row_number().over(Window.partitionBy(render, identity).orderBy(ordinal))
    return resources.withColumn(identity, F.when(n > 1, F.concat_ws(":", F.col(identity).cast("string"), F.col(ordinal).cast("string"))).otherwise(F.col(identity).cast("string")))
