"""Which charts a tree holds: dependencies switched by conditions and tags, walked from each root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import encode_value_segment
from ..functions.tables import written
from .ownership import walk
from .precedence import agreed_boolean


def switches(keys: DataFrame) -> DataFrame:
    """(chart, path, value): what the strongest values files of a chart agree on, of (chart, path, priority, kind, text)."""
    said = keys.where("kind = 'bool'").withColumn("value", F.lower("text").isin("true", "yes", "on"))
    return agreed_boolean(said, ["chart", "path"], "priority", "value").where("value IS NOT NULL")


def links(children: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(parent, child, name, dependency, choice) of every way from a chart to one below it.

    A dependency leads to its candidate under its alias or name; with several candidates it leads to
    each, and ``choice`` is the dependency. A vendored chart that is no candidate of any dependency of
    its parent is there by itself, under its own name.
    """
    asked = dependencies.select("dependency", F.col("owner").alias("parent"), F.size("candidate_charts").alias("candidates"), F.coalesce(F.nullif("alias", F.lit("")), "name").alias("name"), F.explode("candidate_charts").alias("child"))
    named = asked.select("parent", "child", "name", "dependency", F.when(F.col("candidates") > 1, F.col("dependency")).alias("choice")).distinct()
    taken = asked.select("parent", "child").distinct()
    alone = children.where("not hidden").join(taken, ["parent", "child"], "left_anti").select("parent", "child", F.col("child_name").alias("name"), F.lit(None).cast("string").alias("dependency"), F.lit(None).cast("string").alias("choice"))
    return named.unionByName(alone)


def _path(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, r"\."), encode_value_segment), ".")


def trees(links: DataFrame, roots: DataFrame, dependencies: DataFrame, values: DataFrame) -> DataFrame:
    """(tree, chart, depth, names, group, alternative) of the charts that are switched on below each root, the root itself included.

    Charts below a dependency with several candidates are possible ones: they have its ``group`` and
    the ``alternative`` (candidate) that they come with; of others both are null.

    Of a dependency's conditions (joined by commas) the first that is found decides: below the names
    that lead to its owner in the root's values, else in its owner's. Without one, its tags (found in
    the root's values, else its owner's) switch it off if one says off and none says on. A dependency
    that is off takes the vendored chart of its name along, and all that is below.
    """
    steps = written(walk(links, roots, name="name", choice="choice").withColumnRenamed("root", "tree"), "steps")
    here = steps.select("tree", F.col("node").alias("owner"), F.col("names").alias("above"), "path")
    name = F.coalesce(F.nullif("alias", F.lit("")), "name")
    switched = dependencies.where("condition <> '' OR size(tags) > 0").select("owner", "dependency", name.alias("name"), F.trim(F.coalesce("condition", F.lit(""))).alias("condition"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    at = here.join(switched, "owner").withColumnRenamed("path", "way")
    prefix = F.concat(F.array_join(F.transform("above", encode_value_segment), "."), F.lit("."))
    place = ["tree", "owner", "way", "dependency", "name"]
    condition = at.select(*place, "above", F.posexplode(F.split("condition", ",")).alias("position", "c")).where("c <> ''")
    asked = condition.withColumn("asks", F.array(F.struct(F.col("tree").alias("chart"), F.when(F.size("above") > 0, F.concat(prefix, _path(F.col("c")))).alias("path")), F.struct(F.col("owner").alias("chart"), _path(F.col("c")).alias("path"))))
    asked = asked.select(*place, "position", F.posexplode("asks").alias("second", "ask")).select(*place, "position", "second", "ask.chart", "ask.path")
    decided = asked.join(values, ["chart", "path"]).groupBy(*place).agg(F.min_by("value", F.struct("position", "second")).alias("decided"))
    tag = at.select(*place, F.explode("tags").alias("tag")).withColumn("path", F.concat(F.lit("tags."), _path(F.col("tag"))))
    both = tag.select(*place, "tag", "path", F.posexplode(F.array("tree", "owner")).alias("second", "chart")).join(values, ["chart", "path"])
    each = both.groupBy(*place, "tag").agg(F.min_by("value", "second").alias("value"))
    votes = each.groupBy(*place).agg((F.bool_or("value") | ~F.bool_or(~F.col("value"))).alias("vote"))
    off = at.select(*place).join(decided, place, "left").join(votes, place, "left").where(~F.coalesce("decided", "vote", F.lit(True)))
    off = written(off.select("tree", "way", "name").distinct(), "off")
    # Whatever a name that is off leads to, from where it is off, is off too.
    taken = F.transform(F.sequence(F.lit(1), F.col("depth")), lambda n: F.struct(F.slice("path", F.lit(1), n).alias("way"), F.get("names", n - 1).alias("name")))
    below = steps.where("depth > 0").select("tree", "path", "names", F.explode(taken).alias("x")).select("tree", "path", "names", "x.way", "x.name").join(off, ["tree", "way", "name"], "left_semi")
    gone = below.select("tree", "path", "names").distinct()
    return steps.join(gone, ["tree", "path", "names"], "left_anti").select("tree", F.col("node").alias("chart"), "depth", "names", "group", "alternative")
