"""Dependencies to charts and packages, calls to templates, references to keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import package_url
from ..functions.versions import met as version_met
from .precedence import resolve_references, winner_fold


def dependency_targets(dependencies: DataFrame, children: DataFrame, listed: bool = False) -> DataFrame:
    """dependency, target chart, package and status of (dependency, owner, name, alias, constraint, repository).

    Candidates share owner and name with the dependency and have a version within its constraint. One
    candidate is the target; several are ambiguous; without one, the
    package names it where the repository is a container registry. ``incompatible`` counts children
    that bear its name or lie in a folder of its name or alias but don't fit; ``listed`` names the candidates.

    Dependencies that ask the same are one question, and children of one owner, name, version and folder
    one answer with their number and smallest. Only those meet, in an equi-join, then the ranges that
    distinct constraints are compiled to; many copies on both sides don't multiply. A dependency or child
    that is there with several of these stands alone, so nothing is counted twice.
    """
    asks, alike = ["owner", "name", "alias", "constraint"], ["owner", "child_name", "version", "folder"]
    d = dependencies.select("dependency", *asks, "repository")
    own = d.where("dependency IS NOT NULL").groupBy("dependency", *asks).agg(F.count("*").alias("times"))
    own = own.withColumn("apart", F.when(F.count("*").over(Window.partitionBy("dependency")) > 1, F.col("dependency"))).withColumn("ask", F.when(F.col("apart").isNull(), F.struct(*asks)))
    # The times of a question asked alone are those of each who asks.
    q = own.groupBy("apart", "ask", *asks).agg(F.max(F.when(F.col("apart").isNotNull(), F.col("times")).otherwise(1)).alias("times"))
    c = children.where("not hidden AND child IS NOT NULL").select(F.col("parent").alias("owner"), "child", "child_name", "version", "folder")
    c = c.groupBy("child", *alike).agg(F.count("*").alias("n"))
    c = c.withColumn("lone", F.when(F.count("*").over(Window.partitionBy("child")) > 1, F.col("child")))
    c = c.groupBy("lone", *alike).agg(F.sum("n").alias("n"), F.count("*").alias("children"), F.min("child").alias("first"), *([F.collect_set("child").alias("every")] if listed else []))
    c = c.withColumn("answer", F.struct(*alike))
    kept = ["apart", "ask", "constraint", "times", "lone", "answer", "version", "n", "children", "first", *(["every"] if listed else [])]
    by_name = q.join(c.withColumnRenamed("owner", "__owner"), (F.col("owner") == F.col("__owner")) & (F.col("name") == F.col("child_name"))).select(*kept, F.lit(True).alias("same"), F.lit(True).alias("named"))
    asked = q.withColumn("folder", F.explode(F.array_distinct(F.filter(F.array("name", "alias"), lambda x: x.isNotNull()))))
    by_folder = asked.join(c, ["owner", "folder"]).select(*kept, F.coalesce(F.col("child_name") == F.col("name"), F.lit(False)).alias("same"), F.lit(False).alias("named"))
    each = version_met(by_name.unionByName(by_folder), "version", "constraint").withColumn("fits", F.col("fits") & F.col("same"))
    fit = F.col("fits") & F.col("named")
    # By whom a question is asked, an answer counts once as a misfit and each time as a candidate.
    each = each.groupBy("apart", "ask", "lone", "answer").agg(
        F.coalesce(F.sum(F.when(fit, F.col("times") * F.col("n"))), F.lit(0)).alias("candidates"), F.min(F.when(fit, F.col("first"))).alias("chart"),
        F.max(F.when(~F.col("fits"), F.col("children"))).alias("misfits"), *([F.first(F.when(fit, F.col("every")), ignorenulls=True).alias("every")] if listed else []),
    )
    bad = F.col("misfits").isNotNull()
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list("every"))))
    met = each.groupBy("apart", "ask").agg(
        F.sum("candidates").alias("candidates"), F.min("chart").alias("chart"), *([every.alias("candidate_charts")] if listed else []),
        (F.coalesce(F.sum(F.when(F.col("lone").isNull(), F.col("misfits"))), F.lit(0)) + F.count_distinct(F.when(bad, F.col("lone")))).alias("incompatible"),
    )
    of = own.select("dependency", "apart", "ask", "times").join(met.withColumnsRenamed({"apart": "__apart", "ask": "__ask"}), F.col("apart").eqNullSafe(F.col("__apart")) & F.col("ask").eqNullSafe(F.col("__ask")))
    of = of.select("dependency", (F.col("candidates") * F.when(F.col("apart").isNull(), F.col("times")).otherwise(1)).alias("candidates"), "chart", "incompatible", *(["candidate_charts"] if listed else [])).dropDuplicates(["dependency"])
    df = d.join(of, "dependency", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0))).withColumn("incompatible", F.coalesce("incompatible", F.lit(0)))
    df = df.withColumn("chart", F.when(F.col("candidates") == 1, F.col("chart"))).withColumn("package", F.when(F.col("candidates") == 0, package_url(F.col("repository"), F.col("name"))))
    status = F.when(F.col("candidates") == 1, "vendored").when(F.col("candidates") > 1, "ambiguous").when(F.col("package").isNotNull(), "package").when(F.col("incompatible") > 0, "incompatible").otherwise("missing")
    return df.select("dependency", "chart", "package", "candidates", "incompatible", status.alias("status"), *(["candidate_charts"] if listed else []))


def template_winners(definitions: DataFrame) -> DataFrame:
    """(tree, name, template) that wins each name of (tree, name, template, depth, path, start, empty).

    Files load deepest first and, equally deep, by falling name, so that the first name at the top
    loads last; a definition that isn't empty replaces the one before. A tree with a file that defines
    one name twice, neither empty, has no winners.
    """
    broken = definitions.where("not empty").groupBy("tree", "template", "name").agg(F.count("*").alias("n")).where("n > 1").select("tree").distinct()
    load = Window.partitionBy("tree", "name").orderBy(F.desc("depth"), F.desc("path"), "start")
    ordered = definitions.join(broken, "tree", "left_anti").withColumn("load", F.row_number().over(load))
    return winner_fold(ordered, ["tree", "name"], [F.col("load")], "template", "empty").select("tree", "name", "template")


def call_targets(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """Calls (call, tree, name) with the template that wins the name in their tree; dynamic names have none."""
    return calls.join(template_winners(definitions), ["tree", "name"], "left")


def possible_winners(sources: DataFrame, definitions: DataFrame, groups: DataFrame) -> DataFrame:
    """(tree, name, target, outcomes, absent): every template that may win a name of a tree, a row each.

    ``sources`` (tree, file, source, group, alternative) are the template files that may stand at a
    place of the tree, those without a group for certain; ``groups`` (tree, group, alternatives) tell
    how many alternatives a group has; ``definitions`` (tree, file, source, group, alternative, name,
    target, start, empty) are what sources define. outcomes: how many may win; absent: whether the name
    may also be undefined (then target may be null, in a row of its own if nothing else may win).

    Places load deepest first and, equally deep, by falling name. A place whose every alternative
    defines the name, not empty, ends all that came before; others add theirs. Empty definitions count
    only while the name may be undefined: until the first place that defines it in any case. So the set
    of winners follows from the last place that ends and the first one that defines, without a fold.
    A tree in which one source defines a name twice, neither empty, has no winners. Rows are shuffled
    once, by tree; all that is counted of a tree's files and names are windows over its rows there.
    """
    at, over = ["tree", "file", "source", "group", "alternative"], Window.partitionBy
    type_of = {f.name: f.dataType for f in (*sources.schema, *definitions.schema)}
    lacks = lambda *names: [F.lit(None).cast(type_of[n]).alias(n) for n in names]
    ours = definitions.where("tree IS NOT NULL").select(*at, "name", "target", "start", "empty", F.lit(None).cast("long").alias("alternatives"), F.lit("definition").alias("what"))
    there = sources.where("tree IS NOT NULL").select(*at, *lacks("name", "target", "start", "empty"), F.lit(None).cast("long").alias("alternatives"), F.lit("source").alias("what"))
    choices = groups.where("tree IS NOT NULL AND group IS NOT NULL").select("tree", *lacks("file", "source"), "group", *lacks("alternative", "name", "target", "start", "empty"), F.col("alternatives").cast("long").alias("alternatives"), F.lit("group").alias("what"))
    each = ours.unionByName(there).unionByName(choices).repartition("tree").groupBy("what", *at, "name").agg(
        F.count_if(~F.col("empty")).alias("full"), F.max_by("target", F.struct(~F.col("empty"), "start", "target")).alias("target"), F.max("alternatives").alias("alternatives")
    )
    defined, is_source = F.col("what") == "definition", F.col("what") == "source"
    each = each.withColumn("alternatives", F.max("alternatives").over(over("tree", "group"))).withColumn("broken", F.max(F.when(defined, F.col("full"))).over(over("tree"))).where("what <> 'group' AND file IS NOT NULL")
    # An alternative counts at its first source.
    each = each.withColumn("nth", F.row_number().over(over("tree", "file", "group", "alternative").orderBy(F.desc("what"), "source", "name")))
    other = is_source & (F.col("nth") == 1) & F.col("alternative").isNotNull()
    each = each.withColumn("present", F.count_if(other).over(over("tree", "file", "group")))
    always = F.max(is_source & (F.col("group").isNull() | F.coalesce(F.col("present") == F.col("alternatives"), F.lit(False)))).over(over("tree", "file"))
    each = each.withColumn("always", always).withColumn("sources", F.count_if(is_source).over(over("tree", "file")))
    each = each.where("what = 'definition' AND broken <= 1").withColumn("full", F.col("full") > 0)
    # The later a place loads, the smaller this is.
    load = F.struct(F.size(F.split("file", "/")), F.col("file"))
    said = over("tree", "file", "name")
    each = each.withColumn("ends", F.when(F.col("always") & (F.count_if("full").over(said) == F.col("sources")), load)).withColumn("defines", F.when(F.col("always") & (F.count("*").over(said) == F.col("sources")), load))
    of = over("tree", "name")
    each = each.withColumn("ends", F.min("ends").over(of)).withColumn("defines", F.max("defines").over(of)).withColumn("placed", F.max(F.col("sources") > 0).over(of)).where("placed")
    fits = F.when(F.col("full"), F.col("ends").isNull() | (load <= F.col("ends"))).otherwise(F.col("ends").isNull() & (F.col("defines").isNull() | (load >= F.col("defines"))))
    each = each.withColumn("fits", fits & F.col("name").isNotNull()).withColumn("absent", F.col("ends").isNull() & F.col("defines").isNull())
    won = each.groupBy("tree", "name", "absent", "fits", F.when(F.col("fits"), F.col("target")).alias("target")).agg(F.lit(1).alias("one")).withColumn("n", F.count_if("fits").over(of))
    return won.where("fits OR n = 0").select("tree", "name", "target", (F.col("n") + F.col("absent").cast("int")).alias("outcomes"), "absent")


def certain_callers(sources: DataFrame, groups: DataFrame) -> DataFrame:
    """(tree, source) of the files that are in every possible render of their tree, whose calls may have a target.

    Such a file stands at some place for certain, alone there; a file that is there only by a choice,
    or shares its place with another one, is not.
    """
    present = sources.groupBy("tree", "file", "group").agg(F.count_distinct("alternative").alias("present"), F.min("source").alias("low"), F.max("source").alias("high")).join(groups, ["tree", "group"], "left")
    always = F.coalesce(F.bool_or(F.col("group").isNull() | (F.col("present") == F.col("alternatives"))), F.lit(False))
    places = present.groupBy("tree", "file").agg(always.alias("always"), F.min("low").alias("low"), F.max("high").alias("high"))
    certain = sources.where("group IS NULL").select("tree", "source").distinct()
    return places.where("always AND low = high").select("tree", F.col("low").alias("source")).distinct().join(certain, ["tree", "source"], "left_semi")


def value_targets(references: DataFrame, keys: DataFrame) -> DataFrame:
    """References (chart, path) with the key of the strongest values file of the chart, where it is one."""
    return resolve_references(references, keys, ["chart", "path"], "priority", "key")


def unique_regions(documents: DataFrame, regions: DataFrame, file: str = "file", region: str = "region") -> DataFrame:
    """Rendered documents with the region of their file, where the file has exactly one."""
    only = regions.groupBy(file).agg(F.count("*").alias("n"), F.first(region).alias(region)).where("n = 1").drop("n")
    return documents.join(only, file, "left")
