"""Who owns what on a tree of paths: nearest ancestors, parents and children, walks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.identity import ancestors, base_name, parent_dir
from ..functions.tables import written


def nearest_ancestor(df: DataFrame, path: str, anchors: DataFrame, directory: str, anchor: str) -> DataFrame:
    """``df`` with the ``anchor`` of the nearest folder above ``path``, null without one.

    Each path offers its folders to an equi-join; no prefix comparison, so nothing is nested-looped.
    Of several anchors in one folder the smallest counts.
    """
    at = anchors.groupBy(F.col(directory).alias("__dir")).agg(F.min(anchor).alias(anchor))
    above = df.select(path).distinct().select(path, F.posexplode(ancestors(F.col(path))).alias("__up", "__dir"))
    best = above.join(at, "__dir").groupBy(path).agg(F.min_by(anchor, "__up").alias(anchor))
    return df.join(best, path, "left")


def vendored_children(charts: DataFrame, chart: str = "chart", directory: str = "directory") -> DataFrame:
    """(parent, child, folder, hidden) of charts that lie in ``<parent>/charts/<folder>``; ``_`` and ``.`` folders are hidden."""
    child = charts.select(F.col(chart).alias("child"), F.col(directory).alias("d"))
    child = child.where(base_name(parent_dir(F.col("d"))) == "charts").select("child", base_name(F.col("d")).alias("folder"), parent_dir(parent_dir(F.col("d"))).alias("at"))
    parent = charts.select(F.col(chart).alias("parent"), F.col(directory).alias("at"))
    return child.join(parent, "at").select("parent", "child", "folder", F.col("folder").rlike("^[_.]").alias("hidden"))


def walk(edges: DataFrame, roots: DataFrame, parent: str = "parent", child: str = "child", root: str = "root", name: str | None = None, choice: str | None = None) -> DataFrame:
    """(root, node, depth, path) reached from each root, with ``name`` also the names of the edges taken; a branch ends where it meets itself.

    With ``choice``, which says of an edge what it is one of several alternatives for (null: it is the
    only one), also ``group`` and ``alternative``: the first such choice on the way and the node taken.
    Spark's limits on the levels and rows of a recursion are lifted for the session: it ends by itself.
    """
    spark = edges.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "-1")
    tag = uuid.uuid4().hex[:12]
    own = [F.col(parent).alias("p"), F.col(child).alias("c"), (F.col(name) if name else F.lit("")).alias("n"), (F.col(choice) if choice else F.lit(None)).cast("string").alias("o")]
    edges.select(*own).createOrReplaceTempView(f"edges_{tag}")
    roots.select(F.col(root).alias("r")).createOrReplaceTempView(f"roots_{tag}")
    group = "coalesce(t.group, CASE WHEN e.o IS NOT NULL THEN concat_ws('|', cast(t.node AS string), array_join(t.names, '/'), e.o) END)"
    return spark.sql(
        f"""WITH RECURSIVE t(root, node, depth, path, names, group, alternative) AS (
              SELECT r, r, 0, array(r), cast(array() AS array<string>), cast(null AS string), cast(null AS string) FROM roots_{tag}
              UNION ALL
              SELECT t.root, e.c, t.depth + 1, array_append(t.path, e.c), {"array_append(t.names, e.n)" if name else "t.names"}, {group}, coalesce(t.alternative, CASE WHEN e.o IS NOT NULL THEN cast(e.c AS string) END)
              FROM t JOIN edges_{tag} e ON e.p = t.node WHERE NOT array_contains(t.path, e.c))
            SELECT root, node, depth, path{", names" if name else ""}{", group, alternative" if choice else ""} FROM t"""
    )


def _on_circles(edges: DataFrame) -> DataFrame:
    """Edges (parent, child) but those that lead nowhere or that nothing leads to, round after round; what lies on a circle stays."""
    for end, other in (("child", "parent"), ("parent", "child")):
        left = edges.count()
        while left:
            edges = written(edges.join(edges.select(F.col(other).alias(end)).distinct(), end, "left_semi").select("parent", "child"), "edges")
            before, left = left, edges.count()
            if left == before:
                break
    return edges


def ways(edges: DataFrame, roots: DataFrame, parent: str = "parent", child: str = "child", root: str = "root") -> DataFrame:
    """(root, node, depth, ways): on how many ways ``walk`` reaches each node in each depth.

    Ways are counted level by level and not listed: all that reach one node go on as one row with their
    number. Only where nodes may lie on a circle is it kept which of those a way has met, as it ends
    where it meets itself. Each level is a table of its own, so work and tables grow with the nodes that are reached.
    """
    kind = roots.schema[root].dataType
    own = edges.select(F.col(parent).cast(kind).alias("parent"), F.col(child).cast(kind).alias("child")).where("parent <> child")
    own = written(own.groupBy("parent", "child").agg(F.count("*").alias("n")), "edges")
    circles = _on_circles(own.select("parent", "child"))
    on = circles.select(F.explode(F.array("parent", "child")).alias("node"), F.lit(True).alias("on")).distinct()
    own = written(own.join(on.withColumnRenamed("node", "child"), "child", "left").select("parent", "child", "n", F.coalesce("on", F.lit(False)).alias("on")), "edges")
    none = F.array().cast(ArrayType(kind))
    start = roots.groupBy(F.col(root).alias("node")).agg(F.count("*").alias("ways")).join(on, "node", "left")
    at = written(start.select(F.col("node").alias("root"), "node", F.when(F.col("on"), F.array("node")).otherwise(none).alias("met"), "ways"), "ways")
    levels, depth = [], 0
    while not at.isEmpty():
        levels.append(at.groupBy("root", "node").agg(F.sum("ways").alias("ways")).select("root", "node", F.lit(depth).alias("depth"), "ways"))
        if len(levels) == 64:
            levels = [written(reduce(DataFrame.unionByName, levels), "ways")]
        further = at.join(own, F.col("node") == F.col("parent")).where(~F.col("on") | ~F.array_contains("met", F.col("child")))
        met = F.when(F.col("on"), F.array_sort(F.array_append("met", F.col("child")))).otherwise(F.col("met"))
        at = written(further.groupBy("root", F.col("child").alias("node"), met.alias("met")).agg(F.sum(F.col("ways") * F.col("n")).alias("ways")), "ways")
        depth += 1
    return reduce(DataFrame.unionByName, levels) if levels else at.select("root", "node", F.lit(0).alias("depth"), "ways")
