"""Queries over what templates define, and the documents inside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regions, resolution
from .catalog import query

c = F.col


_SOURCES = """d AS (SELECT l_orderkey AS tree, CASE WHEN l_partkey % 4 = 0 THEN 'd/' ELSE '' END || 'f' || (l_partkey % 3) AS file, l_linenumber AS source, CASE WHEN l_suppkey % 3 > 0 THEN 'g' || (l_suppkey % 3) END AS grp,
             CASE WHEN l_suppkey % 3 > 0 THEN 'a' || (l_linenumber % 2) END AS alt, l_linestatus = 'O' AND l_partkey % 2 = 0 AS empty, l_returnflag AS name, l_suppkey AS target FROM lineitem),
          x AS (SELECT tree FROM d WHERE NOT empty GROUP BY tree, file, source, grp, alt, name HAVING count(*) > 1),
          s AS (SELECT tree, file, source, grp, alt, name, NOT bool_or(NOT empty) AS empty, arg_max(target, CASE WHEN empty THEN 0 ELSE 1000000 END + target) AS target FROM d WHERE tree NOT IN (SELECT tree FROM x) GROUP BY ALL),
          pr AS (SELECT tree, file, grp, count(*) AS n, count(DISTINCT alt) AS present FROM (SELECT DISTINCT tree, file, source, grp, alt FROM d) GROUP BY ALL),
          pl AS (SELECT tree, file, sum(n) AS n, bool_or(grp IS NULL OR present = 2) AS always FROM pr GROUP BY ALL),
          c AS (SELECT tree, file, name, count(*) = any_value(n) AND any_value(always) AS defines, count(*) FILTER (NOT empty) = any_value(n) AND any_value(always) AS ends FROM s JOIN pl USING (tree, file) GROUP BY ALL),
          q AS (SELECT *, dense_rank() OVER (PARTITION BY tree ORDER BY len(string_split(file, '/')) DESC, file DESC) AS nth FROM c),
          o AS (SELECT *, max(nth) FILTER (ends) OVER (PARTITION BY tree, name) AS last_end, min(nth) FILTER (defines) OVER (PARTITION BY tree, name) AS first_definite FROM q),
          w AS (SELECT DISTINCT o.tree, o.name, s.target FROM o JOIN s USING (tree, file, name) WHERE CASE WHEN s.empty THEN last_end IS NULL AND nth <= coalesce(first_definite, nth) ELSE nth >= coalesce(last_end, 0) END),
          n AS (SELECT tree, name, bool_and(last_end IS NULL AND first_definite IS NULL) AS absent FROM o GROUP BY ALL),
          k AS (SELECT n.tree, n.name, any_value(absent) AS absent, count(w.target) + any_value(absent)::INT AS outcomes FROM n LEFT JOIN w ON w.tree = n.tree AND w.name = n.name GROUP BY n.tree, n.name)"""


@query(f"""WITH {_SOURCES} SELECT k.tree, k.name, w.target, k.outcomes::BIGINT AS outcomes, k.absent FROM k LEFT JOIN w ON w.tree = k.tree AND w.name = k.name""")
def possible_winners(t):
    """Templates that may win each name of an order's tree: its lines are files, some for certain, others by one of two choices."""
    choice = c("l_suppkey") % 3 > 0
    file = F.concat(F.when(c("l_partkey") % 4 == 0, "d/").otherwise(""), F.lit("f"), (c("l_partkey") % 3).cast("string"))
    group, alternative = F.when(choice, F.concat(F.lit("g"), (c("l_suppkey") % 3).cast("string"))), F.when(choice, F.concat(F.lit("a"), (c("l_linenumber") % 2).cast("string")))
    sources = t("lineitem").select(c("l_orderkey").alias("tree"), file.alias("file"), c("l_linenumber").alias("source"), group.alias("group"), alternative.alias("alternative"), c("l_returnflag").alias("name"), c("l_suppkey").alias("target"), F.lit(0).alias("start"), ((c("l_linestatus") == "O") & (c("l_partkey") % 2 == 0)).alias("empty"))
    groups = sources.where("group IS NOT NULL").select("tree", "group").distinct().withColumn("alternatives", F.lit(2))
    return resolution.possible_winners(sources, sources, groups)


_SAID = r"regexp_replace(text, '[^A-Za-z0-9 \n]', '_', 'g')"
_HEAD = "CASE turn % 3 WHEN 0 THEN '# head' || chr(10) WHEN 1 THEN '' ELSE chr(10) || chr(10) END"
_DEFINE = "'{{- define \"a\" }}' || chr(10) || '---' || chr(10) || '{{ end -}}' || chr(10)"


@query(f"""WITH x AS (SELECT 'c' || conv_id || '-' || turn || '-' || role AS artifact_id, turn, role, {_SAID} AS said, {_HEAD} AS head, {_DEFINE} AS d FROM conversations WHERE text IS NOT NULL),
          y AS (SELECT *, strlen(head) + strlen(d) AS upto, len([l FOR l IN string_split(said, chr(10)) IF trim(l) <> '']) > 0 AS says, strlen(said) - strlen(ltrim(said, ' ' || chr(10))) AS blank FROM x),
          z AS (SELECT artifact_id, 0 AS part, CASE WHEN turn % 3 = 0 THEN 0 ELSE upto + blank END AS start, upto + strlen(said) + 1 AS stop FROM y WHERE says
                UNION ALL SELECT artifact_id, 1, upto + strlen(said) + 1 + 4 + 15 + 4, upto + strlen(said) + 1 + 4 + 15 + 4 + 6 + strlen(role) FROM y)
          SELECT artifact_id, row_number() OVER (PARTITION BY artifact_id ORDER BY part)::INTEGER - 1 AS nth, start::BIGINT AS start, stop::BIGINT AS stop FROM z""")
def template_regions(t):
    """Documents of a file for each turn: a sign or nothing, a definition with a separator in it, the whole text, a comment with one, and a key."""
    said = F.regexp_replace("text", r"[^A-Za-z0-9 \n]", "_")
    head = F.when(c("turn") % 3 == 0, "# head\n").when(c("turn") % 3 == 1, "").otherwise("\n\n")
    source = F.concat(head, F.lit('{{- define "a" }}\n---\n{{ end -}}\n'), said, F.lit("\n---\n{{/*\n---\n*/}}\n\n---\nkind: "), "role")
    files = t("conversations").where("text IS NOT NULL").select(F.concat(F.lit("c"), c("conv_id").cast("string"), F.lit("-"), c("turn").cast("string"), F.lit("-"), "role").alias("artifact_id"), source.alias("source"))
    return regions.template_regions(files).select("artifact_id", c("nth").cast("int").alias("nth"), "start", "stop")
