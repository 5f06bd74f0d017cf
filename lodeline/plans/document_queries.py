"""Queries over whole documents: broken ones, and digests of trees."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import identity as ids
from ..functions.tables import written
from ..functions.workers import visible
from ..operators import documents, profiles, trees
from .catalog import query

c = F.col


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)),
           b AS (SELECT doc_id, count(*) AS n, min(i) FILTER (regexp_matches(line, '[0-9]')) AS bad FROM l GROUP BY 1)
           SELECT doc_id, CASE WHEN bad IS NULL THEN 'complete' WHEN bad = 1 THEN 'failed' ELSE 'partial' END AS status, 2 * (coalesce(bad, n + 1) - 1) AS n_keys, (coalesce(bad, n + 1) - 1) AS n_aliases FROM b""")
def recovered_documents(t):
    """Every text as YAML, a key and an alias to it for each line; a line with a digit is broken, and so is all behind it."""
    plain = lambda x: F.regexp_replace(x, "[^A-Za-z ]", "")
    number = lambda i: (i + 1).cast("string")
    good = lambda x, i: F.concat(F.lit("l"), number(i), F.lit(": &a"), number(i), F.lit(" 'x"), plain(x), F.lit("'\nr"), number(i), F.lit(": *a"), number(i), F.lit("\n"))
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(x.rlike("[0-9]"), F.concat(F.lit("l"), number(i), F.lit(": [open\n"))).otherwise(good(x, i)))
    files = t("documents").where("text IS NOT NULL").select(c("doc_id").cast("string").alias("artifact_id"), F.array_join(lines, "").alias("source"))
    visible(files.sparkSession)
    keys = documents.yaml_keys(files).groupBy("artifact_id").agg(F.max("status").alias("status"), F.count("keys").alias("n_keys"), F.count_if(c("kind") == "alias").alias("n_aliases"))
    return keys.select(c("artifact_id").cast("long").alias("doc_id"), "status", "n_keys", "n_aliases")


@query(r"""WITH l AS (SELECT l_orderkey, string_agg('{"flag \u0026 \u003cx\u003e":"' || l_returnflag || '","part":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey, l_returnflag) AS lines FROM lineitem GROUP BY 1)
           SELECT o_orderkey AS tree, sha256('{"10":1,"9":2.5,"customer":{"key":' || o_custkey || ',"priority":"' || o_orderpriority || '\n"},"lines":[' || coalesce(lines, '') || '],"none":null,"open":' || CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END || '}') AS digest
           FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def tree_digests(t):
    """The canonical digest of each order as a tree: a sequence of its lines, a map of its customer, and leaves of every kind."""
    row = lambda keys, kind, value: F.struct(keys.alias("keys"), F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    at, none = lambda *names: F.array(*(F.lit(n) if isinstance(n, str) else n for n in names)), F.lit(None)
    own = F.array(
        row(at("lines"), "seq", none), row(at("none"), "null", none), row(at("open"), "bool", (c("o_orderstatus") == "O")), row(at("9"), "float", F.lit("2.50")), row(at("10"), "int", F.lit("1")),
        row(at("customer"), "map", none), row(at("customer", "priority"), "str", F.concat("o_orderpriority", F.lit("\n"))), row(at("customer", "key"), "int", c("o_custkey")),
    )
    orders = t("orders").select(c("o_orderkey").alias("tree"), F.explode(own).alias("x"))
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag")) - 1
    known = t("orders").select(c("o_orderkey").alias("l_orderkey"))
    lines = t("lineitem").join(known, "l_orderkey", "left_semi").withColumn("nth", nth.cast("string"))
    each = F.array(row(at("lines", c("nth")), "map", none), row(at("lines", c("nth"), "part"), "int", c("l_partkey")), row(at("lines", c("nth"), "flag & <x>"), "str", c("l_returnflag")))
    rows = orders.unionByName(lines.select(c("l_orderkey").alias("tree"), F.explode(each).alias("x")))
    visible(rows.sparkSession)
    return trees.tree_digests(rows.select("tree", "x.*"))


@query(r"""WITH x AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS s FROM customer WHERE c_nationkey % 5 <> 0 AND c_mktsegment <> 'MACHINERY'),
           p AS (SELECT k, 'main' || k AS name, 'can://artifact/app/c' || n || '/Chart.yaml' AS chart, NULL AS ordinal, NULL AS source, NULL AS value FROM x
                 UNION ALL SELECT k, 'second' || k, 'can://artifact/app/c1/Chart.yaml', 0, 'can://artifact/app/' || lower(s) || '.yaml', NULL FROM x
                 UNION ALL SELECT k, 'second' || k, 'can://artifact/app/c1/Chart.yaml', 1, 'can://artifact/app/r' || k || '.yaml@key/renders.1.set.owner', n::VARCHAR FROM x)
           SELECT 'can://artifact/app/r' || k || '.yaml' AS config, name, chart, ordinal::INTEGER AS ordinal, source, value FROM p""")
def configured_profiles(t):
    """Two profiles that each customer's configuration declares, of which one has a layer from a file and one of its own; charts of some nations and one file aren't there."""
    app = F.lit("app")
    k, segment = c("c_custkey").cast("string"), F.lower("c_mktsegment")
    text = F.concat(F.lit("renders:\n  - name: main"), k, F.lit("\n    chart: c"), c("c_nationkey").cast("string"), F.lit("/Chart.yaml\n  - name: second"), k, F.lit("\n    chart: c1/Chart.yaml\n    values: ["), segment, F.lit(".yaml]\n    set: {owner: '"), c("c_nationkey").cast("string"), F.lit("'}\n"))
    configs = t("customer").select(ids.artifact_id(app, F.concat(F.lit("r"), k, F.lit(".yaml"))).alias("artifact_id"), text.alias("source"))
    visible(configs.sparkSession)
    charts = t("nation").where("n_nationkey % 5 <> 0").select(ids.artifact_id(app, F.concat(F.lit("c"), c("n_nationkey").cast("string"), F.lit("/Chart.yaml"))).alias("chart"), c("n_name").alias("name"))
    values = t("customer").where("c_mktsegment <> 'MACHINERY'").select(ids.artifact_id(app, F.concat(segment, F.lit(".yaml"))).alias("artifact_id")).distinct()
    artifacts = values.unionByName(charts.select(c("chart").alias("artifact_id"))).withColumn("sha256", F.sha2(c("artifact_id").cast("binary"), 256))
    # Texts are spread over all tasks, however the table's file is cut, and parsed once for all that is asked of their keys.
    keys = written(documents.yaml_keys(configs.repartition("artifact_id")), "keys")
    found = profiles.configured_profiles(keys, artifacts, charts, "app")
    return found["profiles"].join(found["layers"], "profile", "left").select("config", "name", "chart", "ordinal", "source", "value")
