"""Queries over a graph's catalog and the statements that write it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import written
from ..operators import catalog, graph
from ..sources import sinks, workspace
from . import pipeline
from .catalog import query

c = F.col

#: Orders as files of their own kind; closed ones bear a facet, open ones another node's label.
ORDERS = catalog.Catalog(
    {"Order": "Order", "Closed": "Order", "Open": "Open", "Part": "Part"},
    {"Order": {"price": "integer", "priority": "string"}, "Closed": {"iac_producer": "string", "late": "boolean"}, "Open": {"price": "integer"}, "Part": {"producer": "string", "brand": "string"}},
    {"HAS_PART": (["Closed"], ["Part"])},
)


def _orders(t):
    label = F.when(c("o_orderstatus") == "F", "Closed").when(c("o_orderstatus") == "O", "Open").otherwise("Odd")
    price = F.when(c("o_orderkey") % 3 == 0, c("o_custkey").cast("string")).otherwise(F.concat(c("o_custkey").cast("string"), F.lit(".5")))
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), x.alias("v")) for k, x in (("price", price), ("priority", c("o_orderpriority")), ("late", F.when(c("o_orderkey") % 5 == 0, "true")))))
    return t("orders").select(F.concat(F.lit("o"), c("o_orderkey").cast("string")).alias("id"), F.array(F.lit("Order"), label).alias("labels"), F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("properties"))


@query("""SELECT rule, 'o' || o_orderkey AS id, name FROM (
            SELECT 'unknown label' AS rule, o_orderkey, 'Odd' AS name FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
            UNION ALL SELECT 'no merge label', o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Open,Order' ELSE 'Odd,Order' END FROM orders WHERE o_orderstatus <> 'F'
            UNION ALL SELECT 'wrong type', o_orderkey, 'price' FROM orders WHERE o_orderkey % 3 <> 0
            UNION ALL SELECT 'unknown property', o_orderkey, 'late' FROM orders WHERE o_orderkey % 5 = 0 AND o_orderstatus <> 'F')""")
def catalog_violations(t):
    return catalog.node_violations(_orders(t), ORDERS)


_NODE = "length('{id: o, neutral: {price: , priority: }, owned: {}}') + 4 + length(o_orderkey::VARCHAR) + length(o_custkey::VARCHAR) + length(o_orderpriority) + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 2 END + CASE WHEN o_orderkey % 5 = 0 THEN length('late: true') ELSE 0 END"


@query(f"""SELECT 1 AS phase, 'row MERGE (n:Order {{id: row.id}}) ON CREATE SET n += row.neutral SET n:Closed SET n += row.owned;' AS shape, count(*)::BIGINT AS rows, sum({_NODE})::BIGINT AS bytes FROM orders WHERE o_orderstatus = 'F'
          UNION ALL SELECT 1, 'row MERGE (n:Part {{id: row.id}}) ON CREATE SET n += row.neutral SET n += row.owned;', count(*), sum(length('{{id: p, neutral: {{}}, owned: {{brand: }}}}') + 4 + length(p_partkey::VARCHAR) + length(p_brand))::BIGINT FROM part
          UNION ALL SELECT 2, 'row MATCH (s:Order {{id: row.src}}) MATCH (t:Part {{id: row.dst}}) MERGE (s)-[:HAS_PART]->(t);', count(*), sum(length('{{src: o, dst: p}}') + 4 + length(l_orderkey::VARCHAR) + length(l_partkey::VARCHAR))::BIGINT
          FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F')""")
def grouped_statements(t):
    """How many rows and bytes of each shape the statements of closed orders, parts and what joins them carry."""
    parts = t("part").select(F.concat(F.lit("p"), c("p_partkey").cast("string")).alias("id"), F.array(F.lit("Part")).alias("labels"), F.create_map(F.lit("brand"), c("p_brand")).alias("properties"))
    nodes = _orders(t).where(F.array_contains("labels", "Closed")).unionByName(parts)
    edges = t("lineitem").select(F.lit("HAS_PART").alias("type"), F.concat(F.lit("o"), c("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), c("l_partkey").cast("string")).alias("dst")).distinct()
    each = sinks.grouped_statements(nodes, edges, ORDERS, most=1 << 16)
    text = F.split_part("statement", F.lit("] AS "), F.lit(1))
    shape = F.split_part("statement", F.lit("] AS "), F.lit(2))
    return each.groupBy("phase", shape.alias("shape")).agg(F.sum("n").alias("rows"), F.sum(F.length(text) - F.length(F.lit("UNWIND [")) - 2 * (c("n") - 1)).alias("bytes"))


def _whole_workspace(t):
    """A chart for each supplier with one below it, values, templates of every kind and, for some, a package and a key that is there twice."""
    k = c("s_suppkey")
    at = F.concat(F.lit("s"), k.cast("string"))
    cache = F.when(k % 2 == 0, "  - name: cache\n    version: '1'\n    repository: oci://reg.io/charts\n").otherwise("")
    chart = F.concat(F.lit("apiVersion: v2\nname: "), at, F.lit("\nversion: 1.0.0\ndependencies:\n  - name: db\n    version: ^1\n    repository: https://charts.example.com\n"), cache)
    template = 'x: {{ .Values.b.c }}\ny: {{ include "n" . }}\n---\nz: {{ lookup "v1" "Pod" "ns" "p" }}\n'
    texts = {"Chart.yaml": chart, "charts/db/Chart.yaml": F.lit("apiVersion: v2\nname: db\nversion: 1.2.0\n"), "values.yaml": F.concat(F.lit("b:\n  c: x\n"), F.when(k % 7 == 1, "b: 2\n").otherwise("")), "templates/t.yaml": F.lit(template), "templates/_h.tpl": F.lit('{{ define "n" }}y{{ end }}')}
    each = t("supplier").select(at.alias("at"), F.explode(F.array(*(F.struct(F.lit(p).alias("p"), x.alias("x")) for p, x in texts.items()))).alias("f"))
    return each.select(F.concat_ws("/", "at", "f.p").alias("path"), c("f.x").cast("binary").alias("content"), F.lit(None).cast("string").alias("problem"))


@query("""WITH s AS (SELECT count(*) AS n, count(*) FILTER (s_suppkey % 2 = 0) AS even, count(*) FILTER (s_suppkey % 7 = 1) AS twice FROM supplier)
          SELECT type, rows FROM (SELECT unnest(['HAS_ARTIFACT', 'DEFINES_CONFIG', 'IAC_PART_OF_CHART', 'IAC_DECLARES_DEPENDENCY', 'IAC_TARGETS_CHART_REFERENCE', 'IAC_RESOLVES_TO_CHART', 'IAC_IDENTIFIED_BY_PACKAGE', 'IAC_DEFINES_TEMPLATE', 'IAC_HAS_TEMPLATE_CALL', 'IAC_CALLS_TEMPLATE',
            'IAC_HAS_VALUE_REFERENCE', 'IAC_REFERENCES_VALUE', 'IAC_HAS_RESOURCE_TEMPLATE', 'IAC_HAS_LOOKUP_REFERENCE', 'IAC_ALIAS_OF', 'IAC_HAS_ALIAS', 'IAC_DECLARES_PROFILE', 'IAC_RENDERS_CHART', 'IAC_HAS_DIAGNOSTIC', 'violations']) AS type,
            unnest([5 * n, 2 * n, 3 * n, n + even, n + even, n, even, n, n, n, n, n, 2 * n, n, 2 * n, 2 * n, 2 * n, 2 * n, twice, 0]) AS rows FROM s) WHERE rows > 0 OR type = 'violations'""")
def graph_families(t):
    """Relationships by family of the whole graph of a workspace with a chart for each supplier, and how often it breaks its catalog."""
    tables = pipeline.analyse(workspace.artifacts(_whole_workspace(t), "shop"), "shop", level=2)
    nodes, edges = (written(df, "graph") for df in graph.project(tables, "shop", version="1"))
    rules = catalog.of_analysis()
    bad = catalog.node_violations(nodes, rules).unionByName(catalog.edge_violations(edges, nodes, rules)).select("rule", "id").unionByName(graph.graph_violations(nodes, edges))
    return edges.groupBy("type").agg(F.count("*").alias("rows")).unionByName(bad.agg(F.count("*").alias("rows")).select(F.lit("violations").alias("type"), "rows"))
