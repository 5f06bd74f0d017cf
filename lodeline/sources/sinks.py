"""Graphs as tables, JSON lines and a script of statements, each written by Spark."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.tables import written
from ..operators.catalog import Catalog, classified, edge_violations, node_violations, unsafe_removals
from ..operators.graph import PRODUCER, graph_violations, unsafe


def literal(text: Column) -> Column:
    """A quoted string of the script; control characters, quotes and backslashes are escaped."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, mark in (("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(raw), F.lit(mark))
    rest = F.transform(F.split(out, ""), lambda x: F.when(x.rlike(r"[\x00-\x1f\x7f]"), F.concat(F.lit("\\u"), F.lpad(F.hex(F.ascii(x)), 4, "0"))).otherwise(x))
    return F.concat(F.lit("'"), F.when(out.rlike(r"[\x00-\x1f\x7f]"), F.array_join(rest, "")).otherwise(out), F.lit("'"))


def _name(text: Column) -> Column:
    """A label or type: plain words stand, anything else is quoted."""
    return F.when(text.rlike(r"^[A-Za-z_][A-Za-z0-9_]*\z"), text).otherwise(F.concat(F.lit("`"), F.replace(text, F.lit("`"), F.lit("``")), F.lit("`")))


def statements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(phase, id, statement): nodes before relationships, each a merge that can be replayed; names are quoted where they aren't plain."""
    pairs = F.array_sort(F.transform(F.map_entries("properties"), lambda p: F.concat(F.lit("`"), F.replace(p["key"], F.lit("`"), F.lit("``")), F.lit("`: "), literal(p["value"]))))
    node = F.concat(F.lit("MERGE (n {id: "), literal(F.col("id")), F.lit("}) SET n:"), F.array_join(F.transform(F.array_sort("labels"), _name), ":"), F.lit(", n += {"), F.array_join(pairs, ", "), F.lit("};"))
    edge = F.concat(F.lit("MATCH (a {id: "), literal(F.col("src")), F.lit("}), (b {id: "), literal(F.col("dst")), F.lit("}) MERGE (a)-[:"), _name(F.col("type")), F.lit("]->(b);"))
    return nodes.select(F.lit(1).alias("phase"), "id", node.alias("statement")).unionByName(edges.select(F.lit(2).alias("phase"), F.concat_ws("|", "type", "src", "dst").alias("id"), edge.alias("statement")))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Both tables as Parquet and JSON lines, and the script in order; raises, before anything is written, on what a graph must not hold.

    Each of the four folders has its _SUCCESS once it is whole; the script, written last, stands for all.
    """
    found = graph_violations(nodes, edges).take(5)
    if found:
        raise ValueError(f"the graph can't be written: {[tuple(r) for r in found]}")
    nodes.write.parquet(f"{path}/nodes")
    edges.write.parquet(f"{path}/edges")
    nodes.withColumn("properties", F.to_json("properties")).write.json(f"{path}/nodes_json")
    statements(nodes, edges).orderBy("phase", "id").select("statement").write.text(f"{path}/script")


#: Bytes of the rows that one statement carries; a larger row is a statement of its own.
STATEMENT_BYTES = 1 << 20


def _value(value: Column, type_: Column) -> Column:
    """A property's text as a literal of its declared type."""
    items = F.concat(F.lit("["), F.array_join(F.transform(F.from_json(value, "array<string>"), literal), ", "), F.lit("]"))
    return F.when(type_.isin("integer", "boolean"), value).when(type_ == "string[]", items).otherwise(literal(value))


def _record(properties: str, types: Column) -> Column:
    """A map of properties as a literal, by name."""
    pairs = F.array_sort(F.transform(F.map_entries(properties), lambda p: F.concat(_name(p["key"]), F.lit(": "), _value(p["value"], F.try_element_at(types, p["key"])))))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def _batched(rows: DataFrame, most: int) -> DataFrame:
    """(phase, head, tail, rows) of (phase, head, tail, row): rows of one statement in order, about ``most`` bytes at a time.

    Rows are dealt by ranges of (phase, head, row), and bytes summed up inside a range, so no statement's
    rows are gathered as a whole, however many there are.
    """
    n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = rows.repartitionByRange(int(n), "phase", "head", "tail", "row").withColumn("part", F.spark_partition_id())
    sofar = Window.partitionBy("part", "phase", "head", "tail").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    batch = F.floor(F.coalesce(F.sum(F.octet_length("row") + 2).over(sofar), F.lit(0)) / most)
    each = dealt.withColumn("batch", batch).groupBy("phase", "head", "tail", "part", "batch").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return each.select("phase", "head", "tail", F.array_join("rows", ", ").alias("rows"), F.size("rows").alias("n"), F.get("rows", F.lit(0)).alias("first"))


def grouped_statements(nodes: DataFrame, edges: DataFrame, catalog: Catalog, plan: DataFrame | None = None, removals: DataFrame | None = None, app: str = "", most: int = STATEMENT_BYTES) -> DataFrame:
    """(phase, first, n, statement): one statement for many rows, which can be replayed; order by phase and statement.

    1: nodes of one set of labels, merged on the label that theirs agree on; what a neutral label
    declares is set only when a node is made. 2: relationships of one type between two such labels.
    3 and 4: ``removals`` (phase, action, id, names) of the same labels or properties; 5 and 6: what
    ``plan`` (action, id, src, dst) deletes, nodes only where their stamp says that ``app`` made them. Nodes
    whose labels don't merge raise.
    """
    known = classified(nodes, catalog)
    checked = F.when(F.col("merge_label").isNull(), F.raise_error(F.concat(F.lit("labels don't merge: "), "id")).cast("string")).otherwise(F.col("merge_label"))
    types = _types(catalog)
    facets = F.array_sort(F.array_remove("labels", F.col("merge_label")))
    head = F.concat(F.lit("MERGE (n:"), _name(checked), F.lit(" {id: row.id}) ON CREATE SET n += row.neutral"), F.when(F.size(facets) > 0, F.concat(F.lit(" SET n:"), F.array_join(F.transform(facets, _name), ":"))).otherwise(""), F.lit(" SET n += row.owned"))
    row = F.concat(F.lit("{id: "), literal(F.col("id")), F.lit(", neutral: "), _record("neutral", types), F.lit(", owned: "), _record("owned", types), F.lit("}"))
    rows = known.select(F.lit(1).alias("phase"), F.lit("UNWIND [").alias("head"), F.concat(F.lit("] AS row "), head, F.lit(";")).alias("tail"), row.alias("row"))
    ends = known.select("id", "merge_label")
    both = edges.join(ends.select(F.col("id").alias("src"), F.col("merge_label").alias("s")), "src").join(ends.select(F.col("id").alias("dst"), F.col("merge_label").alias("t")), "dst")
    pair = F.concat(F.lit("{src: "), literal(F.col("src")), F.lit(", dst: "), literal(F.col("dst")), F.lit("}"))
    link = F.concat(F.lit("] AS row MATCH (s:"), _name(F.col("s")), F.lit(" {id: row.src}) MATCH (t:"), _name(F.col("t")), F.lit(" {id: row.dst}) MERGE (s)-[:"), _name(F.col("type")), F.lit("]->(t);"))
    rows = rows.unionByName(both.select(F.lit(2).alias("phase"), F.lit("UNWIND [").alias("head"), link.alias("tail"), pair.alias("row")))
    if removals is not None:
        names = F.transform(F.split("names", ","), _name)
        what = F.when(F.col("action") == "remove labels", F.concat(F.lit("n:"), F.array_join(names, ":"))).otherwise(F.array_join(F.transform(names, lambda x: F.concat(F.lit("n."), x)), ", "))
        rows = rows.unionByName(removals.select(F.col("phase").cast("int").alias("phase"), F.lit("UNWIND [").alias("head"), F.concat(F.lit("] AS id MATCH (n {id: id}) REMOVE "), what, F.lit(";")).alias("tail"), literal(F.col("id")).alias("row")))
    if plan is not None:
        cut = plan.where("action = 'delete edge'")
        rows = rows.unionByName(cut.select(F.lit(5).alias("phase"), F.lit("UNWIND [").alias("head"), F.concat(F.lit("] AS row MATCH (s {id: row.src})-[r:"), _name(F.col("id")), F.lit("]->(t {id: row.dst}) DELETE r;")).alias("tail"), pair.alias("row")))
        gone = plan.where("action = 'delete node'")
        rows = rows.unionByName(gone.select(F.lit(6).alias("phase"), F.lit("UNWIND [").alias("head"), F.concat(F.lit("] AS id MATCH (n {id: id}) WHERE n.producer = "), literal(F.lit(PRODUCER)), F.lit(" AND n.iac_app_id = "), literal(F.lit(app)), F.lit(" DETACH DELETE n;")).alias("tail"), literal(F.col("id")).alias("row")))
    each = _batched(rows, most)
    return each.select("phase", "first", "n", F.concat("head", "rows", "tail").alias("statement"))


def _types(catalog: Catalog) -> Column:
    """Types by property; one that labels declare differently is text."""
    found: dict[str, str] = {}
    for own in catalog.properties.values():
        for name, type_ in own.items():
            found[name] = type_ if found.get(name, type_) == type_ else "string"
    return F.create_map(*(F.lit(x) for pair in found.items() for x in pair))


def _digest(df: DataFrame) -> str:
    """A digest of a table's rows, in any order."""
    n, total = df.select(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)").alias("h")).agg(F.count("*"), F.coalesce(F.sum("h"), F.lit(0))).first()
    return f"{n}:{int(total)}"


def publish(tables: dict[str, DataFrame], path: str) -> str:
    """Writes tables as one generation below ``path`` and makes it the visible one; returns its folder.

    The tables and a manifest of their digests are written first, out of sight; one rename of the
    manifest shows them all. A run that ends before shows nothing new, and readers of the generation
    before are not disturbed.
    """
    spark = next(iter(tables.values())).sparkSession
    at = f"generation-{uuid.uuid4().hex}"
    folders = {}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{at}/{name}")
        folders[name] = {"digest": _digest(spark.read.parquet(f"{path}/{at}/{name}")), "schema": df.schema.json()}
    text = json.dumps({"generation": at, "tables": folders}, sort_keys=True)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = jvm.org.apache.hadoop.fs
    hidden, shown = files.Path(f"{path}/{at}/manifest"), files.Path(f"{path}/manifest")
    out = hidden.getFileSystem(conf).create(hidden, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = files.FileContext.getFileContext(shown.getFileSystem(conf).getUri(), conf)
    overwrite = spark.sparkContext._gateway.new_array(files.Options.Rename, 1)
    overwrite[0] = files.Options.Rename.valueOf("OVERWRITE")
    context.rename(hidden, shown, overwrite)
    return at


def published(spark: SparkSession, path: str, verified: bool = False) -> dict[str, DataFrame]:
    """The tables of the visible generation; with ``verified``, raises where one isn't what its manifest says."""
    manifest = json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()[0])
    out = {}
    for name, said in manifest["tables"].items():
        out[name] = spark.read.schema(StructType.fromJson(json.loads(said["schema"]))).parquet(f"{path}/{manifest['generation']}/{name}")
        if verified and _digest(out[name]) != said["digest"]:
            raise ValueError(f"{name} of {manifest['generation']} was changed after it was written")
    return out


def write_generation(nodes: DataFrame, edges: DataFrame, catalog: Catalog, path: str, plan: DataFrame | None = None, existing: DataFrame | None = None, removals: DataFrame | None = None, app: str = "") -> str:
    """Publishes a graph with the statements that bring it about; raises before anything is written if it breaks the catalog or the plan takes what isn't its own."""
    # Made once, as they are checked and written several times.
    nodes, edges = written(nodes, "nodes"), written(edges, "edges")
    found = [tuple(r) for r in graph_violations(nodes, edges).select("rule", "id").unionByName(node_violations(nodes, catalog).select("rule", "id")).unionByName(edge_violations(edges, nodes, catalog).select("rule", "id")).take(5)]
    if plan is not None:
        if existing is None:
            raise ValueError("a plan that deletes needs the existing nodes")
        found += [tuple(r) for r in unsafe(plan, existing).take(5)]
    if removals is not None:
        found += [tuple(r) for r in unsafe_removals(removals, catalog).take(5)]
    if found:
        raise ValueError(f"the graph can't be written: {found}")
    return publish({"nodes": nodes, "edges": edges, "statements": grouped_statements(nodes, edges, catalog, plan, removals, app)}, path)
