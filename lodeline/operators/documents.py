"""Facts inside documents: keys of YAML trees, and what template actions refer to.

YAML needs a parser, so documents are filtered first and parsed once, in Arrow batches. Template
actions are found by expressions alone: matches and what lies between them give their places.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import anonymous_id, encode_value_segment, value_path
from .precedence import occurrences

KEYS = "artifact_id string, keys array<string>, value string, kind string, line int, column int, duplicate boolean, document int, status string"


#: Parses at most that a broken document may cost.
ATTEMPTS = 12


def _events(source: str) -> list:
    """The parsing events of all documents; raises where the text is no YAML."""
    import yaml

    return list(yaml.parse(source, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)))


def _says(events: list) -> bool:
    """Whether a document has a body."""
    import yaml

    return any(isinstance(e, (yaml.CollectionStartEvent, yaml.AliasEvent)) or isinstance(e, yaml.ScalarEvent) and (e.value != "" or not e.implicit[0]) for e in events)


def recovered(source: str) -> tuple[list, str | None, int]:
    """Events of the text, or of the longest beginning found that is YAML and says something; what is wrong; parses made.

    Beginnings end with lines. The error's line and those before it are tried first, then halves, within ATTEMPTS parses.
    """
    import yaml

    try:
        return _events(source), None, 1
    except (yaml.YAMLError, ValueError) as e:
        problem = e
    lines = source.splitlines(keepends=True) if "\r" not in source else [x + "\n" for x in source.split("\n")]
    mark = getattr(problem, "problem_mark", None)
    high = len(lines) - 1 if mark is None else min(len(lines) - 1, mark.line + 1)
    best, low, attempts = [], 1, 1
    near = [high, high - 1, high - 2]
    while low <= high and attempts < ATTEMPTS:
        half = near.pop(0) if near and low <= near[0] <= high else (low + high) // 2
        attempts += 1
        try:
            events = _events("".join(lines[:half]))
            fits = _says(events)
        except (yaml.YAMLError, ValueError):
            fits = False
        if fits:
            best, low, near = events, half + 1, []
        else:
            high = half - 1
    return best, str(problem)[:200], attempts


def _keys_of(events: list) -> Iterator[tuple]:
    """(keys, value, kind, line, column, duplicate, document) of each key and index of all documents, which count from 0.

    An alias is a value of its kind and isn't followed, so what it stands for is there once and no
    document grows or never ends. A key that is there already is a duplicate.
    """
    import yaml

    resolver, seen, stack, document = yaml.resolver.Resolver(), set(), [], -1
    for e in events:
        if isinstance(e, yaml.DocumentStartEvent):
            stack, document = [], document + 1
        elif isinstance(e, yaml.CollectionEndEvent):
            stack.pop()
        elif isinstance(e, yaml.NodeEvent):
            scalar = isinstance(e, yaml.ScalarEvent)
            path, top = (), stack[-1] if stack else None
            if top is not None and top["path"] is not None:
                if top["kind"] == "map" and top["key"] is None:
                    # A key that is no plain value, and what it leads to, has no path.
                    top["key"] = (e.value, e.start_mark) if scalar else False
                    path = None
                elif top["kind"] == "map":
                    path = (*top["path"], top["key"][0]) if top["key"] else None
                    mark, top["key"] = top["key"][1] if top["key"] else None, None
                else:
                    path, mark = (*top["path"], str(top["next"])), e.start_mark
                    top["next"] += 1
                if path is not None:
                    if scalar:
                        tag = e.tag or resolver.resolve(yaml.ScalarNode, e.value, e.implicit)
                        kind = tag.rpartition(":")[2]
                    else:
                        kind = "alias" if isinstance(e, yaml.AliasEvent) else "map" if isinstance(e, yaml.MappingStartEvent) else "seq"
                    yield list(path), e.value if scalar else None, kind, mark.line + 1, mark.column + 1, path in seen, document
                    seen.add(path)
            elif top is not None:
                path = None
            if isinstance(e, yaml.CollectionStartEvent):
                stack.append({"kind": "map" if isinstance(e, yaml.MappingStartEvent) else "seq", "path": path, "key": None, "next": 0})


def yaml_keys(documents: DataFrame) -> DataFrame:
    """A row for each key of the YAML in ``source``.

    A text that is broken further down gives the keys of its longest good beginning, with status
    partial, and a row without keys whose value says what is wrong; one without such a beginning only
    that row, with status failed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in KEYS.split(", ")]
        for batch in batches:
            out = []
            for artifact, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                events, problem, _ = recovered(source or "")
                status = "complete" if problem is None else "partial" if events else "failed"
                if problem is not None:
                    out.append((artifact, None, problem, None, None, None, False, None, status))
                out += [(artifact, *row, status) for row in _keys_of(events)]
            types = [pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    return documents.select("artifact_id", "source").mapInArrow(run, KEYS).withColumn("path", value_path(F.col("keys")))


def custom_resources(keys: DataFrame) -> DataFrame:
    """(artifact_id, document, name, group, kind, plural, valid) of the documents of files that define resources; valid: all four are there and it is such a definition."""
    places = {"kind": "type", "metadata.name": "name", "spec.group": "group", "spec.names.kind": "resource", "spec.names.plural": "plural"}
    own = keys.where("keys IS NOT NULL").groupBy("artifact_id", "document").pivot("path", list(places)).agg(F.first("value"))
    own = own.select("artifact_id", "document", *(F.coalesce(F.col(f"`{p}`"), F.lit("")).alias(n) for p, n in places.items()))
    valid = (F.col("type") == "CustomResourceDefinition") & (F.least(*(F.length(n) for n in ("name", "group", "resource", "plural"))) > 0)
    return own.select("artifact_id", "document", "name", "group", F.col("resource").alias("kind"), "plural", valid.alias("valid"))


#: An action that isn't a comment; strings and raw strings inside it may hold braces.
ACTION = r"""(?s)\{\{-?\s*(?!/\*)(?:[^"`'}]++|"(?:[^"\\]++|\\.)*+"|`[^`]*+`|'(?:[^'\\]++|\\.)*+'|\}(?!\}))*+\}\}"""


def template_actions(templates: DataFrame) -> DataFrame:
    """(artifact_id, nth, action, start, line, followed) of every ``{{ }}`` of ``source``; comments are left out.

    followed: whether text other than white space and comments stands before the next action. Places
    are running sums over the lengths and line feeds of actions and of what lies between them, so the
    work grows with the text; sums run over the actions of one file, which Spark sorts and may spill.
    """
    t = templates.where(F.contains("source", F.lit("{{"))).select("artifact_id", F.monotonically_increasing_id().alias("file"), F.regexp_extract_all("source", F.lit(ACTION), F.lit(0)).alias("found"), F.split("source", ACTION, -1).alias("between"))
    pieces = F.arrays_zip("found", F.slice("between", F.lit(1), F.size("found")).alias("before"), F.slice("between", F.lit(2), F.size("found")).alias("after"))
    each = t.select("artifact_id", "file", F.posexplode(pieces).alias("nth", "x")).select("artifact_id", "file", "nth", "x.*")
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    said = F.regexp_replace("after", r"(?s)\{\{-?\s*/\*.*?\*/\s*-?\}\}", "").rlike(r"\S")
    each = each.select("artifact_id", "file", "nth", "found", F.length("found").alias("n"), F.length("before").alias("gap"), breaks(F.col("found")).alias("more"), breaks(F.col("before")).alias("rows"), said.alias("followed"))
    sofar = Window.partitionBy("file").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    start = (F.sum(F.col("gap") + F.col("n")).over(sofar) - F.col("n")).cast("int")
    line = (F.sum(F.col("rows") + F.col("more")).over(sofar) - F.col("more") + 1).cast("int")
    return each.select("artifact_id", "nth", F.regexp_replace("found", r"^\{\{-?\s*|\s*-?\}\}$", "").alias("action"), start.alias("start"), line.alias("line"), "followed")


def value_references(actions: DataFrame) -> DataFrame:
    """(artifact_id, line, path, dynamic) of what actions read below ``.Values``; an index by an expression is dynamic.

    Fields read from an index in brackets go on its path: ``(index .Values "a").b`` is ``a.b``.
    """
    a = actions.where(F.contains("action", F.lit("Values")))
    quiet = F.regexp_replace("action", r'"(?:[^"\\]|\\.)*+"|`[^`]*+`', '""')
    # What an index is applied to belongs to the index.
    outside = F.regexp_replace(quiet, r"\bindex\s+\$?\.Values(?:\.\w+)*+", "")
    plain = F.regexp_extract_all(outside, F.lit(r"(?<![\w)])\$?\.Values((?:\.\w+)+)"), F.lit(1))
    direct = a.select("artifact_id", "line", F.explode(plain).alias("p")).select("artifact_id", "line", value_path(F.split(F.expr("substring(p, 2)"), r"\.")).alias("path"), F.lit(False).alias("dynamic"))
    argument = r'"(?:[^"\\]|\\.)*+"|`[^`]*+`|[\w.$-]+|\([^()]*\)'
    call = rf"index\s+(\$?\.Values(?:\.\w+)*+)((?:\s+(?:{argument}))+)\s*(\)(?:\.\w+)+)?"
    at = [F.regexp_extract_all("action", F.lit(call), F.lit(i)) for i in (1, 2, 3)]
    calls = a.select("artifact_id", "line", F.explode(F.arrays_zip(*(x.alias(n) for x, n in zip(at, ("root", "arguments", "fields"), strict=True)))).alias("c"))
    calls = calls.select("artifact_id", "line", F.split(F.regexp_replace("c.root", r"^\$?\.Values\.?", ""), r"\.").alias("root"), F.regexp_extract_all("c.arguments", F.lit(f"({argument})"), F.lit(1)).alias("a"), F.split(F.regexp_replace("c.fields", r"^\)\.", ""), r"\.").alias("fields"))
    static = F.forall("a", lambda x: x.rlike(r'^["`]|^-?[0-9]'))
    plain_text = lambda x: F.regexp_replace(F.regexp_replace(x, r'^["`]|["`]$', ""), r"\\(.)", "$1")
    step = lambda x: F.when(x.rlike(r'^["`]|^-?[0-9]'), encode_value_segment(plain_text(x))).otherwise("[expr]")
    named = lambda c: F.transform(F.filter(c, lambda x: x != ""), encode_value_segment)
    path = F.array_join(F.concat(named("root"), F.transform("a", step), named("fields")), ".")
    return direct.unionByName(calls.select("artifact_id", "line", path.alias("path"), (~static).alias("dynamic")))


def template_calls(actions: DataFrame) -> DataFrame:
    """(artifact_id, line, kind, name) of named templates that actions call; without a quoted name the call is dynamic."""
    call = F.regexp_extract_all("action", F.lit(r'\b(include|template|tpl)\s+("[^"]*"|[^\s)]+)'), F.lit(0))
    each = actions.select("artifact_id", "line", F.explode(call).alias("c"))
    name = F.regexp_extract("c", r'"([^"]*)"', 1)
    return each.select("artifact_id", "line", F.regexp_extract("c", r"^(\w+)", 1).alias("kind"), F.when(name != "", name).alias("name"))


def lookup_references(actions: DataFrame) -> DataFrame:
    """(artifact_id, line, api, resource, namespace, name) of what actions look up in a cluster; arguments as written, quotes off."""
    argument = r'"(?:[^"\\]|\\.)*+"|`[^`]*+`|\([^()]*\)|[^\s()|]+'
    call = rf"\blookup\s+({argument})\s+({argument})\s+({argument})\s+({argument})"
    names = ("api", "resource", "namespace", "name")
    parts = [F.regexp_extract_all("action", F.lit(call), F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    each = actions.where(F.contains("action", F.lit("lookup"))).select("artifact_id", "line", F.explode(F.arrays_zip(*parts)).alias("x"))
    return each.select("artifact_id", "line", *(F.regexp_replace(f"x.{n}", r'^["`]|["`]$', "").alias(n) for n in names))


def numbered_facts(facts: DataFrame, kind: str, into: str, order: list[str]) -> DataFrame:
    """Facts (artifact_id, line) with an identity by place; of several on one line, the later ones in ``order`` carry their number."""
    df = occurrences(facts, ["artifact_id", "line"], order, "__nth")
    return df.withColumn(into, anonymous_id(F.col("artifact_id"), kind, F.col("line"), F.lit(1), F.col("__nth"))).drop("__nth")


def unbalanced(actions: DataFrame) -> DataFrame:
    """(artifact_id, line, opened) of files whose blocks aren't all closed, or are closed before they open; line of the last action, opened: how many are left."""
    kind = F.regexp_extract("action", r"^(define|block|if|range|with|end)\b", 1)
    step = F.when(kind == "end", -1).when(kind != "", 1).otherwise(0)
    sofar = F.sum(step).over(Window.partitionBy("artifact_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    each = actions.select("artifact_id", "line", "nth", sofar.alias("level")).groupBy("artifact_id").agg(F.min("level").alias("least"), F.max_by("level", "nth").alias("opened"), F.max("line").alias("line"))
    return each.where("least < 0 OR opened <> 0").select("artifact_id", "line", "opened")


def named_templates(actions: DataFrame) -> DataFrame:
    """(artifact_id, line, name, start, nth, empty) of ``define`` and ``block`` actions, with whether nothing stands in the body.

    White space, comments and nested ``define`` are nothing; any other action or text is something.
    """
    file = Window.partitionBy("artifact_id").orderBy("nth")
    kind = F.when(F.startswith("action", F.lit("/*")), "comment").otherwise(F.regexp_extract("action", r"^(define|block|if|range|with|end)\b", 1))
    step = F.when(F.col("kind").isin("define", "block", "if", "range", "with"), 1).when(F.col("kind") == "end", -1).otherwise(0)
    a = actions.withColumn("kind", kind).withColumn("step", step)
    # An end is on the level of what it ends, and the one before it there.
    a = a.withColumn("level", F.sum("step").over(file) + (F.col("step") < 0).cast("int")).withColumn("moves", F.col("step") != 0)
    a = a.withColumn("ends", F.when(F.col("step") < 0, F.lag("kind").over(Window.partitionBy("artifact_id", "level", "moves").orderBy("nth"))))
    opens, closes = F.col("kind").isin("define", "block"), F.coalesce(F.col("ends").isin("define", "block"), F.lit(False))
    a = a.withColumn("opens", opens).withColumn("body", F.sum(opens.cast("int") - closes.cast("int")).over(file))
    # What follows an action stands in the body that was opened last on its depth.
    inside = Window.partitionBy("artifact_id", "body").orderBy("nth")
    a = a.withColumn("of", F.max(F.when(F.col("opens"), F.col("nth"))).over(inside))
    silent = F.col("opens") | (F.col("kind") == "comment") | F.coalesce(F.col("ends") == "define", F.lit(False))
    filled = a.where(F.col("body") > 0).groupBy("artifact_id", F.col("of").alias("nth")).agg(F.bool_or(F.col("followed") | ~silent).alias("filled"))
    name = F.regexp_extract("action", r'^(?:define|block)\s+"([^"]+)"', 1)
    marked = a.where("opens").withColumn("name", name).where("name <> ''").join(filled, ["artifact_id", "nth"], "left")
    return marked.select("artifact_id", "line", "name", "start", "nth", (~F.coalesce("filled", F.lit(False))).alias("empty"))
