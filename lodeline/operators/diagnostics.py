"""What an analysis reports: one table of codes, severities and places, out of the tables of every step."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import semantic_id

COLUMNS = "id string, code string, severity string, phase string, artifact_id string, line int, message string"
#: Codes by what an inventory says of a file; fixed values.
PROBLEMS = {"not text": "IAC_SOURCE_NOT_TEXT", "not a regular file": "IAC_SOURCE_NOT_REGULAR", "path": "IAC_SOURCE_OUTSIDE_WORKSPACE", "outside": "IAC_SOURCE_OUTSIDE_WORKSPACE"}


def diagnostic(df: DataFrame, app: str, code: Column | str, severity: str, phase: str, message: Column, artifact: str = "artifact_id", line: Column | None = None, about: Column | None = None) -> DataFrame:
    """A diagnostic for each row, known by its code, file, place and what it is about."""
    code = F.lit(code) if isinstance(code, str) else code
    at = F.lit(None).cast("int") if line is None else line.cast("int")
    about = F.lit("") if about is None else F.coalesce(about, F.lit(""))
    where = F.concat_ws(":", F.coalesce(F.col(artifact), F.lit("")), F.coalesce(at.cast("string"), F.lit("")), about)
    return df.select(semantic_id(F.lit(app), "diagnostic", code, where).alias("id"), code.alias("code"), F.lit(severity).alias("severity"), F.lit(phase).alias("phase"), F.col(artifact).alias("artifact_id"), at.alias("line"), message.alias("message")).dropDuplicates(["id"])


def of(app: str, artifacts: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Diagnostics of all that ``tables`` hold so far: what can't be read, is there twice, doesn't resolve or does so in several ways."""
    keys, actions, templates = tables["config_keys"], tables["actions"], tables["templates"]
    found = []
    if "problem" in artifacts.columns:
        code = reduce(lambda other, item: F.when(F.col("problem") == item[0], item[1]).otherwise(other), PROBLEMS.items(), F.lit("IAC_SOURCE_UNREADABLE"))
        bad = artifacts.where("problem IS NOT NULL").withColumn("code", code)
        for severity, those in (("warning", "code = 'IAC_SOURCE_NOT_TEXT'"), ("error", "code <> 'IAC_SOURCE_NOT_TEXT'")):
            found.append(diagnostic(bad.where(those), app, F.col("code"), severity, "load", F.concat_ws(": ", "path", "problem"), about=F.col("path")))
    found.append(diagnostic(tables["unreadable"], app, "IAC_HELM_YAML_PARSE", "error", "parse", F.col("value")))
    invalid = tables["invalid_charts"]
    versions = diagnostic(invalid.where("problem = 'api version'"), app, "IAC_HELM_UNSUPPORTED_API_VERSION", "error", "parse", F.lit("neither v1 nor v2"))
    found += [versions, diagnostic(invalid.where("problem <> 'api version'"), app, "IAC_HELM_INVALID_CHART", "error", "parse", F.col("problem"))]
    found.append(diagnostic(tables["problems"], app, "IAC_HELM_INVALID_CONFIG", "error", "load", F.col("message"), about=F.col("about")))
    found.append(diagnostic(keys.where("duplicate"), app, "IAC_HELM_DUPLICATE_VALUE_PATH", "error", "parse", F.col("path"), line=F.col("line"), about=F.col("path")))
    twice = templates.groupBy("artifact_id", "name").agg(F.count("*").alias("n"), F.min("line").alias("line")).where("n > 1")
    found.append(diagnostic(twice, app, "IAC_HELM_DUPLICATE_TEMPLATE_DEFINITION", "error", "parse", F.format_string("%s is defined %d times", "name", "n"), line=F.col("line"), about=F.col("name")))
    if "conflict" in artifacts.columns:
        found.append(diagnostic(artifacts.where("conflict"), app, "IAC_ARTIFACT_HASH_CONFLICT", "error", "load", F.concat(F.lit("another content is known of "), "path"), about=F.lit("hash")))
    found.append(diagnostic(tables["unbalanced"], app, "IAC_HELM_TEMPLATE_PARSE", "error", "parse", F.format_string("%d blocks are left open at the end", "opened"), line=F.col("line")))
    found.append(diagnostic(tables["invalid_dependencies"], app, "IAC_HELM_INVALID_DEPENDENCY", "error", "parse", F.concat(F.lit("no name or version: "), "nth"), about=F.col("nth")))
    found.append(diagnostic(tables["invalid_resources"], app, "IAC_HELM_INVALID_CRD", "error", "parse", F.lit("a document is no complete definition of a resource")))
    if "value_targets" in tables:
        several = tables["value_targets"].where("status = 'ambiguous'")
        found.append(diagnostic(several, app, "IAC_HELM_AMBIGUOUS_VALUE_REFERENCE", "warning", "resolve", F.format_string("%s has %d declarations of one rank", "path", "candidates"), line=F.col("line"), about=F.col("path")))
        d = tables["dependencies"]
        found.append(diagnostic(d.where("candidates > 1"), app, "IAC_HELM_AMBIGUOUS_VENDORED_DEPENDENCY", "warning", "resolve", F.format_string("%s fits %d charts", "name", "candidates"), about=F.col("dependency")))
        found.append(diagnostic(d.where("candidates = 0 AND incompatible > 0"), app, "IAC_HELM_INCOMPATIBLE_VENDORED_DEPENDENCY", "warning", "resolve", F.format_string("%d charts near %s don't fit", "incompatible", "name"), about=F.col("dependency")))
    if "outcomes" in tables:
        # Both are about the chart at the root of the tree.
        open_ = tables["outcomes"].where("outcomes > 1").groupBy(F.col("tree").alias("artifact_id"), "name").agg(F.max("outcomes").alias("n"))
        found.append(diagnostic(open_, app, "IAC_HELM_AMBIGUOUS_TEMPLATE_TARGET", "warning", "resolve", F.format_string("%s has %d possible targets", "name", "n"), about=F.concat(F.lit("name "), "name")))
        places = tables["shared_places"].withColumnRenamed("tree", "artifact_id")
        found.append(diagnostic(places, app, "IAC_HELM_AMBIGUOUS_TEMPLATE_TARGET", "warning", "resolve", F.format_string("%s is %d files", "file", "n"), about=F.concat(F.lit("file "), "file")))
    return reduce(DataFrame.unionByName, found)


def by_code(diagnostics: DataFrame) -> DataFrame:
    """(code, severity, n) of a table of diagnostics."""
    return diagnostics.groupBy("code", "severity").agg(F.count("*").alias("n"))


class Failed(Exception):
    """An analysis that is complete but counts as a failure: its diagnostics by code."""

    def __init__(self, counts: dict[str, int]):
        super().__init__(f"{sum(counts.values())} errors: {', '.join(f'{code} ({n})' for code, n in sorted(counts.items()))}")
        self.counts = counts


def judge(diagnostics: DataFrame, strict: bool = False) -> None:
    """Raises on an unusable configuration, and if ``strict`` on any error; what was written stays."""
    counts = {r.code: r.n for r in by_code(diagnostics.where("severity = 'error'")).collect()}
    if "IAC_HELM_INVALID_CONFIG" in counts:
        raise Failed({"IAC_HELM_INVALID_CONFIG": counts["IAC_HELM_INVALID_CONFIG"]})
    if strict and counts:
        raise Failed(counts)
