"""Which files are what: claims of detectors, and the kinds of files around a chart."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import base_name


def settled_claims(claims: DataFrame, key: str, dialect: str) -> DataFrame:
    """key, dialect and status of what detectors claim: one claim stands, several are ambiguous."""
    each = claims.groupBy(key).agg(F.array_sort(F.collect_set(dialect)).alias("claims"))
    return each.select(key, F.when(F.size("claims") == 1, F.get("claims", 0)).alias(dialect), F.array_join("claims", ",").alias("claims"), F.when(F.size("claims") == 1, "claimed").otherwise("ambiguous").alias("status"))


def kind_and_roles(relative: Column, api_version: Column, chart_type: Column, override: Column, hook: Column) -> Column:
    """struct(kind, roles) of a file by its path relative to its chart; the first rule that fits counts. Null: not part of the chart."""
    base = base_name(relative)
    v1 = api_version == "v1"

    def of(kind: str, roles: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), roles.alias("roles"))

    def one(*roles: str) -> Column:
        return F.array(*(F.lit(r) for r in roles))

    main = F.when(F.startswith(relative, F.lit("templates/tests/")), "test").when(base == "NOTES.txt", "notes").when(F.startswith(base, F.lit("_")), "helper").otherwise("resource")
    template = F.when(hook, F.array(main, F.lit("hook"))).otherwise(F.array(main))
    return (
        F.when(relative == "Chart.yaml", of("helm_chart", F.array(chart_type)))
        .when((relative == "values.yaml") & override, of("helm_values", one("default", "override")))
        .when(relative == "values.yaml", of("helm_values", one("default")))
        .when(relative == "values.schema.json", of("helm_values_schema", one("validation_schema")))
        .when((relative == "requirements.yaml") & v1, of("helm_requirements", one("legacy_dependency_manifest")))
        .when(relative == "Chart.lock", of("helm_lock", one("dependency_lock")))
        .when((relative == "requirements.lock") & v1, of("helm_lock", one("legacy_dependency_lock")))
        .when(relative == ".helmignore", of("helm_ignore", one("ignore_rules")))
        .when(override, of("helm_values", one("override")))
        .when(F.startswith(relative, F.lit("crds/")), of("helm_crd", one("custom_resource_definition")))
        .when(F.startswith(relative, F.lit("templates/")) & (relative != "templates/"), of("helm_template", template))
    )


def excluded(path: Column) -> Column:
    """Read-me and licence files and packed archives: never part of a chart."""
    base = F.upper(base_name(path))
    return F.startswith(base, F.lit("README")) | F.startswith(base, F.lit("LICENSE")) | F.endswith(base, F.lit(".TGZ"))


HOOK = "helm.sh/hook"
_KEY = re.compile(r"""(['"]?)([^\s'"#{\[-][^'":]*?|[^\s'"#{\[][^\s'":]*)\1\s*:(?=\s|$)""")


def _flow_has_hook(rest: str) -> bool:
    """Whether a mapping in braces has the hook among its own keys."""
    own = re.sub(r"""(['"])helm\.sh/hook\1(?=\s*:)""", HOOK, rest)
    own = re.sub(r"""'(?:[^']|'')*'|"(?:[^"\\]|\\.)*\"""", "", own)
    before = None
    while own != before:
        before, own = own, re.sub(r"(?<!^)[\[{][^\[\]{}]*[\]}]", "", own)
    return re.match(r"\{(?:.*,)?\s*helm\.sh/hook\s*:", own) is not None


def _has_hook(source: str) -> bool:
    """One pass over the lines keeps the indents of a document's root, of ``metadata`` and of ``annotations``."""
    # meta: indent of the keys of metadata, 0 before the first of them; inside: the same for annotations.
    root = meta = inside = None
    for line in source.split("\n"):
        bare = re.sub(r"\{\{.*?\}\}", "", line.rstrip("\r"))
        text = bare.lstrip(" ")
        if re.match(r"(---|\.\.\.)(\s|$)", bare):
            root = meta = inside = None
            continue
        if not text.strip() or text.startswith("#"):
            continue
        indent = len(bare) - len(text) + 1
        found = _KEY.match(text)
        key = found[2] if found else ""
        rest = re.sub(r"^#.*|\s+#.*$|\s+$", "", text[found.end() :].lstrip()) if found else text
        root = root or indent
        if indent <= root:
            meta, inside = (0 if key == "metadata" and not rest else None), None
        elif meta is not None and indent <= (meta or indent):
            meta, inside = indent, (0 if key == "annotations" and not rest else None)
            if key == "annotations" and _flow_has_hook(rest):
                return True
        elif inside is not None:
            if not inside:
                inside = None if text.startswith("-") else indent
            if inside == indent and key == HOOK:
                return True
    return False


def is_hook(source: Column) -> Column:
    """Whether a document of the manifest annotates the hook key directly under ``metadata.annotations`` of its root.

    Template actions and comments count as nothing, and a document begins anew after ``---`` or ``...``.
    Only files that name the key at all go to Python.
    """

    @F.pandas_udf("boolean")
    def has_hook(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t is not None and _has_hook(t)).astype(bool)

    return has_hook(F.when(F.contains(source, F.lit(HOOK)), source))
