"""Profiles to render charts with, as configurations declare them: whole configurations or nothing of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import artifact_id, config_key_id, encode_value_segment, is_relative_path, semantic_id
from ..functions.values import release_name

#: What a configuration may say at the top and of a profile: names with the kind of their values; fixed values.
TOP = {"version": "int", "renders": "seq"}
FIELDS = {"name": "text", "chart": "text", "release_name": "text", "namespace": "text", "values": "seq", "set": "map", "kube_version": "text", "api_versions": "seq"}
VERSION, NAMESPACE = 1, "default"
#: The tables besides profiles that configured_profiles makes.
TABLES = {
    "layers": "profile string, layer string, ordinal int, source string, key string, value string", "set_keys": "artifact_id string, key string, path string, line int",
    "api_versions": "profile string, nth int, api_version string", "problems": "artifact_id string, about string, message string",
}
_NO_TEXT = ("map", "seq", "alias")


def _selected(selector: Column, app: str) -> Column:
    """The identity that a selector means: one as it stands, or that of a path inside the application."""
    s = F.trim(selector)
    return F.when(F.startswith(s, F.lit("can://")), s).when((s != "") & is_relative_path(s), artifact_id(F.lit(app), s))


def configured_profiles(keys: DataFrame, artifacts: DataFrame, charts: DataFrame, app: str) -> dict[str, DataFrame]:
    """Tables of what configurations (``keys``: as yaml_keys gives them) declare.

    profiles (config, profile, name, chart, release, namespace, kube_version), layers (profile, layer,
    ordinal, source, key, value), set_keys (artifact_id, key, path, line), api_versions (profile, nth,
    api_version) and problems (artifact_id, about, message). Charts and values files are selected among
    ``artifacts``; files are layers in their order, then what ``set`` says, by name. A configuration with
    any problem is in none of the tables but the last.
    """
    k = keys.withColumn("n", F.size("keys"))
    at = lambda i: F.get("keys", F.lit(i))
    problems = []

    def problem(df: DataFrame, about: Column, message: Column) -> None:
        problems.append(df.select("artifact_id", about.alias("about"), message.alias("message")))

    problem(k.where("keys IS NULL"), F.lit("yaml"), F.concat(F.lit("no valid YAML: "), "value"))
    k = k.where("keys IS NOT NULL")

    def kinds(row: DataFrame, field: Column, known: dict[str, str]) -> DataFrame:
        expected = F.try_element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), field)
        fits = F.when(expected == "text", ~F.col("kind").isin(*_NO_TEXT)).when(expected.isNotNull(), (F.col("kind") == expected) | ((F.col("kind") == "null") & (expected != "int")))
        return row.where(~F.coalesce(fits, F.lit(False)))

    where = F.array_join("keys", ".")
    problem(kinds(k.where("n = 1"), at(0), TOP), F.concat(F.lit("document "), where), F.concat(F.lit("not accepted: "), where))
    inside = k.where((F.col("n") > 1) & (at(0) == "renders"))
    problem(inside.where("n = 2 AND kind <> 'map'"), F.concat(F.lit("document "), where), F.concat(F.lit("not a profile: "), where))
    problem(kinds(inside.where("n = 3"), at(2), FIELDS), F.concat(F.lit("document "), where), F.concat(F.lit("not accepted: "), where))
    problem(inside.where((F.col("n") > 4) | (F.col("n") == 4) & F.col("kind").isin(*_NO_TEXT)), F.concat(F.lit("document "), where), F.concat(F.lit("not accepted: "), where))
    problem(k.where("duplicate"), F.concat(F.lit("document "), where), F.concat(F.lit("there twice: "), where))
    version = F.col("value").try_cast("int")
    problem(k.where((F.col("n") == 1) & (at(0) == "version") & (F.col("kind") == "int") & ~F.coalesce(version.isin(0, VERSION), F.lit(False))), F.lit("version"), F.concat(F.lit("version is not supported: "), "value"))

    nth = at(1).cast("int").alias("nth")
    texts = [f for f, kind in FIELDS.items() if kind == "text"]
    entries = inside.where("n = 2").select("artifact_id", nth)
    said = inside.where("n = 3").select("artifact_id", nth, at(2).alias("field"), F.trim("value").alias("value")).groupBy("artifact_id", "nth").pivot("field", texts).agg(F.first("value"))
    p = entries.join(said, ["artifact_id", "nth"], "left").withColumn("position", F.concat(F.lit("renders."), F.col("nth").cast("string")))
    p = p.withColumn("again", F.row_number().over(Window.partitionBy("artifact_id", "name").orderBy("nth")) > 1).withColumn("selected", _selected(F.col("chart"), app)).drop("chart")
    blank = F.coalesce("name", F.lit("")) == ""
    problem(p.where(blank), F.concat("position", F.lit(".name")), F.concat(F.lit("no name at "), "position"))
    problem(p.where(~blank & F.col("again")), F.concat("position", F.lit(".name.duplicate")), F.concat(F.lit("declared more than once: "), "name"))
    of = charts.select(F.col("chart").alias("selected"), F.col("name").alias("chart_name")).join(artifacts.select(F.col("artifact_id").alias("selected"), "sha256"), "selected")
    p = p.join(of, "selected", "left")
    problem(p.where(F.col("chart_name").isNull()), F.concat("position", F.lit(".chart")), F.concat(F.lit("selects no chart: "), F.coalesce("name", "position")))

    items = inside.where("n = 4")
    files = items.where(at(2) == "values").select("artifact_id", nth, at(3).cast("int").alias("place"), F.col("value").alias("selector"), _selected(F.col("value"), app).alias("source"))
    lost = files.join(artifacts.select(F.col("artifact_id").alias("source")), "source", "left_anti")
    spot = F.concat(F.lit("renders."), F.col("nth").cast("string"))
    problem(lost, F.concat(spot, F.lit(".values")), F.concat(F.lit("selects no file: "), F.coalesce("selector", F.lit(""))))
    sets = items.where(at(2) == "set").select("artifact_id", nth, at(3).alias("key"), "value", "line")
    problem(sets.where("key = ''"), F.concat(spot, F.lit(".set")), F.concat(F.lit("a value without a name at "), spot))

    found = reduce(DataFrame.unionByName, problems).dropDuplicates(["artifact_id", "about"])
    good = lambda df: df.join(found.select("artifact_id").distinct(), "artifact_id", "left_anti")
    default = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), other)
    p = good(p).withColumn("profile", semantic_id(F.lit(app), "config", F.lit("profile"), F.col("name")))
    profiles = p.select(F.col("artifact_id").alias("config"), "profile", "name", F.col("selected").alias("chart"), default("release_name", release_name(F.col("chart_name"), F.col("sha256"))).alias("release"), default("namespace", F.lit(NAMESPACE)).alias("namespace"), F.nullif("kube_version", F.lit("")).alias("kube_version"))
    ids = p.select("artifact_id", "nth", "profile")
    set_keys = good(sets).withColumn("path", F.concat(spot, F.lit(".set."), encode_value_segment(F.col("key")))).withColumn("source", config_key_id(F.col("artifact_id"), F.col("path")))
    every = good(files).select("artifact_id", "nth", F.lit(0).alias("after"), "place", F.lit("").alias("key"), "source", F.lit(None).cast("string").alias("value"))
    every = every.unionByName(set_keys.select("artifact_id", "nth", F.lit(1).alias("after"), F.lit(0).alias("place"), "key", "source", "value"))
    ordinal = F.row_number().over(Window.partitionBy("profile").orderBy("after", "place", "key")) - 1
    layers = every.join(ids, ["artifact_id", "nth"]).withColumn("ordinal", ordinal)
    number = F.col("ordinal").cast("string")
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    layers = layers.select("profile", F.concat("profile", F.lit("/value-layer/"), padded).alias("layer"), "ordinal", "source", F.nullif("key", F.lit("")).alias("key"), "value")
    api = good(items.where(at(2) == "api_versions").select("artifact_id", nth, at(3).cast("int").alias("item"), "value")).join(ids, ["artifact_id", "nth"])
    return {
        "profiles": profiles, "layers": layers, "set_keys": set_keys.select("artifact_id", F.col("source").alias("key"), "path", "line"),
        "api_versions": api.select("profile", F.col("item").alias("nth"), F.col("value").alias("api_version")), "problems": found,
    }


def default_profiles(charts: DataFrame, artifacts: DataFrame, app: str) -> DataFrame:
    """(config, profile, name, chart, release, namespace, kube_version) of the profile that every chart has without a configuration; its config is the chart."""
    own = charts.join(artifacts.select(F.col("artifact_id").alias("chart"), "sha256"), "chart")
    profile = F.concat(semantic_id(F.lit(app), "helm", F.lit("chart"), F.col("directory")), F.lit("/profile/default"))
    return own.select(F.col("chart").alias("config"), profile.alias("profile"), F.lit("default").alias("name"), "chart", release_name(F.col("name"), F.col("sha256")).alias("release"), F.lit(NAMESPACE).alias("namespace"), F.lit(None).cast("string").alias("kube_version"))
