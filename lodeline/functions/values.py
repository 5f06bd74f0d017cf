"""Scalar functions over contents, names and roles, as Columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .identity import encode_segment

#: Format by extension; fixed values.
FORMATS = {"yaml": ("yaml", "yml"), "json": ("json",), "toml": ("toml",), "hcl": ("tf", "tfvars", "hcl"), "xml": ("xml",), "archive": ("tgz", "gz", "tar", "zip")}
RELEASE_NAME, RELEASE_DIGEST = 53, 8
PRIORITIES = {"override": 3, "parent": 2, "default": 1}
CLUSTER_KINDS = ("Namespace", "Node", "PersistentVolume", "ClusterRole", "ClusterRoleBinding", "CustomResourceDefinition", "StorageClass")


def format_of(path: Column) -> Column:
    extension = F.regexp_extract(F.lower(path), r"\.([^./]*)$", 1)
    out = F.lit("text")
    for name, known in FORMATS.items():
        out = F.when(extension.isin(*known), name).otherwise(out)
    return out


def is_text(content: Column) -> Column:
    """Valid UTF-8 without NUL."""
    text = content.cast("string")
    return F.coalesce(F.is_valid_utf8(text) & ~F.contains(text, F.lit("\x00")), F.lit(False))


def digest(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def ordered_digest(df: DataFrame, key: str, order: list[str], fact: str) -> DataFrame:
    """key and digest of its facts, joined by commas in order; null facts are left out. Facts stream by, no group is held as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, some = None, None, False
        for batch in batches:
            done = []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if sha is None or k != now:
                    if sha is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha, some = k, hashlib.sha256(), False
                if x is not None:
                    sha.update((("," if some else "") + x).encode())
                    some = True
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], batch.schema.field(0).type), pa.array([h for _, h in done], pa.string())], [key, "digest"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], batch.schema.field(0).type), pa.array([sha.hexdigest()], pa.string())], [key, "digest"])

    rows = df.repartition(key).sortWithinPartitions(key, *order).select(key, fact)
    return rows.mapInArrow(run, StructType([df.schema[key], StructField("digest", StringType())]))


def dns_label(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def release_name(chart: Column, sha256: Column) -> Column:
    """A DNS label of the chart's name and the first digits of its digest, within 53 characters."""
    tail = F.substring(sha256, 1, RELEASE_DIGEST)
    label = dns_label(chart)
    short = F.regexp_replace(F.substring(label, 1, RELEASE_NAME - RELEASE_DIGEST - 1), "^-+|-+$", "")
    base = F.when(F.length(label) > RELEASE_NAME - RELEASE_DIGEST - 1, short).otherwise(label)
    return F.concat_ws("-", F.when(base == "", "chart").otherwise(base), tail)


def api_group(api_version: Column) -> Column:
    """The group of an API version; the core group has none."""
    return F.when(F.contains(api_version, F.lit("/")), F.split_part(api_version, F.lit("/"), F.lit(1))).otherwise(F.lit("core"))


def roles(array: Column) -> Column:
    """Roles trimmed, without empty ones, each once, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(array, lambda r: F.trim(r)), lambda r: r != "")))


def priority(array: Column) -> Column:
    """How strongly a values file with these roles speaks."""
    known = F.transform(array, lambda r: F.when(r == "override", 3).when(r == "parent", 2).when(r == "default", 1).otherwise(0))
    return F.coalesce(F.array_max(known), F.lit(0))


def secret_digest(data: Column, encoded: Column) -> Column:
    """The digest of a secret's bytes: base64 where ``encoded`` and well formed, else the text itself."""
    strict = F.regexp_replace(data, r"[\r\n]", "")
    whole = strict.rlike("^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\\z")
    raw = F.when(encoded & whole, F.unbase64(strict)).otherwise(F.encode(data, "UTF-8"))
    return F.sha2(raw, 256)


def package_url(repository: Column, name: Column) -> Column:
    """The package of a dependency in a container registry; null where it names none unambiguously."""
    location = F.trim(repository)
    host = F.regexp_extract(location, r"^oci://([^/?#@]+)(/[^?#]*)?\z", 1)
    path = F.trim(F.regexp_extract(location, r"^oci://([^/?#@]+)(/[^?#]*)?\z", 2), F.lit("/"))
    own = F.trim(name)
    odd = F.exists(F.split(path, "/"), lambda s: s.isin("", ".", "..")) & (path != "")
    fits = (host != "") & (path == F.lower(path)) & ~odd & (own != "") & (own == F.lower(own)) & ~F.contains(own, F.lit("/")) & ~F.contains(path, F.lit("%"))
    place = F.concat_ws("/", F.lower(host), F.when(path != "", path), own)
    return F.when(fits, F.concat(F.lit("pkg:oci/"), encode_segment(own), F.lit("?repository_url="), encode_segment(place)))
