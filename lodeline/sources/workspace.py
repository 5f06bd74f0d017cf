"""Inventories: files of a workspace as a Spark data source, and graph tables written before."""

from __future__ import annotations

import os
import stat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.identity import artifact_id, is_relative_path
from ..functions.values import digest, format_of, is_text
from ..functions.workers import visible

SKIPPED = {".git", ".hg", ".svn"}
SCHEMA = "path string, content binary, problem string"


def listed(root: str, selections: list[str]) -> list[str]:
    """Paths under ``root`` of the files selected, each once, sorted; links out of the root and special files are left out."""
    top = os.path.realpath(root)
    found = set()
    for selection in selections:
        at = os.path.normpath(os.path.join(top, selection))
        if at != top and not at.startswith(top + os.sep):
            raise ValueError(f"{selection!r} lies outside the workspace")
        walked = [(os.path.dirname(at), [], [os.path.basename(at)])] if os.path.isfile(at) else os.walk(at, followlinks=False)
        for folder, folders, files in walked:
            folders[:] = [f for f in folders if f not in SKIPPED]
            for name in files:
                real = os.path.realpath(os.path.join(folder, name))
                if real.startswith(top + os.sep):
                    found.add(os.path.relpath(real, top).replace(os.sep, "/"))
    return sorted(found)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.selections = options.get("selections", ".").split("\n")
        self.files = int(options.get("filesperpartition", "64"))

    def partitions(self):
        paths = listed(self.root, self.selections)
        return [_Files(paths[i : i + self.files]) for i in range(0, len(paths), self.files)] or [_Files([])]

    def read(self, partition):
        for path in partition.paths:
            try:
                at = os.open(os.path.join(self.root, path), os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
                with os.fdopen(at, "rb") as f:
                    if not stat.S_ISREG(os.fstat(at).st_mode):
                        yield path, None, "not a regular file"
                    else:
                        yield path, f.read(), None
            except OSError as e:
                yield path, None, e.strerror


class WorkspaceSource(DataSource):
    """``spark.read.format("workspace").load(root)``: path, content and problem of every file, hidden ones too."""

    @classmethod
    def name(cls):
        return "workspace"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def files(spark: SparkSession, root: str, selections: tuple[str, ...] = (".",)) -> DataFrame:
    visible(spark)
    spark.dataSource.register(WorkspaceSource)
    return spark.read.format("workspace").option("selections", "\n".join(selections)).load(root)


def artifacts(files: DataFrame, app: str) -> DataFrame:
    """The inventory: artifact_id, app, path, format, sha256, source, size_bytes and problem.

    What isn't text keeps its digest, without source; a path that can't be one has no identity.
    """
    text = is_text(F.col("content"))
    problem = F.coalesce("problem", F.when(~is_relative_path(F.col("path")), "path"), F.when(~text, "not text"))
    return files.dropDuplicates(["path"]).select(
        artifact_id(F.lit(app), F.col("path")).alias("artifact_id"),
        F.lit(app).alias("app"),
        "path",
        format_of(F.col("path")).alias("format"),
        digest(F.col("content")).alias("sha256"),
        F.when(text, F.col("content").cast("string")).otherwise("").alias("source"),
        F.when(text, F.length("content")).otherwise(0).cast("long").alias("size_bytes"),
        problem.alias("problem"),
    )


def from_graph(nodes: DataFrame, app: str) -> DataFrame:
    """The inventory out of node rows (id, path, format, sha256, source, size_bytes), each with its state.

    States: ok, missing (no source), not text, changed (the digest differs) and foreign (another identity).
    """
    prefix = artifact_id(F.lit(app), F.lit("x"))
    own = nodes.where(F.startswith("id", F.regexp_replace(prefix, "x$", "")))
    state = (
        F.when(artifact_id(F.lit(app), F.col("path")) != F.col("id"), "foreign").when(F.col("source").isNull(), "missing")
        .when(~is_text(F.col("source")), "not text").when(digest(F.col("source")) != F.col("sha256"), "changed").otherwise("ok")
    )
    return own.withColumn("state", state)
