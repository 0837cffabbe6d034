"""Snapshots as JSON documents, their relations, and the cache."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import cache_key
from ..schema import SNAPSHOT

#: Part of every cache key: rows of another version are never read.
ENGINE_VERSION = "faultline-1"
CACHE_VARIABLE = "FAULTLINE_CACHE"
BUILD_VARIABLES = ("GOOS", "GOARCH", "CGO_ENABLED", "GOFLAGS", "GOEXPERIMENT")


def read(spark: SparkSession, path: str, rev: str) -> DataFrame:
    """One row for each snapshot document, with its revision."""
    return spark.read.schema(SNAPSHOT).json(path, multiLine=True).withColumn("rev", F.lit(rev))


def packages(snapshots: DataFrame) -> DataFrame:
    rows = snapshots.select("rev", F.explode(F.map_values("packages")).alias("p"))
    return rows.select("rev", "p.path", "p.name", "p.relative_path", "p.hash", F.coalesce("p.imports", F.array().cast("array<string>")).alias("imports"))


def symbols(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("rev", F.explode(F.map_values("symbols")).alias("s")).select("rev", "s.id", "s.package_path", "s.hash")


def deps(snapshots: DataFrame) -> DataFrame:
    rows = snapshots.select("rev", F.explode(F.map_values("symbols")).alias("s"))
    return rows.select("rev", F.col("s.id").alias("sym"), F.explode("s.dependencies").alias("dep")).distinct()


class Cache:
    """Relations as Parquet, by a key of their content's address."""

    def __init__(self, root: str) -> None:
        self.root = root

    @classmethod
    def default(cls) -> Cache:
        root = os.environ.get(CACHE_VARIABLE, "")
        if root and not os.path.isabs(root):
            raise ValueError(f"{CACHE_VARIABLE} must be an absolute path")
        return cls(root or os.path.join(os.environ.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache"), "faultline"))

    @staticmethod
    def key(kind: str, tree: str, subdir: str, tool: str = "") -> str:
        return cache_key(ENGINE_VERSION, kind, tree, subdir, tool, *[os.environ.get(v, "") for v in BUILD_VARIABLES])

    def path(self, namespace: str, key: str) -> str:
        return f"{self.root}/{namespace}/{key}.parquet"

    def load(self, spark: SparkSession, namespace: str, key: str) -> DataFrame | None:
        """What was stored; None if nothing is there or it can't be read."""
        try:
            return spark.read.parquet(self.path(namespace, key))
        except AnalysisException:
            return None

    def store(self, df: DataFrame, namespace: str, key: str) -> DataFrame:
        """Written by Spark's commit protocol: whole or not at all."""
        df.write.mode("overwrite").parquet(self.path(namespace, key))
        return df.sparkSession.read.parquet(self.path(namespace, key))

    def through(self, spark: SparkSession, namespace: str, key: str, build) -> DataFrame:
        """Read-through: build and store what isn't there."""
        have = self.load(spark, namespace, key)
        return have if have is not None else self.store(build(), namespace, key)
