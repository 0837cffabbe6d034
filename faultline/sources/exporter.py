"""Snapshots that a front end exports: a command run in a revision's worktree.

The command prints one JSON document.  For snapshots it is that of
``snapshots.read``; for modules it has ``packages`` (package_path, modules,
sum_keys), ``sums`` (key to checksum) and ``config`` (a hash).
"""

from __future__ import annotations

import shlex
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SNAPSHOT
from . import git

MODULES = "packages array<struct<package_path: string, modules: array<string>, sum_keys: array<string>>>, sums map<string, string>, config string"


def _document(spark: SparkSession, command: str, revision: git.Revision, schema) -> DataFrame:
    with git.checkout(revision) as folder:
        done = subprocess.run(shlex.split(command), cwd=folder, capture_output=True, text=True, check=False)
    if done.returncode:
        raise RuntimeError(f"{command}: {done.stderr.strip() or done.returncode}")
    text = spark.createDataFrame([(done.stdout,)], "text string")
    return text.select(F.from_json("text", schema, {"mode": "FAILFAST"}).alias("d")).select("d.*")


def snapshot_loader(spark: SparkSession, command: str):
    """For ``plans.analyze.Engine``: the snapshot document of a revision."""
    return lambda revision, rev: _document(spark, command, revision, SNAPSHOT).withColumn("rev", F.lit(rev))


def module_loader(spark: SparkSession, command: str):
    """The same for modules, checksums and the configuration."""

    def load(revision: git.Revision, rev: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        found = _document(spark, command, revision, MODULES).withColumn("rev", F.lit(rev))
        packages = found.select("rev", F.explode("packages").alias("p")).select("rev", "p.package_path", F.array_sort("p.modules").alias("modules"), "p.sum_keys")
        return packages, found.select("rev", F.explode("sums").alias("key", "value")), found.select("rev", F.col("config").alias("global_hash"))

    return load
