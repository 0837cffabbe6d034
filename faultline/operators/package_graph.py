"""From affected symbols to packages and the edges between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .diff import current


def symbol_packages(symbols: DataFrame) -> DataFrame:
    """(id, package_path)."""
    return current(symbols.select("rev", "id", "package_path"), "id")


def affected_packages(affected: DataFrame, symbols: DataFrame, packages: DataFrame) -> DataFrame:
    """(path, relative_path, name) of the packages with an affected symbol."""
    paths = affected.select(F.col("node").alias("id")).join(symbol_packages(symbols), "id").select(F.col("package_path").alias("path")).distinct()
    return paths.join(current(packages.select("rev", "path", "relative_path", "name"), "path"), "path").select("path", "relative_path", "name")


def in_order(packages: DataFrame) -> DataFrame:
    return packages.orderBy("relative_path", "name", "path")


def changed_packages(changed: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path) of the packages with a changed symbol; unknown ids are dropped."""
    return changed.join(symbol_packages(symbols), "id").select(F.col("package_path").alias("path")).distinct()


def package_edges(affected: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst) between different packages, both ends affected."""
    owner = affected.select(F.col("node").alias("id")).join(symbol_packages(symbols), "id")
    a = owner.select(F.col("id").alias("src"), F.col("package_path").alias("from_package"))
    b = owner.select(F.col("id").alias("dst"), F.col("package_path").alias("to_package"))
    pairs = edges.join(a, "src").join(b, "dst").where("from_package <> to_package")
    return pairs.select(F.col("from_package").alias("src"), F.col("to_package").alias("dst")).distinct()
