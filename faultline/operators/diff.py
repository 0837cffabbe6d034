"""What changed between two snapshots, and who uses what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import is_dispatch, package_init_id


def symbol_changes(symbols: DataFrame) -> DataFrame:
    """(id, kind): added, removed or modified; dispatch symbols never count."""
    seen = symbols.where(~is_dispatch("id")).groupBy("id").agg(
        F.max(F.when(F.col("rev") == "old", F.col("hash"))).alias("o"), F.max(F.when(F.col("rev") == "new", F.col("hash"))).alias("n")
    )
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("modified")
    return seen.where(~F.col("o").eqNullSafe(F.col("n"))).select("id", kind.alias("kind"))


def changed_symbols(symbols: DataFrame, module_changes: DataFrame | None = None) -> DataFrame:
    """(id): changed symbols, and the inits of packages whose modules changed."""
    out = symbol_changes(symbols).select("id")
    if module_changes is not None:
        out = out.unionByName(module_changes.select(package_init_id("package_path").alias("id"))).distinct()
    return out


def reverse_edges(symbols: DataFrame, deps: DataFrame) -> DataFrame:
    """(src, dst): used symbol to user, for targets of the same revision."""
    local = deps.join(symbols.select("rev", F.col("id").alias("dep")), ["rev", "dep"], "left_semi")
    return local.select(F.col("dep").alias("src"), F.col("sym").alias("dst")).distinct()


def current(rows: DataFrame, key: str) -> DataFrame:
    """One row per key; the new revision overrides the old one."""
    columns = [c for c in rows.columns if c not in (key, "rev")]
    best = F.max_by(F.struct(*columns), F.when(F.col("rev") == "new", 1).otherwise(0))
    return rows.groupBy(key).agg(best.alias("_b")).select(key, "_b.*")
