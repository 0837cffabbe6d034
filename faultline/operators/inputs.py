"""Embedded files and initialisation order as dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity
from ..functions.comments import ancestors, glob_regex


def embed_matches(patterns: DataFrame, files: DataFrame) -> DataFrame:
    """(pkg, pattern, file): files that match themselves or by a folder above.

    Patterns and files meet on their package, so no file is held against the
    patterns of other packages.
    """
    folders = files.select("pkg", "file", F.explode(ancestors("file")).alias("_a"))
    hit = folders.join(patterns.select("pkg", "pattern", glob_regex("pattern").alias("_r")), "pkg").where(F.expr("_a rlike _r"))
    return hit.select("pkg", "pattern", "file").distinct()


def embed_dependencies(declared: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols (rev, id, package_path, hash) of matched files and the
    dependencies (rev, sym, dep) of the variables that embed them.

    ``declared(rev, decl_id, pkg, pattern)``, ``files(rev, pkg, file, hash)``.
    """
    scope = F.concat_ws("\u0001", "rev", "pkg")
    hits = embed_matches(declared.select(scope.alias("pkg"), "pattern").distinct(), files.select(scope.alias("pkg"), "file"))
    found = hits.select(F.split("pkg", "\u0001")[0].alias("rev"), F.split("pkg", "\u0001")[1].alias("pkg"), "pattern", "file")
    ident = identity.embed_file_id("pkg", "file")
    symbols = found.select("rev", "pkg", "file").distinct().join(files, ["rev", "pkg", "file"]).select("rev", ident.alias("id"), F.col("pkg").alias("package_path"), "hash")
    deps = declared.join(found, ["rev", "pkg", "pattern"]).select("rev", F.col("decl_id").alias("sym"), ident.alias("dep")).distinct()
    return symbols, deps


def initialization(packages: DataFrame, symbols: DataFrame, effectful: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Package-init symbols and their dependencies: own inits and blank
    initialisers, the inits of imported local packages, effectful variables.

    ``packages(rev, path, imports, hash)``, ``symbols(rev, id, package_path,
    kind)``, ``effectful(rev, id, package_path)``.
    """
    made = packages.select("rev", identity.package_init_id("path").alias("id"), F.col("path").alias("package_path"), F.sha2(F.coalesce("hash", F.lit("")), 256).alias("hash"))
    own = symbols.where("kind in ('init', 'blank-initializer')").select("rev", "package_path", F.col("id").alias("dep"))
    other = effectful.select("rev", "package_path", F.col("id").alias("dep"))
    here = packages.select("rev", F.col("path").alias("imported"))
    imports = packages.select("rev", F.col("path").alias("package_path"), F.explode("imports").alias("imported")).join(here, ["rev", "imported"], "left_semi")
    below = imports.select("rev", "package_path", identity.package_init_id("imported").alias("dep"))
    deps = own.unionByName(other).unionByName(below).select("rev", identity.package_init_id("package_path").alias("sym"), "dep").distinct()
    return made, deps
