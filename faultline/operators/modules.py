"""Module and checksum changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import module_identity, sum_keys
from .closure import labelled_closure


def sums_last_wins(lines: DataFrame) -> DataFrame:
    """(rev, key, value) of ``lines(rev, file_ord, line_no, line)``: lines with
    three fields, the later file and then the later line winning."""
    fields = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    rows = lines.select("rev", "file_ord", "line_no", fields.alias("f")).where(F.size("f") == 3)
    key = F.concat(F.col("f")[0], F.lit("@"), F.col("f")[1])
    return rows.groupBy("rev", key.alias("key")).agg(F.max_by(F.col("f")[2], F.struct("file_ord", "line_no")).alias("value"))


def package_modules(imports: DataFrame, modules: DataFrame, local: DataFrame) -> DataFrame:
    """(rev, package_path, modules, sum_keys): non-main modules reachable over
    imports from each local package.

    ``imports(rev, package_path, imported)``, ``modules(rev, package_path, path,
    version, replaced_path, replaced_version, main)``, ``local(rev, package_path)``.
    """
    edge = lambda c: F.concat_ws("\u0001", F.col("rev"), F.col(c))
    edges = imports.select(edge("package_path").alias("src"), edge("imported").alias("dst"))
    base = local.select(edge("package_path").alias("node"), edge("package_path").alias("label"))
    reach = labelled_closure(edges, base).where("node <> label")
    identity = module_identity("path", "version", "replaced_path", "replaced_version")
    keys = F.concat(sum_keys("path", "version"), sum_keys("replaced_path", "replaced_version"))
    known = modules.where("not main").select(edge("package_path").alias("node"), identity.alias("m"), keys.alias("k"))
    found = reach.join(known, "node").groupBy("label").agg(F.collect_set("m").alias("m"), F.collect_set("k").alias("k"))
    named = local.select("rev", "package_path", edge("package_path").alias("label")).join(found, "label", "left")
    none = F.array().cast("array<string>")
    return named.select("rev", "package_path", F.array_sort(F.coalesce("m", none)).alias("modules"), F.array_sort(F.array_distinct(F.flatten(F.coalesce("k", F.array(none))))).alias("sum_keys"))


def checksum_changes(pkg: DataFrame, sums: DataFrame) -> DataFrame:
    """(package_path): a key that both revisions list and know has changed."""
    keys = pkg.select("rev", "package_path", F.explode("sum_keys").alias("key")).join(sums, ["rev", "key"])
    both = keys.groupBy("package_path", "key").agg(F.count_distinct("rev").alias("revs"), F.count_distinct("value").alias("values"))
    return both.where("revs = 2 and values = 2").select("package_path").distinct()


def changed_packages(pkg: DataFrame, sums: DataFrame, config: DataFrame) -> DataFrame:
    """(package_path) in both revisions whose configuration, modules or
    checksums differ; added and removed packages don't count."""
    both = pkg.groupBy("package_path").agg(
        F.max(F.when(F.col("rev") == "old", F.col("modules"))).alias("o"), F.max(F.when(F.col("rev") == "new", F.col("modules"))).alias("n"), F.count_distinct("rev").alias("revs")
    ).where("revs = 2")
    hashes = config.agg(F.count_distinct("global_hash").alias("configs"))
    sums_changed = checksum_changes(pkg, sums).withColumn("s", F.lit(True))
    all_of = both.join(F.broadcast(hashes)).join(sums_changed, "package_path", "left")  # hashes: one row
    return all_of.where((F.col("configs") > 1) | (F.col("o") != F.col("n")) | F.col("s")).select("package_path")


def config_hash(fields: DataFrame) -> DataFrame:
    """(rev, global_hash) of ``fields(rev, file, field, value)``: the workspace
    file overrides the module file unless its value is empty."""
    used = fields.where("value <> ''").groupBy("rev", "field").agg(F.max_by("value", F.when(F.col("file") == "go.work", 1).otherwise(0)).alias("value"))
    pair = F.concat("field", F.lit("\u0000"), "value", F.lit("\u0000"))
    return used.groupBy("rev").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(pair)), ""), 256).alias("global_hash"))


def module_path(loaded: DataFrame) -> DataFrame:
    """(path) of the main module, else of the first with any, by ``ord``."""
    best = F.min_by("path", F.struct(F.when(F.col("main"), 0).otherwise(1), F.col("ord")))
    return loaded.where("path is not null").agg(F.coalesce(best, F.lit("")).alias("path"))
