"""Symbols from declaration facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, identity
from ..functions.comments import is_build_affecting, is_package_wide, normalized


def init_ordinals(decls: DataFrame) -> DataFrame:
    """Adds ``init_index``: inits are numbered across the files of a package."""
    order = Window.partitionBy("rev", "pkg").orderBy("file_ord", "pos")
    return decls.withColumn("init_index", F.row_number().over(order) - 1)


def blank_ordinals(decls: DataFrame) -> DataFrame:
    """Adds ``blank_index``: blank initialisers are numbered per file, and those
    without an effect take a number but give no symbol."""
    order = Window.partitionBy("rev", "pkg", "file").orderBy("pos")
    return decls.withColumn("blank_index", F.row_number().over(order) - 1).where("effectful").drop("effectful")


def members(types: DataFrame) -> DataFrame:
    """(rev, id, package_path, hash) of the members of ``types(rev, pkg, kind,
    owner, members array<struct<name, text>>)``; unnamed ones by position."""
    rows = types.select("rev", "pkg", "kind", "owner", F.posexplode("members").alias("pos", "m"))
    return rows.select("rev", identity.member_id("pkg", "kind", "owner", F.col("m.name"), "pos").alias("id"), F.col("pkg").alias("package_path"), hashing.text_hash("m.text").alias("hash"))


def value_specs(specs: DataFrame) -> DataFrame:
    """One row per name of ``specs(.., names, values)``: the paired value, or the
    one value that all names share, with the index of its result."""
    rows = specs.select(*[c for c in specs.columns if c != "names"], F.posexplode("names").alias("pos", "name"))
    paired = F.col("pos") < F.size("values")
    shared = (F.size("values") == 1) & (F.col("pos") > 0)
    value = F.when(paired, F.get("values", F.col("pos"))).when(shared, F.get("values", F.lit(0)))
    return rows.withColumn("value", value).withColumn("result_index", F.when(shared & ~paired, F.col("pos")).otherwise(0)).drop("values")


def unique_symbols(symbols: DataFrame, ordinal: str) -> DataFrame:
    """Of several declarations with one id the last counts."""
    return symbols.groupBy("rev", "id").agg(F.max_by(F.struct("package_path", "hash"), ordinal).alias("_s")).select("rev", "id", "_s.*")


def base_dependencies(uses: DataFrame, objects: DataFrame) -> DataFrame:
    """(rev, sym, dep): used objects that are symbols of the module, not itself."""
    local = objects.where("symbol_id is not null").select("rev", "obj", F.col("symbol_id").alias("dep"))
    return uses.join(local, ["rev", "obj"]).where("decl_id <> dep").select("rev", F.col("decl_id").alias("sym"), "dep").distinct()


def content_symbols(packages: DataFrame) -> DataFrame:
    """The symbol that stands for a package's whole content."""
    return packages.select("rev", identity.content_id("path").alias("id"), F.col("path").alias("package_path"), "hash")


def package_hashes(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(rev, pkg, hash): hash over sorted file hashes, then sorted imports."""
    a = files.groupBy("rev", "pkg").agg(F.array_sort(F.collect_list("file_hash")).alias("f"))
    b = imports.groupBy("rev", "pkg").agg(F.array_sort(F.collect_set("imported")).alias("i"))
    both = a.join(b, ["rev", "pkg"], "left")
    return both.select("rev", "pkg", hashing.joined_hash(F.concat("f", F.coalesce("i", F.array().cast("array<string>")))).alias("hash"))


def build_metadata(comments: DataFrame, package_wide: bool) -> DataFrame:
    """(rev, owner, hash) over the sorted directives that affect a build; for
    packages those that count package-wide, and all cgo preambles."""
    rows = comments.withColumn("d", normalized("comment"))
    wanted = F.col("is_cgo_preamble") | is_package_wide("d") if package_wide else is_build_affecting("d")
    return rows.where(wanted).groupBy("rev", "owner").agg(hashing.sorted_hash("d").alias("hash"))


def used_objects(uses: DataFrame) -> DataFrame:
    return uses.select("rev", "pkg", "obj").distinct()


def call_results_used(calls: DataFrame, targets: DataFrame, used: DataFrame) -> DataFrame:
    """(call, used): a statement's result isn't; of assigned results the first
    name that isn't blank decides; anything else is.

    ``calls(call, pkg, parent_kind)``, ``targets(call, pos, name, obj)``.
    """
    first = targets.where("name <> '_'").groupBy("call").agg(F.min_by("obj", "pos").alias("obj"))
    known = used.select("pkg", "obj").distinct().withColumn("u", F.lit(True))
    rows = calls.join(first, "call", "left").join(known, ["pkg", "obj"], "left")
    value = F.when(F.col("parent_kind") == "stmt", False).when(F.col("parent_kind") == "assign", F.coalesce("u", F.lit(False))).otherwise(True)
    return rows.select("call", value.alias("used"))


def effectful_declarations(expressions: DataFrame) -> DataFrame:
    """(rev, decl_id) whose initialiser calls or receives outside literals."""
    return expressions.where("kind in ('call', 'recv') and enclosing_lit is null").select("rev", "decl_id").distinct()


def load_error(errors: DataFrame) -> DataFrame:
    """(message): all errors, sorted, in one text (null if there is none)."""
    return errors.agg(F.nullif(F.array_join(F.array_sort(F.collect_list("message")), "; "), F.lit("")).alias("message"))


def first_error(errors: DataFrame) -> DataFrame:
    """(message) of the smallest index, whatever finished first."""
    return errors.agg(F.min_by("message", "idx").alias("message"))
