"""Exact deduplication by recipes of content-defined chunks.

A text (white space runs made one blank) is cut into sentences, and after a
sentence whose hash is divisible by ``cut`` a chunk ends: the cut depends on the
content next to it only, so equal passages give equal chunks wherever they
stand.  Each distinct chunk is moved once, to verify that its 64-bit identifier
stands for one byte string; documents are then compared by their short ordered
lists of identifiers and their texts are not moved at all.  Spark expressions
only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach_groups, materialize, slim


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def chunked(text: Column, cut: int = 8) -> Column:
    """The chunks of a normalised text; they concatenate to it."""
    def build(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.pmod(F.xxhash64(F.get(s, i - 1)), F.lit(cut)) == 0),
        )
        return F.transform(
            F.arrays_zip(starts.alias("a"), F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(s))).alias("b")),
            lambda r: F.array_join(F.slice(s, r["a"] + 1, r["b"] - r["a"]), ""),
        )

    # a one-element transform computes the sentences once per row
    return F.get(F.transform(F.array(F.split(text, r"(?<=[.!?] )", -1)), build), F.lit(0))


def recipes(docs: DataFrame, chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, recipe (ordered verified chunk identifiers), text_sha256.

    An identifier is the hash of the chunk; where different chunks share a hash
    (the dictionary of distinct chunks is searched for that), their ordinal
    among these is part of it.
    """
    base = slim(docs, "doc_id", "text").select("doc_id", normalized(F.col("text")).alias("_n"))
    chunks = base.select(F.explode(chunked(F.col("_n"))).alias("_c"))
    dictionary = chunks.select(chunk_hash(F.col("_c")).alias("_h"), "_c").distinct()
    clashes = dictionary.groupBy("_h").agg(F.count("*").alias("_m")).where("_m > 1").select("_h")
    digest = F.sha2(F.col("_n"), 256).alias("text_sha256")
    ident = lambda h, o: F.struct(h.alias("h"), o.alias("o"))
    if clashes.isEmpty():
        recipe = F.transform(chunked(F.col("_n")), lambda c: ident(chunk_hash(c), F.lit(0)))
        return base.select("doc_id", recipe.alias("recipe"), digest)
    ordinal = F.row_number().over(Window.partitionBy("_h").orderBy("_c"))
    ranked = dictionary.join(clashes, "_h", "left_semi").select("_h", F.col("_c"), ordinal.alias("_o"))
    rows = base.select("doc_id", digest, F.monotonically_increasing_id().alias("_row"), F.posexplode(chunked(F.col("_n"))).alias("_p", "_c"))
    rows = rows.withColumn("_h", chunk_hash(F.col("_c"))).join(ranked, ["_h", "_c"], "left")
    item = F.struct("_p", ident(F.col("_h"), F.coalesce("_o", F.lit(0))).alias("i"))
    listed = rows.groupBy("_row", "doc_id", "text_sha256").agg(F.sort_array(F.collect_list(item)).alias("_l"))
    return listed.select("doc_id", F.transform("_l", lambda x: x["i"]).alias("recipe"), "text_sha256")


def text_key(text: Column) -> Column:
    """What tells rows of one id apart: a hash of text_sha256."""
    return F.xxhash64(F.sha2(normalized(text), 256))


def exact_duplicates(docs: DataFrame, chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal to each other.  The smallest doc_id of equal
    texts stays; rows that repeat both id and text share that fate, and null ids
    count as the largest.  Other columns are ignored; no rows give no rows.
    """
    listed = materialize(recipes(docs, chunk_hash).withColumn("_key", F.concat_ws(",", F.transform("recipe", lambda i: F.concat_ws(":", F.hex(i["h"]), i["o"].cast("string"))))).drop("recipe"))
    groups = listed.groupBy("_key").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    out = attach_groups(listed, groups, "_key", "group_size", listed.count())
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
