"""Benchmark decontamination by winnowing, in Spark expressions only.

Of every window of consecutive k-gram hashes the least is kept, for documents
and benchmark items alike; so a shared span of ``span`` words always shares a
kept k-gram.  The kept k-grams are joined, each match fixes an alignment of a
document with an item, and along it the words themselves are compared: only
spans that really occur count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a benchmark-sized table that may be broadcast; beyond it, a shuffle.
BROADCAST_ROWS = 200_000
_POSITION_BITS = 31
#: Bits (as a power of two) of the bitmap of the items' fingerprints.
_LEAST_BITS, _MOST_BITS = 12, 20


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    only_ascii = F.length(text) == F.octet_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _grams(df: DataFrame, k: int) -> DataFrame:
    """Adds _h: per position the k-gram's 32-bit hash, then the position."""
    w = F.col("_w")

    def one(i: Column) -> Column:
        mixed = F.xxhash64(*[F.get(w, i + j) for j in range(k)]).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.shiftleft(mixed, _POSITION_BITS).bitwiseOR(i.cast("long"))

    none = F.array().cast("array<bigint>")
    return df.withColumn("_h", F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), one)).otherwise(none))


def _least_with(array: str, step: int):
    return lambda x, i: F.least(x, F.get(F.col(array), i + step))


def _winnow(df: DataFrame, span: int, k: int) -> DataFrame:
    """Adds _f: the winnowed values of _h, each once."""
    need, have, name = span - k + 1, 1, "_h"
    while have < need:
        step = min(have, need - have)
        df = df.withColumn(f"_m{have}", F.transform(name, _least_with(name, step)))
        name, have = f"_m{have}", have + step
    m = F.col(name)
    full = F.slice(m, 1, F.greatest(F.size(m) - need + 1, F.lit(0)))
    df = df.withColumn("_full", full)
    return df.withColumn("_f", F.filter("_full", lambda x, i: (i == 0) | (x != F.get(F.col("_full"), i - 1))))


def _exploded(df: DataFrame, array: str, keep: list[str]) -> DataFrame:
    # the outer form keeps the optimizer from copying the array's expression into a filter below
    rows = df.select(*keep, F.explode_outer(array).alias("_v")).where("_v is not null")
    mask = (1 << _POSITION_BITS) - 1
    return rows.select(*keep, F.shiftright("_v", _POSITION_BITS).alias("_fp"), F.col("_v").bitwiseAND(F.lit(mask)).cast("int").alias("_at"))


def _join_small(big: DataFrame, small: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """Broadcast ``small`` only if its checked row count allows it."""
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)


def _item_prints(items: DataFrame, lengths: list[int], span: int, k: int) -> DataFrame:
    """(_ik, _n, _span, _fp, _its): of items shorter than ``span`` their one gram,
    of others the winnowed k-grams."""
    parts = [_exploded(_winnow(_grams(items.where(F.col("_n") >= span), k), span, k), "_f", ["_ik", "_n"]).withColumn("_span", F.lit(span))]
    for n in lengths:
        parts.append(_exploded(_grams(items.where(F.col("_n") == n), n), "_h", ["_ik", "_n"]).withColumn("_span", F.lit(n)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("_ik", "_n", "_span", "_fp", F.col("_at").alias("_its"))


def _bitmap(prints: DataFrame) -> tuple[Column, int]:
    """Which low bits the items' fingerprints have, as words of 64 bits, and how
    many bits these are: a bound on what reaches the driver, whatever the items."""
    n = prints.count()
    bits = min(_MOST_BITS, max(_LEAST_BITS, (16 * n).bit_length()))
    low = F.col("_fp").bitwiseAND(F.lit((1 << bits) - 1))
    rows = prints.groupBy(F.shiftright(low, 6).alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(F.lit(63)).cast("int"))).alias("w")).collect()
    words = [0] * (1 << bits - 6)
    for i, w in rows:
        words[i] = w
    return F.split(F.lit(" ".join(map(str, words))), " ").cast("array<bigint>"), bits


def _scanned(docs: DataFrame, lengths: list[int], span: int, k: int, bitmap: Column, bits: int) -> DataFrame:
    """doc_id, _th, n_words, _hits: one pass over the texts, which keeps of their
    fingerprints only those whose low bits an item has."""

    def some(array: str, n: int) -> Column:
        def known(v: Column) -> Column:
            low = F.shiftright(v, _POSITION_BITS).bitwiseAND(F.lit((1 << bits) - 1))
            return F.getbit(F.get(bitmap, F.shiftright(low, 6).cast("int")), low.bitwiseAND(F.lit(63)).cast("int")) == 1

        return F.transform(F.filter(array, known), lambda v: F.struct(F.lit(n).alias("_span"), v.alias("_v")))

    found = []
    for n in lengths:
        docs = _grams(docs, n).withColumn(f"_s{n}", some("_h", n)).drop("_h")
        found.append(f"_s{n}")
    docs = _winnow(_grams(docs, k), span, k).withColumn(f"_s{span}", some("_f", span))
    return docs.select("doc_id", "_th", F.size("_w").cast("long").alias("n_words"), F.concat(*found, f"_s{span}").alias("_hits"))


def _aligned(scanned: DataFrame, prints: DataFrame) -> DataFrame:
    """Distinct (doc_id, _th, _ik, _n, _diag) that share a fingerprint."""
    hits = scanned.where(F.size("_hits") > 0).select("doc_id", "_th", F.explode("_hits").alias("_x")).select("doc_id", "_th", "_x.*")
    mask = (1 << _POSITION_BITS) - 1
    hits = hits.select("doc_id", "_th", "_span", F.shiftright("_v", _POSITION_BITS).alias("_fp"), F.col("_v").bitwiseAND(F.lit(mask)).cast("int").alias("_at"))
    both = _join_small(hits, prints, ["_span", "_fp"])
    return both.select("doc_id", "_th", "_ik", "_n", (F.col("_at") - F.col("_its")).alias("_diag")).distinct()


def text_key(text: Column) -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64(text)


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 5, keyed: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, spans (array of hit runs: start, end in words), items.

    A null text has no words; items without words can't be hit, items shorter
    than ``span`` words must occur whole.  Repeated rows each get their result;
    no rows give no rows; an empty benchmark hits nothing; other columns are
    ignored.  Ids may be null (a null item_id hits, but isn't listed).  If
    ``keyed``, text_key is the row's ``text_key(text)``.
    """
    base = docs.select(docs["doc_id"], docs["text"]).withColumn("_th", text_key(F.col("text")))
    worded = base.select("doc_id", "_th", words_of(F.col("text")).alias("_w"))
    key = F.sha2(F.concat_ws("\u0000", F.col("item_id").cast("string"), F.col("text")), 256)
    items = benchmark.select(benchmark["item_id"], benchmark["text"]).select(key.alias("_ik"), "item_id", words_of(F.col("text")).alias("_w"))
    items = items.dropDuplicates(["_ik"]).withColumn("_n", F.size("_w")).where("_n > 0")
    items = materialize(items)
    lengths = sorted(r[0] for r in items.where(F.col("_n") < span).select("_n").distinct().collect())  # at most span - 1 numbers
    prints = materialize(_item_prints(items, lengths, span, k))
    scanned = materialize(_scanned(worded, lengths, span, k, *_bitmap(prints)))
    aligned = materialize(_aligned(scanned, prints))
    per_doc = aligned.groupBy("doc_id", "_th").agg(F.collect_list(F.struct("_ik", "_n", "_diag")).alias("_al"))
    ids = per_doc.select(F.col("doc_id").alias("_id"), F.col("_th").alias("_t"), "_al")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th").eqNullSafe(F.col("_t")))
    small = aligned.count() <= BROADCAST_ROWS
    found = base.join(F.broadcast(ids) if small else ids, same).dropDuplicates(["doc_id", "_th"])
    found = found.select("doc_id", "_th", words_of(F.col("text")).alias("_dw"), "_al")
    cut = lambda a: F.struct(
        a["_ik"].alias("_ik"), a["_diag"].alias("_diag"), F.greatest(a["_diag"], F.lit(0)).alias("_from"),
        F.slice(F.col("_dw"), F.greatest(a["_diag"], F.lit(0)) + 1, F.least(a["_n"], a["_n"] + a["_diag"])).alias("_part"),
    )
    lines = found.select("doc_id", "_th", F.explode_outer(F.transform("_al", cut)).alias("_a")).select("doc_id", "_th", "_a.*")
    lines = _join_small(lines, items, "_ik")
    theirs = F.slice("_w", F.col("_from") - F.col("_diag") + 1, F.size("_part"))
    lines = lines.withColumn("_eq", F.zip_with("_part", theirs, lambda x, y: F.coalesce(x == y, F.lit(False))))
    length = F.least(F.col("_n"), F.lit(span))
    at = F.filter(
        F.sequence(F.lit(0), F.size("_eq") - length),
        lambda i: F.forall(F.slice(F.col("_eq"), i + 1, length), lambda b: b),
    )
    starts = lines.where(F.size("_eq") >= length).select("doc_id", "_th", "item_id", length.alias("_len"), "_from", F.explode_outer(at).alias("_i")).where("_i is not null")
    hits = starts.select("doc_id", "_th", "item_id", (F.col("_from") + F.col("_i")).alias("_s"), (F.col("_from") + F.col("_i") + F.col("_len")).alias("_e"))
    hits = materialize(hits)
    order = Window.partitionBy("doc_id", "_th").orderBy("_s", "_e")
    reach = F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.select("doc_id", "_th", "_s", "_e").distinct().withColumn("_reach", reach)
    runs = runs.withColumn("_run", F.sum(F.when(F.col("_reach") >= F.col("_s"), 0).otherwise(1)).over(order))
    runs = runs.groupBy("doc_id", "_th", "_run").agg(F.min("_s").alias("start"), F.max("_e").alias("end"))
    runs = runs.groupBy("doc_id", "_th").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    named = hits.groupBy("doc_id", "_th").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    done = runs.join(named, ["doc_id", "_th"]) if hits.where("doc_id is null").isEmpty() else runs.join(named.select(F.col("doc_id").alias("_d"), F.col("_th").alias("_u"), "items"), F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("_th").eqNullSafe(F.col("_u"))).drop("_d", "_u")
    done = done.select(F.col("doc_id").alias("_id"), F.col("_th").alias("_t"), "n_hit", "spans", "items")
    counted = scanned.select("doc_id", "_th", "n_words")
    out = counted.join(F.broadcast(done) if small else done, same, "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce(F.col("n_hit").cast("long"), F.lit(0).cast("long")).alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        *[F.col("_th").alias("text_key")] * keyed,
    )
