"""What the operators share: table reading, checkpoints, shards, heavy keys."""

from __future__ import annotations

import ctypes
import os
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Shuffle files of a plan go when it ends; a checkpoint needs them no more.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Texts may be long: the bytes of an Arrow batch, unless the session has its own.
_BATCH_CONF, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def modest_batches(spark: SparkSession) -> None:
    """Bound the memory of a batch on its way to a Python worker and back."""
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, _BATCH_BYTES)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session.  Where it is unset, a
    temporary folder takes its place on a local master; on a cluster, whose
    machines don't share one, that is an error.
    """
    spark = df.sparkSession
    modest_batches(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
            where = os.path.join(tempfile.gettempdir(), "faultline-checkpoints")
        spark.sparkContext.setCheckpointDir(where)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        fresh = df.select("*")  # a plan that has not run yet, which sees the setting
    finally:
        spark.conf.set(_CLEANUP, before)
    return fresh.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint without the size estimates of the plan behind it.

    A checkpointed frame keeps these, and each join multiplies them: over the
    rounds of an iteration they become numbers of millions of digits.
    """
    spark, kept = df.sparkSession, materialize(df)._jdf
    fresh = spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False)
    out = DataFrame(fresh, spark)
    out.checkpoint_file = kept.queryExecution().analyzed().rdd().getCheckpointFile().get()
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a ``settled`` frame at once, when nothing will read it
    again; else they stay until the driver happens to collect its garbage."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df.checkpoint_file)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A map over batches after which the worker, which Spark may keep for other
    stages, gives the memory it used back to the system."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def width(spark: SparkSession) -> int:
    """The parallelism the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def slim(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra or clashing ones do no harm."""
    modest_batches(docs.sparkSession)
    return docs.select(*[docs[c] for c in columns])


def remainder(column: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id gives null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus))


def held_out(column: str | Column, modulus: int) -> Column:
    """Whether the id belongs to the held-out fold (a null id does not)."""
    return F.coalesce(remainder(column, modulus) == 0, F.lit(False))


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """Left join of ``rows`` with one row per key, safe when a key is very hot.

    ``groups`` has one row per key and, in ``size``, how many rows have it.
    Keys with more than a thousandth of all rows go by broadcast: there are at
    most 1000 of them, whatever the data.  All others go by a shuffled join, in
    which by then no key is large.
    """
    floor = max(64, n_rows // 1000)
    heavy = groups.where(F.col(size) > floor)
    light = groups.where(F.col(size) <= floor)
    payload = [c for c in groups.columns if c != key]
    a = rows.join(F.broadcast(heavy.withColumnRenamed(key, "_heavy")), F.col(key).eqNullSafe(F.col("_heavy")), "left")
    is_heavy = F.col(size).isNotNull()
    hot = a.where(is_heavy).drop("_heavy")
    cold = a.where(~is_heavy).drop("_heavy", *payload).join(light, key, "left").select(*hot.columns)
    return hot.unionByName(cold)


#: Most ids that may be broadcast; more of them go through a shuffle.
BROADCAST_IDS = 500_000


def without_rows(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """The rows of ``docs`` that are not among ``gone(doc_id, text_key)``, where
    ``key`` is the text_key of a row of ``docs``.  A null id is an id like any
    other; rows that share an id are told apart by their keys.  ``gone`` is
    broadcast only if it is small, by count."""
    mark = next(n for i in range(len(docs.columns) + 1) if f"{(n := f'_gone{i}')}_id" not in docs.columns and f"{n}_key" not in docs.columns)
    gone = materialize(gone.select(F.col("doc_id").alias(f"{mark}_id"), F.col("text_key").alias(f"{mark}_key")).distinct())
    few = gone.count() <= BROADCAST_IDS
    same = docs["doc_id"].eqNullSafe(gone[f"{mark}_id"]) & (key == gone[f"{mark}_key"])
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
