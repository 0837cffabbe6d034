"""Checkpoints that survive lost executors."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def materialize(df: DataFrame) -> DataFrame:
    """Checkpoint into the folder the cluster names in spark.checkpoint.dir;
    a temporary folder only where that is unset.

    The result forgets the size estimates of the plan behind it: a checkpoint
    keeps them, each join multiplies them, and over many rounds they become
    numbers of very many digits.
    """
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(where or os.path.join(tempfile.gettempdir(), "faultline-checkpoints"))
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)
