"""A stream of symbol versions: what each batch changes and affects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.closure import closure


def watch(versions: DataFrame, edges: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``sink`` with (node) for every micro-batch of ``versions(id, old_hash,
    new_hash)``: the symbols that it changes, and what depends on them."""

    def each(batch: DataFrame, epoch: int) -> None:
        roots = batch.where(~F.col("old_hash").eqNullSafe(F.col("new_hash"))).select(F.col("id").alias("node"))
        sink(closure(edges, roots), epoch)

    return versions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
