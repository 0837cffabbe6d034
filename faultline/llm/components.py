"""Connected components by rounds of local closure, hooking and jumps.

Links become pointers from larger to smaller nodes.  Every partition closes over
its own links first, so a hub leaves it as one pointer for each node, to the
least that the partition knows.  Pointers then meet by their larger end: a node
with two pointers links their targets.  Nodes that point to one which points on
itself jump ahead; what they jump to is small, and goes by a join whose size is
checked.  Both are repeated until no node has two pointers and none can jump.
Pointers that are few enough, by count, are closed over by one task instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_groups, settled, width

#: Pointers that one task closes over, of 16 bytes each.
_ONE_TASK = 500_000
#: Jumps that may be broadcast; more of them go through a shuffle.
_BROADCAST_JUMPS = 500_000
_POINTERS = "u long, v long, twice boolean"


def closure(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links, and the least node that they connect it with."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        root = root[root]
        if (root == before).all():
            return nodes, nodes[root]


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pointers of a partition to their least nodes; whether any was double."""
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        u.append(batch.column(0).to_numpy())
        v.append(batch.column(1).to_numpy())
    pair = np.unique(np.stack([np.concatenate(u), np.concatenate(v)]), axis=1)
    twice = bool((pair[0][1:] == pair[0][:-1]).any())
    nodes, roots = closure(pair[0], pair[1])
    some = nodes != roots
    for s in range(0, int(some.sum()), 1 << 16):
        a, b = nodes[some][s : s + (1 << 16)], roots[some][s : s + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), twice))], ["u", "v", "twice"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; the root is the least node
    that can be reached.  Self-links and repeated links change nothing; nodes
    have no nulls.  Each round is checkpointed and no links reach the driver."""
    parts = width(links.sparkSession)
    pointers = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pointers = settled(pointers.mapInArrow(_closed, _POINTERS))
    few = pointers.count() <= _ONE_TASK
    if few:  # no exchange, and no rounds
        pointers = settled(pointers.select("u", "v").coalesce(1).mapInArrow(_closed, _POINTERS))
    while not few:
        pointers = settled(pointers.select("u", "v").repartition(parts, "u").mapInArrow(_closed, _POINTERS))
        double = not pointers.where("twice").isEmpty()
        while True:
            own = pointers.groupBy("u").agg(F.min("v").alias("v"))
            onward = own.select(F.col("u").alias("_from"), F.col("v").alias("_to"))
            jumps = pointers.groupBy("v").agg(F.count("*").alias("_k")).join(onward, F.col("v") == F.col("_from")).select("_from", "_to", "_k")
            jumps = settled(jumps)
            n = jumps.count()
            if not n:
                break
            if n <= _BROADCAST_JUMPS:
                ahead = pointers.join(F.broadcast(jumps), F.col("v") == F.col("_from"), "left")
            else:
                ahead = attach_groups(pointers, jumps.withColumnRenamed("_from", "v"), "v", "_k", pointers.count())
            pointers = settled(ahead.select("u", F.coalesce("_to", "v").alias("v"), "twice"))
            if double:
                break  # hook first
        if not double:
            break
    pairs = pointers.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.unionByName(pairs.select("root").distinct().select(F.col("root").alias("node"), "root"))
