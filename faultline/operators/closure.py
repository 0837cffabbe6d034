"""Reachability by semi-naive iteration."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..runtime import materialize


def closure(edges: DataFrame, roots: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(node): everything reachable from ``roots(node)`` over ``edges(src, dst)``.

    Each round joins only the last round's new nodes; cycles and diamonds end
    because reached nodes are anti-joined away.  The edges are partitioned by
    source once, and every round is checkpointed.
    """
    edges = edges.select("src", "dst").repartition("src").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        reached = frontier = materialize(roots.select("node").distinct())
        for _ in range(max_rounds):
            step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
            frontier = materialize(step.join(reached, "node", "left_anti"))
            if frontier.isEmpty():
                return reached
            reached = reached.unionByName(frontier)
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    finally:
        edges.unpersist()


#: Most rows that a round reaches, labels, and edges that are broadcast; all more than these go through shuffles.
BROADCAST_ROWS, BROADCAST_LABELS, FEW_EDGES = 100_000, 50_000, 1_000_000


def labelled_closure(edges: DataFrame, base: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(node, label): labels of ``base(node, label)`` carried over the edges, each row once.

    Labels are numbered, and 64 of them make a word: a row (node, word, bits)
    stands for up to 64 rows, and only such rows are shuffled and checkpointed.
    Edges to nodes that lead nowhere are peeled off, layer by layer, until few
    are left; the closure is that of the rest, and then each layer is crossed
    once, the last one first.  Few edges are followed in one task for each word.
    """
    names = materialize(base.select("label").distinct())
    count = names.count()
    ids = materialize(_numbered(names, count))
    words = ids.groupBy(F.shiftright("id", 6).alias("word")).agg(F.array_sort(F.collect_list(F.struct("id", "label"))).alias("ids")).select("word", F.col("ids.label").alias("labels"))
    if count <= BROADCAST_LABELS:
        ids, words = F.broadcast(ids), F.broadcast(words)
    bit = F.expr("shiftleft(1L, cast(id & 63 as int))").alias("bits")
    rows = base.withColumnRenamed("label", "_label").join(ids, F.col("_label").eqNullSafe(F.col("label"))).select("node", F.shiftright("id", 6).alias("word"), bit)
    rows = materialize(_united(rows))
    layers, rest, n = _peeled(edges)
    reached = _rounds(rest, rows, max_rounds) if n > FEW_EDGES else _followed(rest, rows) if n else rows
    for layer in reversed(layers):
        reached = reached.unionByName(materialize(_step(reached, layer)))
    ones = _united(reached).select("node", "word", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).where("getbit(bits, bit) = 1")
    return ones.join(words, "word").select("node", F.expr("labels[bit]").alias("label"))


def _numbered(names: DataFrame, count: int) -> DataFrame:
    """(label, id): ids without gaps but between partitions, which begin at multiples of 64."""
    parts = 1 + count // 2**20
    return names.repartitionByRange(parts, "label").sortWithinPartitions("label").select("label", F.monotonically_increasing_id().alias("id"))


def _peeled(edges: DataFrame) -> tuple[list[DataFrame], DataFrame, int]:
    """Layers of edges to nodes without further ones, the rest, and its size."""
    rest = materialize(edges.select("src", "dst").where("src is not null"))
    layers, n = [], rest.count()
    while n > FEW_EDGES // 10:
        sources = rest.select(F.col("src").alias("dst")).distinct()
        inner = materialize(rest.join(sources, "dst", "left_semi").select("src", "dst"))
        m = inner.count()
        if m > 0.9 * n:
            break
        layers.append(rest.join(sources, "dst", "left_anti").select("src", "dst"))
        rest, n = inner, m
    return layers, rest, n


def _united(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))


def _step(rows: DataFrame, edges: DataFrame) -> DataFrame:
    return _united(rows.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "word", "bits"))


def _followed(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with all that reaches their nodes, over few edges."""
    onward: dict = {}
    for src, dst in edges.collect():
        onward.setdefault(src, []).append(dst)
    ways = rows.sparkSession.sparkContext.broadcast(onward)
    schema = rows.schema

    def follow(table: pa.Table) -> pa.Table:
        node, word, bits = (table.column(c).to_pylist() for c in ("node", "word", "bits"))
        have = dict(zip(node, bits, strict=True))
        fresh, todo = dict(have), deque(have)
        while todo:
            src = todo.popleft()
            carried = fresh.pop(src)
            for dst in ways.value.get(src, ()):
                new = carried & ~have.get(dst, 0)
                if new:
                    have[dst] = have.get(dst, 0) | new
                    if dst not in fresh:
                        todo.append(dst)
                    fresh[dst] = fresh.get(dst, 0) | new
        kinds = [table.schema.field(c).type for c in ("node", "word", "bits")]
        columns = [list(have), [word[0]] * len(have), list(have.values())]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["node", "word", "bits"])

    sources = edges.select(F.col("src").alias("node")).distinct()
    core = rows.join(sources, "node", "left_semi").groupBy("word").applyInArrow(follow, schema)
    return rows.unionByName(materialize(core))


def _rounds(edges: DataFrame, rows: DataFrame, max_rounds: int) -> DataFrame:
    """``rows`` with all that reaches their nodes; each round carries the bits
    that the last one added, and compares with the nodes it meets only."""
    edges = edges.repartition("src").persist(StorageLevel.MEMORY_AND_DISK)
    sources = edges.select(F.col("src").alias("node")).distinct()
    try:
        reached, frontier = rows, materialize(rows.join(sources, "node", "left_semi"))
        for _ in range(max_rounds):
            step = materialize(_step(frontier, edges))
            had = reached
            if step.count() <= BROADCAST_ROWS:
                had = had.join(F.broadcast(step.select("node", "word")), ["node", "word"], "left_semi")
            had = _united(had).withColumnRenamed("bits", "had")
            new = step.join(had, ["node", "word"], "left").select("node", "word", F.expr("bits & ~coalesce(had, 0L)").alias("bits"))
            frontier = materialize(new.where("bits <> 0"))
            if frontier.isEmpty():
                return reached
            reached = reached.unionByName(frontier)
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    finally:
        edges.unpersist()
