"""N-gram Jaccard join with grouped prefixes.

Texts become sets of word shingles.  A common order puts shingles that are rare
(by a bounded count sketch over all texts) first; two sets that are similar
enough share a shingle of their prefixes in that order.  Texts with the same
prefix and size form one group, and only groups enter the posting lists.

No list emits all of its pairs.  Members are tested against their group's
leader, and each group against one pivot of the lists it shares; what is linked
joins the ball of that centre.  Pairs of centres that share a list, with the
shingle so early in both that what follows can be enough, are tested.
The Jaccard distance is a metric, so two balls whose centres are further apart
than the radii allow hold no link and are never expanded; others are expanded
and their members verified.  Pairs that are connected already need no test, nor
do centres that differ too much by their parities: of each of 1024 cells a text
keeps whether its number of shingles there is odd, and two texts differ in at
least as many shingles as in cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks, repeats
from .common import attach_groups, discard, give_back, released, settled, width
from .components import components

#: Counters of the sketch that orders shingles.
SKETCH_BITS = 20
#: Slices of the sketch, and how many tasks' counts of one are summed at once.
_SLICES, _TASKS_A_SUM = 64, 256
#: Cells of the parities of a text, as 64-bit words, and their columns.
PARITY_WORDS = 16
PARITY = [f"p{i}" for i in range(PARITY_WORDS)]
#: Pairs (or ids) that may be broadcast, of some ten bytes each.
BROADCAST_PAIRS = 2_000_000
#: Pairs that one task compares, about.
_PAIRS_A_TASK = 4096
#: A text with more pairs than this may go to several tasks.
_LEAST_SHARE = 16
#: Texts are handled so many bytes at a time.
_SLICE_BYTES = 2 << 20
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of every distinct shingle, sorted by both."""
    values, counts = blocks.word_hashes([t.translate(_LOWER) for t in texts])
    owner = np.repeat(np.arange(len(texts)), counts)
    ends = np.cumsum(counts)
    grams = blocks.window_hashes(values, n)
    own = owner[: len(grams)]
    ok = np.arange(len(grams)) + n <= ends[own] if len(grams) else np.zeros(0, bool)
    o, g = [own[ok]], [grams[ok]]
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        few = values[ends[i] - counts[i] : ends[i]]
        o.append(np.array([i]))
        g.append(blocks.scramble(blocks.window_hashes(few, len(few)) + np.uint64(len(few))))
    o, g = np.concatenate(o), np.concatenate(g)
    order = np.lexsort((g, o))
    o, g = o[order], g[order]
    new = np.append(True, (o[1:] != o[:-1]) | (g[1:] != g[:-1]))[: len(o)]
    return o[new], g[new]


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[bytes]]]:
    ids, texts, size = [], [], 0
    for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        raw = text.as_py().encode()
        ids.append(i)
        texts.append(raw)
        size += len(raw)
        if size >= _SLICE_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _unpacked(ids: pa.ChunkedArray, raw: pa.ChunkedArray) -> Iterator[tuple[list[int], list[bytes]]]:
    """Ids and decompressed texts, some MB at a time."""
    unpack, keys, texts, size = zstandard.ZstdDecompressor(), [], [], 0
    for i, blob in zip(ids.to_pylist(), raw, strict=True):
        keys.append(i)
        texts.append(unpack.decompress(blob.as_py()))
        size += len(texts[-1])
        if size >= _SLICE_BYTES:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def _sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    owner, token = shingle_sets(texts, n)
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [token[s:e] for s, e in zip(cut[:-1], cut[1:], strict=True)]


def _sketch(rows: DataFrame, n: int) -> np.ndarray:
    """The logarithm of how many texts have a shingle of each cell, summed by
    slices of cells and, in each, some hundred tasks at a time."""

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, texts in _slices(batch):
                np.add.at(total, _cells(shingle_sets(texts, n)[1]), 1)
        lane = TaskContext.get().partitionId() // _TASKS_A_SUM
        blobs = [_planes(p) for p in np.array_split(total, _SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([lane] * _SLICES, pa.int32()), pa.array(blobs, pa.binary())], ["slice", "lane", "blob"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(_counts(b.as_py()) for b in table.column("blob"))
        return pa.Table.from_arrays([table.column("slice")[:1], pa.array([_planes(total)], pa.binary())], ["slice", "blob"])

    sums = rows.select("_tid", "text").mapInArrow(count, "slice int, lane int, blob binary")
    for keys in (["slice", "lane"], ["slice"]):  # a sum takes so many tasks, or so many sums
        sums = sums.groupBy(*keys).applyInArrow(add, "slice int, blob binary")
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for (i, blob), cells in ((r, np.array_split(total, _SLICES)[r[0]]) for r in sums.collect()):  # 2^SKETCH_BITS numbers in all
        cells[:] = _counts(blob)
    level = np.zeros(len(total), np.uint8)
    level[total > 0] = np.floor(np.log2(total[total > 0])).astype(np.uint8)
    return level


def _planes(counts: np.ndarray) -> bytes:
    """Byte plane by byte plane, so that the shuffle's compression removes the empty ones."""
    return counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel().astype(np.int64)


def parities(owner: np.ndarray, token: np.ndarray, texts: int) -> np.ndarray:
    """Of each text, which cells have an odd number of its shingles."""
    bits = np.zeros(texts * PARITY_WORDS, np.uint64)
    cell = (token >> np.uint64(16)) % np.uint64(64 * PARITY_WORDS)
    np.bitwise_xor.at(bits, owner * PARITY_WORDS + (cell >> np.uint64(6)).astype(np.int64), np.uint64(1) << (cell & np.uint64(63)))
    return bits.reshape(-1, PARITY_WORDS)


def _prefixes(texts: list[bytes], n: int, percent: int, level: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sizes, parities and group keys of the texts; owners, tokens and places (in
    256ths of the prefix) of the prefixes."""
    owner, token = shingle_sets(texts, n)
    parity = parities(owner, token, len(texts))
    size = np.bincount(owner, minlength=len(texts))
    order = np.lexsort((token, level[_cells(token)], owner))
    owner, token = owner[order], token[order]
    start = np.cumsum(size) - size
    need = (percent * size + 99) // 100
    keep = np.arange(len(owner)) - start[owner] < (size - need + 1)[owner]
    owner, token = owner[keep], token[keep]
    per = np.bincount(owner, minlength=len(texts))
    at = np.cumsum(per) - per
    place = (np.arange(len(owner)) - at[owner]).astype(np.uint64)
    mixed = blocks.scramble(token + place * np.uint64(0x9E3779B97F4A7C15))
    group = np.zeros(len(texts), np.uint64)
    np.add.at(group, owner, mixed)
    group = blocks.scramble(group + size.astype(np.uint64))
    return size, parity, group.view(np.int64), owner, token, (place * np.uint64(256) // per[owner].astype(np.uint64)).astype(np.uint8)


class _Join:
    def __init__(self, docs: DataFrame, n: int, percent: int) -> None:
        self.n, self.percent, self.limit = n, percent, 1 - percent / 100
        self.buckets, self.parts = repeats.sizes(docs)
        self.rows = repeats.prepared(docs, self.buckets)
        self.single = self.rows.where(F.col("_rep").isNull() | (F.col("_rep") == F.col("_d")))

    def index(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """members(text, gid, n), parities of texts, and postings(token, gid, n, left) of
        shared tokens; at most ``left`` shingles follow from the token on, itself included."""
        n, percent, parts = self.n, self.percent, self.parts
        level = self.single.sparkSession.sparkContext.broadcast(_sketch(self.single, n))
        names = ["part", "gid", "size", "times", "keys", "places", "text"]
        types = [pa.int32(), *[pa.binary()] * 6]

        @released
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, texts in _slices(batch):
                    size, parity, gid, owner, token, place = _prefixes(texts, n, percent, level.value)
                    some = size > 0
                    out = [(-1, gid[some].tobytes(), size[some].astype("<u4").tobytes(), None, None, parity[some].tobytes(), np.array(ids, np.int64)[some].tobytes())]
                    part, key = repeats._stored(token, parts)
                    order = np.lexsort((owner, part))
                    part, key, owner, place = part[order], key[order], owner[order], place[order]
                    cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [len(part)]
                    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                        own, times = np.unique(owner[s:e], return_counts=True)
                        out.append((int(part[s]), gid[own].tobytes(), size[own].astype("<u4").tobytes(), times.astype("<u4").tobytes(), repeats._pack_keys(key[s:e]), place[s:e].tobytes(), None))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        def shared(table: pa.Table) -> pa.Table:
            part = table.column("part")[0].as_py()
            key, gid, size, place = [], [], [], []
            for g, s, t, k, p in zip(*(table.column(c).to_pylist() for c in ("gid", "size", "times", "keys", "places")), strict=True):
                times = np.frombuffer(t, "<u4")
                gid.append(np.repeat(np.frombuffer(g, np.int64), times))
                size.append(np.repeat(np.frombuffer(s, "<u4"), times))
                key.append(repeats._unpack_keys(k))
                place.append(np.frombuffer(p, np.uint8))
            key, gid, size, place = np.concatenate(key), np.concatenate(gid), np.concatenate(size), np.concatenate(place)
            order = np.lexsort((place, gid, key))
            key, gid, size, place = key[order], gid[order], size[order], place[order]
            new = np.append(True, (key[1:] != key[:-1]) | (gid[1:] != gid[:-1]))
            key, gid, size, place = key[new], gid[new], size[new].astype(np.int64), place[new].astype(np.int64)
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            times = np.diff(np.append(first, len(key)))
            many = np.repeat(times > 1, times)
            prefix = size - (percent * size + 99) // 100 + 1
            left = size - (place * prefix + 255) // 256
            token = (key * np.uint64(parts) + np.uint64(part)).astype(np.int64)
            return pa.Table.from_arrays([pa.array(token[many]), pa.array(gid[many]), pa.array(size[many].astype(np.int32)), pa.array(left[many].astype(np.int32))], ["token", "gid", "n", "left"])

        def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for g, s, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(t, np.int64)), pa.array(np.frombuffer(g, np.int64)), pa.array(np.frombuffer(s, "<u4").astype(np.int32))], ["text", "gid", "n"])

        def odd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for t, p in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                    cells = np.frombuffer(p, np.int64).reshape(-1, PARITY_WORDS).T.copy()
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(t, np.int64)), *[pa.array(c) for c in cells]], ["text", *PARITY])

        sent = settled(self.single.select("_tid", "text").mapInArrow(send, "part int, gid binary, size binary, times binary, keys binary, places binary, text binary"))
        members = settled(sent.where("part = -1").select("gid", "size", "text").mapInArrow(unfold, "text long, gid long, n int").distinct())
        postings = settled(sent.where("part >= 0").groupBy("part").applyInArrow(shared, "token long, gid long, n int, left int"))
        level.destroy()  # all that needs it is checkpointed
        marks = settled(sent.where("part = -1").select("text", F.col("places").alias("_p")).mapInArrow(odd, "text long, " + ", ".join(f"{c} long" for c in PARITY)))
        discard(sent)
        return members, marks, postings

    def stored(self, candidates: DataFrame) -> DataFrame:
        """text, raw (compressed whole text) of the candidate texts.

        A compressed text is a third of the hashes of its shingles, and each
        test moves what it compares.
        """

        def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pack = zstandard.ZstdCompressor()
            for batch in batches:
                raw = [pack.compress(t.as_py().encode()) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["text", "raw"])

        # of the rows that share a text, the one with the least id has it; only ids
        # that repeat with their text need the texts themselves compared
        least = self.single.groupBy("_tid").agg(F.min("_d").alias("_least")).withColumnRenamed("_tid", "text")
        wanted = settled(candidates.join(least, "text").select(F.col("text").alias("_c"), "_least"))
        n = wanted.count()
        small = F.broadcast if n <= BROADCAST_PAIRS else lambda df: df
        some = self.single.select("_tid", "_d", "text").join(small(wanted), (F.col("_tid") == F.col("_c")) & (F.col("_d") == F.col("_least")), "left_semi")
        out = settled(some.select("_tid", "text").mapInArrow(squeeze, "text long, raw binary"))
        return out if out.count() == n else settled(out.dropDuplicates(["text"]))

    def tested(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """(a, b, linked, d) for distinct pairs; a may be in very many.

        An a goes to as many lanes as its pairs need, to one if they are few;
        so no lane has many more pairs than others, and few texts go twice.
        """
        n, percent = self.n, self.percent
        pairs = settled(pairs.select("a", "b").distinct())
        count = pairs.count()
        lanes = max(4 * width(pairs.sparkSession), count // _PAIRS_A_TASK)
        share = max(_LEAST_SHARE, count // (4 * lanes))
        small = F.broadcast if count <= BROADCAST_PAIRS else lambda df: df  # beyond it, the texts are shuffled
        degrees = pairs.groupBy("a").agg(F.count("*").alias("_k"))
        slot = F.pmod(F.xxhash64("b"), F.ceil(F.col("_k") / share))  # one of an a with few pairs
        lane = F.pmod(F.xxhash64("a", slot), F.lit(lanes)).cast("int")
        pairs = settled(attach_groups(pairs, degrees, "a", "_k", count).select("a", "b", lane.alias("lane")))
        # a text goes to a lane once, however many pairs it has there
        theirs = texts.withColumnRenamed("text", "b").join(small(pairs.select("b", "lane").distinct()), "b")
        pivots = texts.withColumnRenamed("text", "a").join(small(pairs.groupBy("a", "lane").agg(F.collect_list("b").alias("near"))), "a")
        # columns of their own, as both sides stem from the same tables
        pivots = pivots.select(*[F.col(c).alias(c) for c in pivots.columns])
        shape = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_()), ("d", pa.float64())])

        def verify(table: pa.Table, known: pa.Table) -> pa.Table:
            own: dict[int, np.ndarray] = {}
            for ids, part in _unpacked(known.column("a"), known.column("raw")):
                own.update(zip(ids, _sets(part, n), strict=True))
            pivots_of: dict[int, list[int]] = {}
            for i, near in zip(known.column("a").to_pylist(), known.column("near").to_pylist(), strict=True):
                for j in near:
                    pivots_of.setdefault(j, []).append(i)
            a, b, linked, d = [], [], [], []
            for ids, part in _unpacked(table.column("b"), table.column("raw")):
                for j, y in zip(ids, _sets(part, n), strict=True):
                    for i in pivots_of[j]:
                        both = int(blocks.in_sorted(y, own[i])[1].sum())
                        either = len(own[i]) + len(y) - both
                        a.append(i)
                        b.append(j)
                        linked.append(either > 0 and 100 * both >= percent * either)
                        d.append(1 - both / max(either, 1))
            own = {}
            give_back()
            return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_()), pa.array(d, pa.float64())], schema=shape)

        return settled(theirs.groupBy("lane").cogroup(pivots.groupBy("lane")).applyInArrow(verify, "a long, b long, linked boolean, d double"))

    def near(self, x: str, y: str):
        return F.lit(100) * F.least(x, y) >= F.lit(self.percent) * F.greatest(x, y)

    def links(self, members: DataFrame, marks: DataFrame, postings: DataFrame) -> DataFrame:
        """(a, b) links that connect what all links connect (the links found in a
        step may go on as pointers to the least node of what they connect)."""
        total = max(1, members.count())
        groups = settled(members.groupBy("gid").agg(F.min("text").alias("leader"), F.count("*").alias("_k")))
        alike = groups.where("_k > 1").select("gid")
        wanted = postings.select("gid").distinct().unionByName(alike).distinct()
        candidates = settled(members.join(wanted, "gid", "left_semi").select("text"))
        texts = self.stored(candidates)

        led = attach_groups(members, groups, "gid", "_k", total)
        zero = self.tested(led.where("text <> leader").select(F.col("leader").alias("a"), F.col("text").alias("b")), texts)
        inside = zero.where("linked").select(F.col("b").alias("text"), F.col("a").alias("unit"), F.col("d").alias("d0"))
        apart = zero.where("not linked").select(F.col("b").alias("text"))
        units = members.join(groups.select(F.col("leader").alias("text")).unionByName(apart), "text", "left_semi").select(F.col("text").alias("unit"), "gid", "n")
        lists = settled(postings.select("token", "gid", "left").join(units, "gid").select("token", "unit", "n", "left").unionByName(
            units.join(alike, "gid", "left_semi").select(F.col("gid").alias("token"), "unit", "n", F.col("n").alias("left"))))
        discard(postings)

        # the pivot has the shingle earliest: of copies with changes, which give
        # rare shingles, the one with the fewest
        rank = F.struct((F.col("n") - F.col("left")).alias("p"), F.col("unit").alias("pivot"), F.col("n").alias("pn"))
        tops = lists.groupBy("token").agg(F.min(rank).alias("_p"), F.count("*").alias("_k"))
        with_pivot = attach_groups(lists, tops, "token", "_k", max(1, lists.count())).select("unit", "n", "_p.pivot", "_p.pn")
        shared = with_pivot.where((F.col("unit") != F.col("pivot")) & self.near("n", "pn")).groupBy("unit", "pivot").agg(F.count("*").alias("c"))
        best = shared.groupBy("unit").agg(F.max(F.struct("c", "pivot"))["pivot"].alias("pivot"))
        one = self.tested(best.select(F.col("pivot").alias("a"), F.col("unit").alias("b")), texts)
        close = one.where("linked").select(F.col("b").alias("unit"), F.col("a").alias("center"), F.col("d").alias("d1"))

        all_units = units.join(close, "unit", "left").select("unit", "n", F.coalesce("center", "unit").alias("center"), F.coalesce("d1", F.lit(0.0)).alias("d1"))
        reach = inside.groupBy("unit").agg(F.max("d0").alias("r0"))
        all_units = settled(all_units.join(reach, "unit", "left").withColumn("r0", F.coalesce("r0", F.lit(0.0))))
        radius = all_units.groupBy("center").agg(F.max(F.col("d1") + F.col("r0")).alias("radius"), F.min("n").alias("lo"))
        size = units.select(F.col("unit").alias("center"), F.col("n").alias("cn"))
        odd = marks.withColumnRenamed("text", "center").dropDuplicates(["center"])
        balls = settled(radius.join(size, "center").join(odd, "center"))
        found = zero.where("linked").select("a", "b").unionByName(one.where("linked").select("a", "b"))
        roots = settled(components(found))
        known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))  # stands for the links so far

        def root(df: DataFrame, column: str, roots: DataFrame = roots) -> DataFrame:
            own = roots.select(F.col("node").alias(column), F.col("root").alias(f"_{column}"))
            return df.join(own, column, "left").withColumn(f"_{column}", F.coalesce(f"_{column}", column))

        # what a list needs to know of a unit goes along with it in one join
        own = root(all_units.select("unit", "center").join(radius.select("center", "lo"), "center"), "center")
        held = lists.select("token", "unit", "left").join(own, "unit").groupBy("token", "center", "_center", "lo").agg(F.max("left").alias("left"))
        spread = settled(held)
        # of what links, the first common shingle is early enough in both texts
        percent = self.percent
        mixed = spread.groupBy("token").agg(F.min("_center").alias("x"), F.max("_center").alias("y"), F.min("lo").alias("_lo")).where("x <> y").select("token", "_lo")
        held = spread.join(mixed, "token").where((100 + percent) * F.col("left") >= percent * (F.col("lo") + F.col("_lo"))).drop("_lo")
        held = settled(held.join(balls.drop("lo"), "center"))
        discard(spread)
        facts = ("radius", "cn", "lo", "left", *PARITY)
        left, right = (held.select("token", F.col("center").alias(c), F.col("_center").alias(f"_{c}"), *[F.col(x).alias(f"{c}_{x}") for x in facts]) for c in "ab")
        pairs = left.join(right, "token").where((F.col("a") < F.col("b")) & (F.col("_a") != F.col("_b")))
        pairs = pairs.where((100 + percent) * F.least("a_left", "b_left") >= percent * (F.col("a_lo") + F.col("b_lo")))
        pairs = pairs.withColumnsRenamed({"a_radius": "ar", "b_radius": "br"})
        slack = F.lit(self.limit + 1e-9) + F.col("ar") + F.col("br")
        pairs = pairs.where(1 - F.least("a_cn", "b_cn") / F.greatest("a_cn", "b_cn") <= slack)
        # they differ in so many shingles at least; of a and b together, a_cn + b_cn and these are twice the union
        differ = sum((F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in PARITY), F.lit(0))
        pairs = pairs.where(F.lit(2) * differ <= slack * (F.col("a_cn") + F.col("b_cn") + differ)).select("a", "b", "ar", "br").distinct()
        pairs = settled(pairs)
        two = self.tested(pairs, texts)
        found = known.unionByName(two.where("linked").select("a", "b"))
        doubt = settled(two.where("not linked").join(pairs, ["a", "b"]).where(F.col("d") <= slack).select("a", "b", "d"))
        if doubt.isEmpty():
            return found
        roots = settled(components(found))
        found = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        doubt = settled(root(root(doubt, "a", roots), "b", roots).where("_a <> _b").select("a", "b", "d"))
        return self.expanded(doubt, found, all_units, inside, members, texts, lists, held)

    def expanded(self, doubt: DataFrame, found: DataFrame, units: DataFrame, inside: DataFrame, members: DataFrame, texts: DataFrame, lists: DataFrame, held: DataFrame) -> DataFrame:
        """``found`` and links between the members of balls whose centres don't exclude
        them; of each ball only members with a shingle that the other has, both early."""
        own = units.select("unit", "center", "d1")
        ball = own.select(F.col("unit").alias("text"), "unit", "center", F.col("d1").alias("delta")).unionByName(
            inside.join(own, "unit").select("text", "unit", "center", (F.col("d0") + F.col("d1")).alias("delta"))
        )
        ball = ball.join(members.select("text", "n"), "text")
        ends = doubt.select("a", "b", "d").unionByName(doubt.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
        ball = settled(ball.join(ends.select(F.col("a").alias("center")).distinct(), "center", "left_semi"))
        room = F.lit(self.limit + 1e-9)
        # the members against the other centre
        theirs = ends.join(held.select(F.col("center").alias("b"), "token", F.col("left").alias("bl"), F.col("lo").alias("bn")), "b").select("a", "b", "token", "bl", "bn")
        ours = lists.join(own.select("unit", F.col("center").alias("a")), "unit").join(ends.select("a").distinct(), "a", "left_semi").select("a", "token", "unit", "left", "n")
        early = theirs.join(ours, ["a", "token"]).where((100 + self.percent) * F.least("left", "bl") >= self.percent * (F.col("n") + F.col("bn")))
        cross = early.select("unit", "b").distinct().join(ball.select("unit", "text"), "unit")
        three = self.tested(cross.where("text <> b").select(F.col("b").alias("a"), F.col("text").alias("b")), texts)
        more = three.where("linked").select("a", "b")
        roots = settled(components(found.unionByName(more)))
        found = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        label = lambda df, c: df.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")), c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", c))
        still = label(label(doubt, "a"), "b").where("_a <> _b").select("a", "b")
        x = ball.select(F.col("center").alias("a"), F.col("text").alias("x"), F.col("n").alias("xn"))
        far = three.select(F.col("a").alias("b"), F.col("b").alias("x"), F.col("d").alias("dx"))
        x = still.join(x, "a").join(far, ["b", "x"])
        y = ball.select(F.col("center").alias("b"), F.col("text").alias("y"), F.col("n").alias("yn"), F.col("delta").alias("dy"))
        y = y.join(far.select(F.col("b").alias("a"), F.col("x").alias("y")), "y")
        pairs = x.join(y, ["a", "b"]).where(self.near("xn", "yn") & (F.col("dx") - F.col("dy") <= room) & (F.col("x") != F.col("y")))
        pairs = label(label(pairs.select("x", "y").distinct(), "x"), "y").where("_x <> _y")
        four = self.tested(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")), texts)
        return found.unionByName(four.where("linked").select("a", "b"))


def text_key(text: Column) -> Column:
    """What tells rows of one id apart: the identifier of a text in the join."""
    return F.xxhash64(F.sha2(F.coalesce(text, F.lit("")), 256))


def similar_components(docs: DataFrame, n: int = 4, percent: int = 85, keyed: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Two documents link when 100 * intersection >= ``percent`` * union of their
    sets of distinct ``n``-word shingles (A-Z lower-cased; a text of fewer words
    is one shingle).  Null texts and texts without words have no shingles and no
    links.  ``component_id`` is the smallest doc_id reachable by links; a null
    id counts as the largest.  Repeated rows stay; other columns are ignored; no
    rows give no rows.  If ``keyed``, text_key is the row's ``text_key(text)``.
    """
    join = _Join(docs, n, percent)
    members, marks, postings = join.index()
    links = join.links(members, marks, postings)
    roots = components(links)
    rows = settled(join.rows.select("_d", "_null", "_tid"))
    texts = rows.groupBy("_tid").agg(F.min("_d").alias("_least"), F.count("*").alias("_k"))
    placed = texts.join(members.select(F.col("text").alias("_tid"), F.col("n").cast("long").alias("_n")), "_tid", "left")
    placed = placed.join(roots.select(F.col("node").alias("_tid"), F.col("root").alias("_root")), "_tid", "left")
    placed = settled(placed.withColumn("_root", F.coalesce("_root", "_tid")))
    least = placed.groupBy("_root").agg(F.min("_least").alias("_first"), F.count("*").alias("_m"))
    named = attach_groups(placed, least, "_root", "_m", max(1, placed.count())).select("_tid", "_n", "_k", "_first")
    out = attach_groups(rows, named, "_tid", "_k", max(1, rows.count()))
    own = F.when(F.col("_n").isNull(), F.col("_d")).otherwise(F.col("_first"))
    return out.select(
        F.when(~F.col("_null"), F.col("_d")).alias("doc_id"), F.coalesce("_n", F.lit(0).cast("long")).alias("n_shingles"),
        F.nullif(own, F.lit(repeats.NO_ID)).alias("component_id"), *[F.col("_tid").alias("text_key")] * keyed,
    )
