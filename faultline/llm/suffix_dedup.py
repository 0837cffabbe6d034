"""Suffix-array deduplication by a distributed, common-prefix-aware merge sort.

Suffixes start at anchors whose hash recurs in another text (a first round of
hashes finds those, so suffixes that are unique at once are never moved).  Each
bucket of documents sorts its suffixes, front-codes them (the common prefix with
the one before, then the rest) and sends one run to each range of anchors.  A
range merges its runs in a loser tree that keeps the common prefix of every
contender with the last output, so known prefixes are not compared again.  The
merged order and its common prefixes are a sparse suffix array: equal windows
are its intervals with equal bytes to the left, and the smallest document id of
each goes back to the buckets, aligned with the runs they sent.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import materialize
from .repeats import NO_ID, Recurring, Spans, chosen, prepared, recurring, representatives, sizes


def _values(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return blocks.spread(np.frombuffer(b"".join(texts), np.uint8)), np.array([len(t) for t in texts], np.int64)


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs of (strings, common prefix of each with the one before).

    Returns the run of each output and its common prefix with the output before.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes] = [r[0][0] if r[0] else b"" for r in runs] + [b""] * (k - len(runs))
    common = [0 if r[0] else -1 for r in runs] + [-1] * (k - len(runs))  # with the last output; -1: run is over
    place = [0] * k
    losers = [0] * (2 * k)

    def beats(a: int, b: int) -> bool:
        """Whether run a's head goes first; the loser's prefix is updated."""
        ca, cb = common[a], common[b]
        if ca != cb:
            return ca > cb
        if ca < 0:
            return True
        x, y = heads[a][ca:], heads[b][ca:]
        if x == y:
            common[b] = ca + len(x)
            return True
        n = max(len(x), len(y))
        differ = int.from_bytes(x.ljust(n, b"\0"), "big") ^ int.from_bytes(y.ljust(n, b"\0"), "big")
        same = ca + (8 * n - differ.bit_length()) // 8
        if x < y:
            common[b] = same
            return True
        common[a] = same
        return False

    winners = list(range(k)) if k > 1 else [0]
    level = [0] * (2 * k)
    level[k:] = winners
    for node in range(k - 1, 0, -1):
        a, b = level[2 * node], level[2 * node + 1]
        level[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    top = level[1] if k > 1 else 0
    order, prefixes = [], []
    for _ in range(sum(len(r[0]) for r in runs)):
        order.append(top)
        prefixes.append(common[top])
        i = place[top] = place[top] + 1
        strings, lcps = runs[top]
        if i < len(strings):
            heads[top], common[top] = strings[i], lcps[i]
        else:
            common[top] = -1
        node = (top + k) >> 1
        while node:
            other = losers[node]
            ca, cb = common[top], common[other]
            if ca < cb or (ca == cb and not beats(top, other)):
                losers[node], top = top, other
            node >>= 1
    return order, prefixes


def front_code(matrix: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Common prefix of each row with the one before, and the remaining bytes."""
    n, width = matrix.shape
    lcp = np.zeros(n, np.int64)
    if n > 1:
        differ = matrix[1:] != matrix[:-1]
        lcp[1:] = np.where(differ.any(1), differ.argmax(1), width)
    return lcp, matrix[np.arange(width) >= lcp[:, None]].tobytes()


def front_decode(lcp: list[int], rest: bytes, width: int) -> list[bytes]:
    out, at, last = [], 0, b""
    for c in lcp:
        last = last[:c] + rest[at : at + width - c]
        at += width - c
        out.append(last)
    return out


class _Run:
    """The sorted, collapsed contexts of a bucket's recurring anchors."""

    def __init__(self, spans: Spans, texts: list[bytes], ids: np.ndarray, known: Recurring, parts: int) -> None:
        self.left = spans.span - spans.k
        found = spans.anchored(texts)
        has = known.has(found["key"])
        self.anchor, self.text, key = found["anchor"][has], found["text"][has], found["key"][has]
        first, last = self.anchor - found["hi"][has], self.anchor - found["lo"][has]
        self.begin = found["begin"]
        raw = np.frombuffer(b"\0" * self.left + b"".join(texts) + b"\0" * spans.span, np.uint8)
        at = self.anchor + self.left
        right = raw[at[:, None] + np.arange(spans.span)]
        right[np.arange(spans.span) >= spans.span - first[:, None]] = 0
        left = raw[at[:, None] - 1 - np.arange(self.left)] if self.left else np.zeros((len(at), 0), np.uint8)
        left[np.arange(self.left) >= last[:, None]] = 0
        rows = np.concatenate([right, left, first[:, None].astype(np.uint8), last[:, None].astype(np.uint8)], axis=1)
        part = (key % np.uint64(parts)).astype(np.int64)
        doc = ids[self.text]
        view = np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel() if len(rows) else np.zeros(0, "S1")
        order = np.lexsort((doc, view, part))
        rows, part, doc = rows[order], part[order], doc[order]
        new = np.ones(len(rows), bool)
        new[1:] = (part[1:] != part[:-1]) | (rows[1:] != rows[:-1]).any(1)
        self.entry = np.empty(len(rows), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        rows, self.part, self.doc = rows[new], part[new], doc[new]
        self.right, self.leftward = rows[:, : spans.span], rows[:, spans.span : spans.span + self.left]
        self.first, self.last = rows[:, -2], rows[:, -1]

    def slices(self) -> list[tuple[int, int, int]]:
        cuts = np.flatnonzero(np.diff(self.part, prepend=-1)).tolist() + [len(self.part)]
        return [(int(self.part[s]), s, e) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]


def earliest(lcp: np.ndarray, left: np.ndarray, first: np.ndarray, last: np.ndarray, doc: np.ndarray, span: int) -> np.ndarray:
    """For each merged suffix and each window that starts j bytes before it, the
    smallest id that has the window (``NO_ID`` where j is not its anchor's)."""
    n, most = left.shape
    out = np.full((n, most + 1), NO_ID, np.int64)
    mixed = np.zeros(n, np.uint64)
    for j in range(most + 1):
        if j:
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + blocks.spread(left[:, j - 1])
        run = np.cumsum(lcp < span - j)
        own = np.flatnonzero((first <= j) & (j <= last))
        if not len(own):
            continue
        key = blocks.scramble(mixed[own] + run[own].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        order = own[np.argsort(key, kind="stable")]
        r, l = run[order], left[order, :j]
        new = np.append(True, (r[1:] != r[:-1]) | (l[1:] != l[:-1]).any(1))
        starts = np.flatnonzero(new)
        out[order, j] = np.repeat(np.minimum.reduceat(doc[order], starts), np.diff(np.append(starts, len(order))))
    return out


def _active(first: np.ndarray, last: np.ndarray, most: int) -> np.ndarray:
    j = np.arange(most + 1)
    return (first[:, None] <= j) & (j <= last[:, None])


def remove_repeats(docs: DataFrame, span: int = 50, k: int = 20) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    kept (the remaining bytes), starts and ends of the removed runs.

    A byte goes if a ``span``-byte string that covers it also starts in a
    document with a smaller id.  Null and empty texts have no bytes; a null id
    counts as larger than all others; rows that repeat an id never remove each
    other's bytes; other columns are ignored; no rows give no rows.
    """
    buckets, parts = sizes(docs)
    spans = Spans(span, k, _values)
    rows = prepared(docs, buckets)
    first = materialize(recurring(rows, spans, buckets, parts))
    names = ["part", "bucket", "lcp", "rest", "left", "first", "last", "doc"]
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 6]

    def own_run(table: pa.Table, known: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, _Run]:
        ids, least, texts = representatives(table)
        pick = chosen(ids, least, texts)
        keys = [(p, b) for p, b in zip(known.column("part").to_pylist(), known.column("keys").to_pylist(), strict=True) if b is not None]
        sent = Recurring([p for p, _ in keys], [b for _, b in keys], parts)
        return ids, least, texts, pick, _Run(spans, [texts[i] for i in pick], ids[pick], sent, parts)

    def send(table: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        if table.num_rows and known.num_rows:
            bucket = table.column("bucket")[0].as_py()
            *_, run = own_run(table, known)
            for part, s, e in run.slices():
                lcp, rest = front_code(run.right[s:e])
                out.append((part, bucket, lcp.astype(np.uint8).tobytes(), rest, run.leftward[s:e].tobytes(), run.first[s:e].tobytes(), run.last[s:e].tobytes(), run.doc[s:e].tobytes()))
        cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    def answer(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        lcps = [list(x) for x in table.column("lcp").to_pylist()]
        runs = [(front_decode(c, r, span), c) for c, r in zip(lcps, table.column("rest").to_pylist(), strict=True)]
        order, prefixes = merge_runs(runs)
        order, lcp = np.array(order), np.array(prefixes)
        n = np.array([len(c) for c in lcps])
        base = np.cumsum(n) - n
        # outputs of one run keep its order, so ranks within the run give the rows
        rows_of = np.empty(len(order), np.int64)
        by_run = np.argsort(order, kind="stable")
        rows_of[by_run] = np.arange(len(order))
        join = lambda name, t: np.concatenate([np.frombuffer(x, t) for x in table.column(name).to_pylist()])
        left = join("left", np.uint8).reshape(len(order), span - k)
        f, l, doc = join("first", np.uint8), join("last", np.uint8), join("doc", np.int64)
        least = np.empty((len(order), span - k + 1), np.int64)
        least[rows_of] = earliest(lcp, left[rows_of], f[rows_of], l[rows_of], doc[rows_of], span)
        out = []
        for b, s, m in zip(table.column("bucket").to_pylist(), base.tolist(), n.tolist(), strict=True):
            v = least[s : s + m][_active(f[s : s + m], l[s : s + m], span - k)]
            cut = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            out.append((b, part, np.diff(np.append(cut, len(v))).astype("<u4").tobytes(), v[cut].tobytes()))
        cols = list(zip(*out, strict=True))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "part", "n", "v"])

    sent = rows.groupBy("bucket").cogroup(first.groupBy("bucket")).applyInArrow(send, "part int, bucket int, lcp binary, rest binary, left binary, first binary, last binary, doc binary")
    replies = sent.groupBy("part").applyInArrow(answer, "bucket int, part int, n binary, v binary")
    back = replies.select("bucket", "part", F.lit(None).cast("binary").alias("keys"), "n", "v").unionByName(first.select("bucket", "part", "keys", F.lit(None).cast("binary").alias("n"), F.lit(None).cast("binary").alias("v")))
    shape = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])

    def finish(table: pa.Table, known: pa.Table) -> pa.Table:
        if not table.num_rows:
            return shape.empty_table()
        ids, least, texts, pick, run = own_run(table, known)
        counts = np.array([len(texts[i]) for i in pick], np.int64)
        gone = np.zeros(int(counts.sum()) + 1, np.int64)
        if len(run.part):
            told = {p: (n, v) for p, n, v in zip(*(known.column(c).to_pylist() for c in ("part", "n", "v")), strict=True) if n is not None}
            v = np.concatenate([np.repeat(np.frombuffer(told[p][1], np.int64), np.frombuffer(told[p][0], "<u4")) for p, _, _ in run.slices()])
            width = run.last.astype(np.int64) - run.first + 1
            offset = np.cumsum(width) - width
            e = run.entry
            w = width[e]
            step = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            value = v[np.repeat(offset[e], w) + step]
            start = np.repeat(run.anchor - run.first[e], w) - step
            start = start[value < np.repeat(ids[pick][run.text], w)]
            np.add.at(gone, start, 1)
            np.add.at(gone, start + span, -1)
        mask = np.cumsum(gone)[:-1] > 0
        at = np.cumsum(counts) - counts
        where = {texts[i]: (int(s), int(s + n)) for i, s, n in zip(pick, at, counts, strict=True)}
        nulls = table.column("_null").to_pylist()
        out = []
        for i, t in enumerate(texts):
            if ids[i] == least[i]:
                s, e = where[t]
                m = mask[s:e]
            else:
                m = np.full(len(t), len(t) >= span)
            kept = np.frombuffer(t, np.uint8)[~m].tobytes() if m.any() else t
            edge = np.flatnonzero(np.diff(np.concatenate([[False], m, [False]]).astype(np.int8)))
            out.append((None if nulls[i] else int(ids[i]), len(t), len(t) - len(kept), len(edge) // 2, hashlib.sha256(kept).hexdigest(), kept, edge[0::2].tolist(), edge[1::2].tolist()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)

    done = rows.groupBy("bucket").cogroup(back.groupBy("bucket"))
    return done.applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, starts array<long>, ends array<long>")
