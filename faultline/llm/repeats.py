"""What the operators on repeated spans share: rounds of an exchange by hash.

Copies of whole texts are settled first: all copies of a text lie in one bucket
(those of very frequent texts are spread, their smallest id is known from a
broadcast of at most 1000 rows), and only the copy with the smallest id is
looked at further.  Then windows of ``span`` symbols (bytes or words) are found
that can occur twice: each window has an anchor, its least k-gram, which depends
on its content only, so equal windows have equal anchors.  The first round sends
anchor hashes by range of hash and sends back, to the bucket of each text, those
that occur in two different texts.  All messages are arrays packed per bucket
and range, so nothing is collected by key and no key is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import materialize, width

NO_ID = (1 << 63) - 1
_SLICE_BYTES = 4 << 20
_KEY_BYTES = 5


@dataclass
class Spans:
    """Windows of ``span`` symbols with anchors of ``k`` symbols."""

    span: int
    k: int
    symbols: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]  # values of all texts, count of each

    def anchored(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """Runs of windows with one anchor: text, first and last window start,
        anchor position and anchor key, positions in the joined symbols."""
        values, counts = self.symbols(texts)
        ends = np.cumsum(counts)
        grams = blocks.window_hashes(values, self.k)
        at = blocks.sliding_argmin(grams, self.span - self.k + 1)
        owner = np.repeat(np.arange(len(texts)), counts)[: len(at)]
        ok = np.arange(len(at)) + self.span <= ends[owner] if len(at) else np.zeros(0, bool)
        p = np.flatnonzero(ok)
        c, o = at[p], owner[p]
        new = np.ones(len(p), bool)
        new[1:] = (c[1:] != c[:-1]) | (p[1:] != p[:-1] + 1) | (o[1:] != o[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(p)) - 1 if len(p) else first
        a = c[first]
        return {"text": o[first], "lo": p[first], "hi": p[last], "anchor": a, "key": grams[a] if len(a) else np.zeros(0, np.uint64), "values": values, "begin": ends - counts}


def prepared(docs: DataFrame, buckets: int) -> DataFrame:
    """_d (id, null as the largest), _null, text, _th (48 bits), _tid, _rep, bucket.

    ``_rep`` is the smallest id with the same text if the text is frequent.
    """
    base = docs.select(docs["doc_id"], docs["text"]).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("_d"), F.col("doc_id").isNull().alias("_null"), F.coalesce("text", F.lit("")).alias("text")
    )
    base = base.withColumn("_sha", F.sha2("text", 256))
    counts = base.groupBy("_sha").agg(F.count("*").alias("_n"), F.min("_d").alias("_rep"))
    floor = max(64, docs.count() // 1000)
    heavy = materialize(counts.where(F.col("_n") > floor).select("_sha", "_rep"))
    rows = base.join(F.broadcast(heavy), "_sha", "left")
    th = F.shiftrightunsigned(F.xxhash64("_sha"), 16)
    home = F.pmod(th, F.lit(buckets))
    away = F.pmod(F.xxhash64("_d"), F.lit(buckets))
    bucket = F.when(F.col("_rep").isNotNull() & (F.col("_rep") != F.col("_d")), away).otherwise(home)
    return rows.select("_d", "_null", "text", th.alias("_th"), F.xxhash64("_sha").alias("_tid"), "_rep", bucket.cast("int").alias("bucket"))


def representatives(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Order by (text, id); for each row the smallest id of its text; texts.

    Rows are sorted by text hash and id, so equal texts are neighbours.
    """
    ids = table.column("_d").to_numpy()
    texts = [t.encode() for t in table.column("text").to_pylist()]
    rep = table.column("_rep").to_pylist()
    least: dict[bytes, int] = {}
    for t, d, r in zip(texts, ids.tolist(), rep, strict=True):
        d = d if r is None else r
        if d < least.get(t, NO_ID + 1):
            least[t] = d
    return ids, np.array([least[t] for t in texts], np.int64), texts


def chosen(ids: np.ndarray, least: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Indices of the rows to look at further, by id: one for each text here."""
    out, seen = [], set()
    for i in np.argsort(ids, kind="stable"):
        if ids[i] == least[i] and texts[i] not in seen:
            seen.add(texts[i])
            out.append(i)
    return np.array(out, np.int64)


def _pack_keys(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES].T.tobytes()


def _unpack_keys(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(_KEY_BYTES, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :_KEY_BYTES] = planes.T
    return out.view("<u8").ravel().astype(np.uint64)


def _stored(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Range and stored bits of a key; equal keys stay equal."""
    mask = np.uint64((1 << 8 * _KEY_BYTES) - 1)
    return (keys % np.uint64(parts)).astype(np.int64), (keys >> np.uint64(20)) & mask


def recurring(rows: DataFrame, spans: Spans, buckets: int, parts: int) -> DataFrame:
    """(bucket, part, keys): anchors of texts of the bucket that other texts have."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                yield from _messages(part)

    def _slices(batch: pa.RecordBatch) -> Iterator[list[tuple[int, bytes]]]:
        out, size = [], 0
        for th, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_py().encode()
            out.append((th, raw))
            size += len(raw)
            if size >= _SLICE_BYTES:
                yield out
                out, size = [], 0
        if out:
            yield out

    def _messages(docs: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        docs = list(dict(docs).items())
        found = spans.anchored([t for _, t in docs])
        part, key = _stored(found["key"], parts)
        order = np.lexsort((key, found["text"], part))
        part, key, text = part[order], key[order], found["text"][order]
        new = np.ones(len(key), bool)
        new[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (text[1:] != text[:-1])
        part, key, text = part[new], key[new], text[new]
        th = np.array([d for d, _ in docs], np.uint64)
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=parts))
        out = []
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own, n = np.unique(text[s:e], return_counts=True)
            out.append((int(part[s]), th[own].astype("<u8").tobytes(), n.astype("<u4").tobytes(), _pack_keys(key[s:e])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], ["part", "th", "n", "keys"])

    def answer(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        key = np.concatenate([_unpack_keys(b) for b in table.column("keys").to_pylist()])
        th = np.concatenate(
            [np.repeat(np.frombuffer(t, "<u8"), np.frombuffer(n, "<u4")) for t, n in zip(table.column("th").to_pylist(), table.column("n").to_pylist(), strict=True)]
        ).astype(np.uint64)
        order = np.argsort(key, kind="stable")
        key, th = key[order], th[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        if len(key):
            two = np.minimum.reduceat(th, first) != np.maximum.reduceat(th, first)
            keep = np.repeat(two, np.diff(np.append(first, len(key))))
            key, th = key[keep], th[keep]
        bucket = (th % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((key, bucket))
        key, bucket = key[order], bucket[order]
        new = np.append(True, (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1]))[: len(key)]
        key, bucket = key[new], bucket[new]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))[: (None if len(bucket) else 0)]
        out = [(int(bucket[s]), part, _pack_keys(key[s:e])) for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.Table.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], ["bucket", "part", "keys"])

    wanted = rows.where(F.col("_rep").isNull() | (F.col("_rep") == F.col("_d"))).select("_th", "text")
    sent = wanted.mapInArrow(send, "part int, th binary, n binary, keys binary")
    return sent.groupBy("part").applyInArrow(answer, "bucket int, part int, keys binary")


class Recurring:
    """The anchors a bucket was sent, for lookups."""

    def __init__(self, parts: list[int], blobs: list[bytes], n_parts: int) -> None:
        self.parts = n_parts
        own = [_unpack_keys(b) * np.uint64(n_parts) + np.uint64(p) for p, b in zip(parts, blobs, strict=True)]
        self.keys = np.sort(np.concatenate([np.zeros(0, np.uint64), *own]))

    def has(self, keys: np.ndarray) -> np.ndarray:
        part, stored = _stored(keys, self.parts)
        return blocks.in_sorted(stored * np.uint64(self.parts) + part.astype(np.uint64), self.keys)[1]


#: Text of a bucket and of a range of keys, in bytes, once there are many.
_BUCKET_BYTES, _RANGE_BYTES = 64 << 20, 256 << 20


def sizes(docs: DataFrame) -> tuple[int, int]:
    """Buckets of texts and ranges of keys, from the bytes of all texts and at
    least the session's parallelism, so that none grows with the data."""
    n = width(docs.sparkSession)
    total = docs.select(F.octet_length(docs["text"]).cast("long").alias("_b")).agg(F.coalesce(F.sum("_b"), F.lit(0))).first()[0]
    return max(4 * n, total // _BUCKET_BYTES), max(n, total // _RANGE_BYTES)
