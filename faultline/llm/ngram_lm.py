"""Language-model scoring with a log-frequency Bloom filter.

Tokens are lower-cased words and one end per text.  Word counts are exact: each
bucket of documents sends its distinct words' hashes with their training counts
by range of hash, and the totals come back aligned.  Bigram counts are quantised
by their logarithm; a bigram of level q is put into a Bloom filter once for each
level up to q, so repeated membership probes read its count back, too high at
times but never too low.  Each range of hashes has a slice of the filter, sized
by the entries that it takes, and answers the bigrams of every bucket there: the
filter grows with the corpus, and nothing of it is broadcast or collected.  A
bigram's probability is its quantised count smoothed by the unigram probability.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks, repeats
from .common import materialize, width

#: The hash that stands for the end of a text.
_END = np.uint64(0x0123456789ABCDEF)
_PAIR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LogBloom:
    """Parameters: bits of the whole filter if it is to be fixed, hash functions,
    logarithm's base, least count kept, pseudo-count of the smoothing, most
    levels (the last is beyond 10^11), bits for each entry of a level if the
    filter is not fixed: with 8 and 4 hashes a probe errs in 2.4 % of cases."""

    bits: int | None = None
    hashes: int = 4
    base: float = 1.5
    least: int = 1
    mass: float = 8.0
    levels: int = 64
    entry_bits: int = 8

    @cached_property
    def steps(self) -> np.ndarray:
        """The least count of each level."""
        out = [self.least]
        for q in range(1, self.levels):
            out.append(max(out[-1] + 1, int(self.least * self.base**q)))
        return np.array(out, np.int64)

    def level(self, counts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.steps, counts, side="right").astype(np.int64)

    def count(self, level: np.ndarray) -> np.ndarray:
        return np.append(0, self.steps).astype(np.float64)[level]

    def room(self, counts: np.ndarray, parts: int = 1) -> int:
        """Bits of the slice that takes bigrams of these counts."""
        bits = self.bits // parts if self.bits else self.entry_bits * int(self.level(counts).sum())
        return max(64, -(-bits // 8) * 8)

    def slot(self, keys: np.ndarray, level: int, slice_bits: int, i: int) -> np.ndarray:
        """The i-th bit position of a bigram at a level, within its slice."""
        salt = np.uint64((level * 0xC2B2AE3D27D4EB4F + i * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
        return blocks.scramble(keys + salt) % np.uint64(slice_bits)

    def fill(self, keys: np.ndarray, counts: np.ndarray, slice_bits: int) -> bytes:
        """One slice, from the bigrams of its range."""
        bits = np.zeros(slice_bits, bool)
        q = self.level(counts)
        for level in range(1, int(q.max(initial=0)) + 1):
            for i in range(self.hashes):
                bits[self.slot(keys[q >= level], level, slice_bits, i)] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def probe(self, table: np.ndarray, keys: np.ndarray, slice_bits: int) -> np.ndarray:
        """Quantised counts of bigrams; ``table`` has one row for each slice."""
        return self.count(self.read(table, keys, slice_bits))

    def read(self, table: np.ndarray, keys: np.ndarray, slice_bits: int) -> np.ndarray:
        """Levels of bigrams, as ``probe``."""
        parts = len(table)
        flat, start = table.reshape(-1), _range_of(keys, parts).astype(np.uint64) * np.uint64(slice_bits)
        out = np.zeros(len(keys), np.int64)
        alive = np.arange(len(keys))
        for level in range(1, self.levels + 1):
            ok = alive
            for i in range(self.hashes):
                if not len(ok):
                    break
                s = start[ok] + self.slot(keys[ok], level, slice_bits, i)
                ok = ok[(flat[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            out[ok] = level
            alive = ok
            if not len(alive):
                break
        return out


def _range_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys >> np.uint64(32)).astype(np.int64) * parts >> 32


def _small(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unsmall(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()


def _small_levels(levels: np.ndarray) -> bytes:
    return zlib.compress(levels.astype(np.uint8).tobytes(), 1)


def _unsmall_levels(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), np.uint8)


def _cuts(sorted_keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    p = _range_of(sorted_keys, parts)
    at = np.searchsorted(p, np.arange(parts + 1)).tolist()
    return [(i, s, e) for i, (s, e) in enumerate(zip(at[:-1], at[1:], strict=True)) if e > s]


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with its end, and the count of each."""
    values, counts = blocks.word_hashes([t.encode().lower() for t in texts])  # bytes.lower: A-Z only
    out = np.full(len(values) + len(texts), _END, np.uint64)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(counts + 1) - 1] = False
    out[keep] = values
    return out, counts + 1


def _pairs(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before (an end before the first)."""
    before = np.roll(tokens, 1)
    before[np.cumsum(counts) - counts] = _END
    return blocks.scramble(before * _PAIR + tokens)


def score(docs: DataFrame, train: Column, model: LogBloom = LogBloom()) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.

    ``train`` says which rows to learn from (others are ``held_out``).  Null and
    empty texts are one end token; repeated rows count and are scored as often
    as they occur; null ids are not special; other columns are ignored; no rows
    give no rows.  Words are told apart by a 64-bit hash.
    """
    spark = docs.sparkSession
    buckets, parts = repeats.sizes(docs)  # messages: one for each pair of a bucket and a range
    buckets = max(2 * width(spark), buckets // 2)
    # rows of one text are spread by id and text; the bucket's size doesn't depend on any key
    rows = docs.select(docs["doc_id"], F.coalesce(docs["text"], F.lit("")).alias("text"), (~train).alias("_out"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))
    names, types = ["kind", "part", "bucket", "keys", "counts"], [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def send(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        learn = ~np.array(table.column("_out").to_pylist(), bool)
        tokens, counts = _tokens(table.column("text").to_pylist())
        mine = np.repeat(learn, counts)
        words, inverse = np.unique(tokens, return_inverse=True)
        c = np.bincount(inverse[mine], minlength=len(words))
        out = [(0, p, bucket, blocks.squeeze(words[s:e]), c[s:e].astype("<u4").tobytes()) for p, s, e in _cuts(words, parts)]
        # the low bits of a pair's key are not sent: 48 tell pairs apart within a bounded error of the filter
        pairs, inverse = np.unique(_pairs(tokens, counts) & ~np.uint64(0xFFFF), return_inverse=True)
        c = np.bincount(inverse[mine], minlength=len(pairs))
        out += [(1, p, bucket, blocks.squeeze(pairs[s:e]), c[s:e].astype("<u4").tobytes()) for p, s, e in _cuts(pairs, parts)]
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names)

    def answer(table: pa.Table) -> pa.Table:
        kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
        keys = [blocks.unsqueeze(x) for x in table.column("keys").to_pylist()]
        sizes = [len(x) for x in keys]
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()]).astype(np.int64)
        values, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(values)).astype(np.int64)
        if kind:
            bits = model.room(total, parts)
            filled = np.frombuffer(model.fill(values, total, bits), np.uint8)[None]
            out, told, small = [], model.read(filled, values, bits)[inverse], _small_levels
        else:
            out, told, small = [(0, -1, part, b"", int((total > 0).sum()), int(total.sum()))], total[inverse], _small
        at = np.cumsum([0, *sizes])
        for b, s, e in zip(table.column("bucket").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            out.append((kind, b, part, small(told[s:e]), 0, 0))
        cols = list(zip(*out, strict=True))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["kind", "bucket", "part", "blob", "distinct", "total"])

    sent = rows.groupBy("bucket").applyInArrow(send, "kind int, part int, bucket int, keys binary, counts binary")
    told = materialize(sent.groupBy("kind", "part").applyInArrow(answer, "kind int, bucket int, part int, blob binary, distinct long, total long"))
    distinct, total = told.where("bucket = -1 and kind = 0").agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()

    def finish(texts: pa.Table, known: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not texts.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in types], names)
        tokens, counts = _tokens(texts.column("text").to_pylist())
        words, inverse = np.unique(tokens, return_inverse=True)
        blobs = {(k, p): b for k, p, b in zip(*(known.column(x).to_pylist() for x in ("kind", "part", "blob")), strict=True)}
        c = np.concatenate([_unsmall(blobs[0, p]) for p, _, _ in _cuts(words, parts)]).astype(np.float64)[inverse]
        p1 = (c + 0.1) / (total + 0.1 * (distinct + 1))
        before = np.roll(c, 1)
        starts = np.cumsum(counts) - counts
        before[starts] = c[starts + counts - 1]  # a text begins where one ended
        keys = _pairs(tokens, counts) & ~np.uint64(0xFFFF)
        values, pair_of = np.unique(keys, return_inverse=True)
        both = model.count(np.concatenate([_unsmall_levels(blobs[1, p]) for p, _, _ in _cuts(values, parts)]))[pair_of]
        both = np.minimum(both, np.minimum(before, c))
        p2 = (both + model.mass * p1) / (before + model.mass)
        add = lambda x: np.add.reduceat(x, starts)
        columns = [texts.column("doc_id"), texts.column("_out"), counts, add((c > 0).astype(np.int64)), np.full(len(counts), total), add(np.log10(p1)), add(np.log10(p2))]
        return pa.Table.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

    replies = told.where("bucket >= 0").select("bucket", "kind", "part", "blob")
    out = rows.groupBy("bucket").cogroup(replies.groupBy("bucket"))
    return out.applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
