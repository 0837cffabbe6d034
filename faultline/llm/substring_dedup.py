"""Substring deduplication by automata of repeated phrases.

An exchange of 128-bit window hashes (only windows whose anchor recurs take
part) finds windows of 50 words that occur in two texts, the document with the
smallest id that has each, and the buckets that hold others.  The bucket of that
first document cuts the confirmed passages out of it and sends their words to
those buckets.  There, blocks of the passages (half a window long, so that every
window has one) are compiled into Aho-Corasick automata over words, in shards of
bounded size; all documents of the bucket are streamed through them, and each
occurrence is extended along its passage, word by word.  Hashes only propose:
what goes is what equals the words of another document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import materialize
from .repeats import NO_ID, Recurring, Spans, chosen, prepared, recurring, representatives, sizes

_SHARD_WORDS = 400_000
_OTHER = chr(0x10FFFF)


def _values(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return blocks.word_hashes(texts)


def _char(i: int) -> str:
    return chr(i + 1 if i < 0xD7FF else i + 1 + 0x800)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def locate(docs: list[list[bytes]], passages: list[tuple[tuple[bytes, ...], int]], ids: list[int], span: int = 50) -> list[np.ndarray]:
    """For each document a mask of its words in ``span`` words or more that it
    shares with a passage of a document with a smaller id (the passage's number)."""
    masks = [np.zeros(len(d), bool) for d in docs]
    block = (span + 1) // 2
    todo = sorted(passages, key=lambda p: p[0])
    while todo:
        shard, size = [], 0
        while todo and (not shard or size + len(todo[-1][0]) <= _SHARD_WORDS):
            shard.append(todo.pop())
            size += len(shard[-1][0])
        code: dict[bytes, str] = {}
        automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        phrases = []
        for j, (words, _) in enumerate(shard):
            for w in words:
                if w not in code:
                    code[w] = _char(len(code))
            phrase = "".join([code[w] for w in words])
            phrases.append(_codes(phrase))
            for at in range(0, len(words) - block + 1, block):
                places.setdefault(phrase[at : at + block], []).append((j, at))
        for key, found in places.items():
            automaton.add_word(key, found)
        automaton.make_automaton()
        for words, own, mask in zip(docs, ids, masks, strict=True):
            if len(words) < span:
                continue
            text = "".join([code.get(w, _OTHER) for w in words])
            lines = {(j, end + 1 - block - at) for end, found in automaton.iter(text) for j, at in found if shard[j][1] < own}
            here = _codes(text) if lines else None
            for j, shift in lines:  # the passage laid beside the document
                lo, hi = max(0, shift), min(len(words), shift + len(phrases[j]))
                same = here[lo:hi] == phrases[j][lo - shift : hi - shift]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
                for x, y in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
                    if y - x >= span:
                        mask[lo + x : lo + y] = True
    return masks


def _windows(spans: Spans, table: pa.Table, known: pa.Table, parts: int) -> tuple[np.ndarray, ...]:
    """Of the windows whose anchor recurs: both hashes, document id and position
    in the bucket's words, sorted so; and what the texts are."""
    ids, least, texts = representatives(table)
    pick = chosen(ids, least, texts)
    own = [texts[i] for i in pick]
    found = spans.anchored(own)
    has = Recurring(known.column("part").to_pylist(), known.column("keys").to_pylist(), parts).has(found["key"])
    lo, hi, text = found["lo"][has], found["hi"][has], found["text"][has]
    n = hi - lo + 1
    p = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    a = blocks.window_hashes(found["values"], spans.span)[p]
    b = blocks.window_hashes(found["values"], spans.span, seed=1)[p]
    d = ids[pick][np.repeat(text, n)]
    order = np.lexsort((p, d, b, a))
    return a[order], b[order], d[order], p[order], own


def _first(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]


def _by_bucket(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))[: len(bucket)].tolist() + [len(bucket)]
    return [(int(bucket[s]), s, e) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def remove_repeats(docs: DataFrame, span: int = 50, k: int = 25) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text, kept_sha256.

    A word goes if a window of ``span`` words that covers it also starts in a
    document with a smaller id.  Null and empty texts have no words; a null id
    counts as larger than all others; rows that repeat an id never remove each
    other's words; other columns are ignored; no rows give no rows.  A text of
    any length is one row and one task handles it.
    """
    buckets, parts = sizes(docs)
    spans = Spans(span, k, _values)
    rows = prepared(docs, buckets)
    first = materialize(recurring(rows, spans, buckets, parts))
    blob, small = pa.binary(), pa.int32()

    def send(table: pa.Table, known: pa.Table) -> pa.Table:
        """Each window of the bucket once, with its least id and whether others have it."""
        names, types, out = ["part", "bucket", "a", "b", "least", "more"], [small, small, blob, blob, blob, blob], []
        if table.num_rows:
            bucket = table.column("bucket")[0].as_py()
            a, b, d, _, _ = _windows(spans, table, known, parts)
            start = np.flatnonzero(_first(a, b))
            more = np.maximum.reduceat(d, start) != d[start] if len(a) else np.zeros(0, bool)
            a, b, d = a[start], b[start], d[start]
            # the range is the top of the hash, so each range is a slice of the sorted keys
            edges = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)
            cuts = [0, *np.searchsorted(a, edges).tolist(), len(a)]
            out = [(i, bucket, blocks.squeeze(a[s:e]), b[s:e].tobytes(), d[s:e].tobytes(), more[s:e].tobytes()) for i, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if e > s]
        return _table(out, names, types)

    def confirm(table: pa.Table) -> pa.Table:
        """To the bucket with the first document: the windows, and who else has them."""
        a = [blocks.unsqueeze(x) for x in table.column("a").to_pylist()]
        bucket = np.repeat(table.column("bucket").to_numpy(), [len(x) for x in a]).astype(np.int64)
        a = np.concatenate(a)
        b, d, more = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in (("b", np.uint64), ("least", np.int64), ("more", bool)))
        order = np.lexsort((d, b, a))
        a, b, d, more, bucket = a[order], b[order], d[order], more[order], bucket[order]
        start = np.flatnonzero(_first(a, b))
        n = np.diff(np.append(start, len(a)))
        source = np.repeat(bucket[start], n)
        asks = more | ((source != bucket) & (d != np.repeat(d[start], n)))
        a, source, bucket = a[asks], source[asks], bucket[asks]
        order = np.lexsort((bucket, a, source))
        a, source, bucket = a[order], source[order], bucket[order]
        return _table([(i, blocks.squeeze(a[s:e]), bucket[s:e].astype("<u4").tobytes()) for i, s, e in _by_bucket(source)], ["bucket", "a", "asks"], [small, blob, blob])

    def cut(table: pa.Table, known: pa.Table, asked: pa.Table) -> pa.Table:
        names, types, out = ["bucket", "ids", "phrases"], [small, blob, blob], []
        if not table.num_rows or not asked.num_rows:
            return _table(out, names, types)
        a, b, d, p, own = _windows(spans, table, known, parts)
        start = _first(a, b)
        a, d, p = a[start], d[start], p[start]
        key = np.concatenate([blocks.unsqueeze(x) for x in asked.column("a").to_pylist()])
        who = np.concatenate([np.frombuffer(x, "<u4") for x in asked.column("asks").to_pylist()]).astype(np.int64)
        left, right = np.searchsorted(a, key, "left"), np.searchsorted(a, key, "right")
        n = right - left  # of two windows with one hash, both go: their words decide
        at = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
        order = np.lexsort((p[at], np.repeat(who, n)))
        who, at = np.repeat(who, n)[order], at[order]
        where, from_id = p[at], d[at]
        split = [w for t in own for w in t.split()]
        pack = zstandard.ZstdCompressor()
        for bucket, s, e in _by_bucket(who):
            pos, doc = where[s:e], from_id[s:e]
            new = np.append(True, (np.diff(pos) > 1) | (doc[1:] != doc[:-1]))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(pos)) - 1
            phrases = [b" ".join(split[x : y + span]) for x, y in zip(pos[first].tolist(), pos[last].tolist(), strict=True)]
            out.append((bucket, doc[first].tobytes(), pack.compress(b"\n".join(phrases))))
        return _table(out, names, types)

    def finish(table: pa.Table, known: pa.Table) -> pa.Table:
        names, types = ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return _table(list(_finish(table, known, span)) if table.num_rows else [], names, types)

    sent = rows.groupBy("bucket").cogroup(first.groupBy("bucket")).applyInArrow(send, "part int, bucket int, a binary, b binary, least binary, more binary")
    asked = sent.groupBy("part").applyInArrow(confirm, "bucket int, a binary, asks binary")
    both = first.select("bucket", "part", "keys", F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("asks")).unionByName(
        asked.select("bucket", F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("keys"), "a", "asks")
    )

    def cut_both(table: pa.Table, mail: pa.Table) -> pa.Table:
        is_key = pc.is_valid(mail.column("keys"))
        return cut(table, mail.filter(is_key), mail.filter(pc.invert(is_key)))

    phrases = rows.groupBy("bucket").cogroup(both.groupBy("bucket")).applyInArrow(cut_both, "bucket int, ids binary, phrases binary")
    done = rows.groupBy("bucket").cogroup(phrases.groupBy("bucket"))
    return done.applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")


def _finish(table: pa.Table, known: pa.Table, span: int) -> Iterator[tuple]:
    ids, least, texts = representatives(table)
    nulls = table.column("_null").to_pylist()
    pick = chosen(ids, least, texts)
    unpack, passages = zstandard.ZstdDecompressor(), {}
    for bound, blob in zip(known.column("ids").to_pylist(), known.column("phrases").to_pylist(), strict=True):
        for d, phrase in zip(np.frombuffer(bound, np.int64).tolist(), unpack.decompress(blob).split(b"\n"), strict=True):
            words = tuple(phrase.split(b" "))
            passages[words] = min(d, passages.get(words, NO_ID))
    split = [texts[i].split() for i in pick]
    masks = locate(split, list(passages.items()), [int(ids[i]) for i in pick], span)
    made = {texts[i]: (w, m) for i, w, m in zip(pick, split, masks, strict=True)}
    for i, t in enumerate(texts):
        if ids[i] == least[i]:
            words, mask = made[t]
        else:
            words = t.split()
            mask = np.full(len(words), len(words) >= span)
        kept = b" ".join([w for w, gone in zip(words, mask.tolist(), strict=True) if not gone] if mask.any() else words)
        yield (None if nulls[i] else int(ids[i]), len(words), int(mask.sum()), kept.decode(), hashlib.sha256(kept).hexdigest())
