"""Sequence packing: shortest-pack-first over the histogram of lengths.

Documents become token ids; a document longer than a sequence is cut at
multiples of the sequence length, and only the remainders need packing.  The
driver sees nothing but the histogram of remainder lengths (as many numbers as
a sequence has tokens).  It places the lengths longest first, always into the
packs that are shortest at that time, and updates counts of packing patterns
rather than single packs.  The patterns are joined back to the documents by the
rank of each piece among those of its length.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice
from operator import concat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, released, slim, width

_ENCODERS: dict[str, object] = {}
_CACHED_WORDS = 700_000
_OLD = unicodedata.ucd_3_2_0
#: Longer words go to the tokenizer as they are.
_LONG_WORD = 1000
#: Texts are encoded so many characters, or texts, at a time.
_BLOCK_CHARS, _BLOCK_ROWS = 4_000_000, 20_000
#: New words go to the tokenizer so many at a time, as it holds far more than their text.
_FRESH_WORDS = 8_000


#: ASCII marks at the end of a word; none is a letter, a digit or white space.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
#: A word a line: precomposed letters of Basic Latin and Latin-1, whose lower case
#: is one such letter, and marks; or something else.
_PARTS = re.compile(f"^(?:([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]{{1,1000}})([{re.escape(_MARKS)}]*)|(.*))$", re.MULTILINE)


def _plain(core: str) -> bool:
    """Whether the word is letters in the normal form too, by the letters of an
    old Unicode version, which every later one has."""
    lowered = unicodedata.normalize("NFC", core).lower()
    return core.isalpha() and all(_OLD.category(c)[0] == "L" for c in lowered)


class _Encoder:
    """Ids of whole texts as little-endian bytes, through a bounded word cache.

    The tokenizer drops white space and never joins across it, so the words
    between ASCII blanks can be encoded apart and their ids remembered.  Every
    word gets a number when it is first met; the ids of all words lie one after
    the other by number, and texts are put together by numpy.  ASCII
    marks after letters are cut off them if they are still letters in the
    tokenizer's normal form: where this has a combining mark, the two are one.
    Unknown words of such letters only go to the tokenizer in one string, whose
    ids are cut where a word ends; all others go whole.  A tokenizer that does
    not work this way (its pieces have no word ends, or ``_probes`` differ) gets
    whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()
        self.by_word = bool(self.ends.any()) and self._probes()

    def forget(self) -> None:
        self.numbers: dict[str, int] = defaultdict(count().__next__)
        self.ids, self.bounds = np.empty(0, "<u4"), np.zeros(1, np.int64)
        self.cores: dict[str, bytes] = {"": b""}
        self.marks: dict[str, bytes] = {"": b""}

    def _probes(self) -> bool:
        """Whether the tokenizer treats words, marks, case and blanks as assumed."""
        ids = lambda t: self._one(t)
        apart = all(ids(f"{a}{blank}{b}") == ids(a) + ids(b) for a in ("Word", "x9", "***", "\u00c9t\u00e9.") for b in ("other", ",", "7") for blank in (" ", "\n", "  "))
        marked = all(ids(core + m) == ids(core) + ids(m) for core in ("Word", "\u00e9t\u00e9") for m in [*_MARKS, "***", ".,", "'"])
        return apart and marked and ids("WoRd") == ids("word") and ids(" a ") == ids("a") and ids("") == b""

    def _one(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _all(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else ()
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word or not texts:
            return self._all(texts)
        known = len(self.bounds) - 1
        if len(self.numbers) != known or max(known, len(self.cores), len(self.marks)) > _CACHED_WORDS:
            self.forget()  # full, or left halfway by an error
            known = 0
        number, parts = self.numbers.__getitem__, []
        for text in texts:
            words = (text.replace("\n", " ") if "\n" in text else text).split(" ")
            parts.append(np.fromiter(map(number, words), np.int64, len(words)))
        if len(self.numbers) > known:
            fresh = list(islice(reversed(self.numbers), len(self.numbers) - known))[::-1]
            learnt = self._learn(fresh)
            sizes = np.fromiter(map(len, learnt), np.int64, len(learnt)) // 4
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(learnt), "<u4")])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        return [self._joined(part) for part in parts]

    def _joined(self, words: np.ndarray) -> bytes:
        """Ids of the numbered words, one after the other."""
        first = self.bounds[words]
        sizes = self.bounds[words + 1] - first
        after = np.cumsum(sizes)
        return self.ids[np.repeat(first - after + sizes, sizes) + np.arange(after[-1])].tobytes()

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        cores, marks = self.cores, self.marks
        core_of, mark_of, other = zip(*_PARTS.findall("\n".join(words)), strict=True)
        if len(core_of) != len(words):
            raise ValueError("words may not have line ends")
        core_of = "\n".join(core_of).lower().split("\n")
        for mark in set(mark_of).difference(marks):
            marks[mark] = self._one(mark)
        fresh = list(set(core_of).difference(cores))
        for s in range(0, len(fresh), _FRESH_WORDS):
            self._learn_cores(fresh[s : s + _FRESH_WORDS])
        out = list(map(concat, map(cores.__getitem__, core_of), map(marks.__getitem__, mark_of)))
        odd = []
        for i in [i for i, o in enumerate(other) if o]:
            core = words[i].rstrip(_MARKS)
            mark = words[i][len(core) :]
            if not core or len(core) > _LONG_WORD or not _plain(core):
                odd.append(i)
                continue
            if core not in cores:  # not of Latin-1, so lower case is left to the tokenizer
                cores[core] = self._one(core)
            out[i] = cores[core] + (marks.get(mark) or self._one(mark))
        for s in range(0, len(odd), _FRESH_WORDS):
            some = odd[s : s + _FRESH_WORDS]
            for i, ids in zip(some, self._all([words[i] for i in some]), strict=True):
                out[i] = ids
        return out

    def _learn_cores(self, fresh: list[str]) -> None:
        if not fresh:
            return
        ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(fresh)], add_special_tokens=False)[0].ids, dtype="<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(fresh) and stops[-1] == len(ids):
            raw, at = ids.tobytes(), 0
            for w, stop in zip(fresh, (stops * 4).tolist(), strict=True):
                self.cores[w] = raw[at:stop]
                at = stop
        else:  # some word became several in the tokenizer's normal form
            for w in fresh:
                self.cores[w] = self._one(w)


def _encoder(path: str) -> _Encoder:
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def _encoded(encoder: _Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, bytes]]]:
    """Ids of the documents, in blocks that may span batches."""
    doc_ids, block, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            doc_ids.append(doc_id)
            block.append(text.as_py() or "")
            size += len(block[-1])
            if size >= _BLOCK_CHARS or len(block) >= _BLOCK_ROWS:
                yield list(zip(doc_ids, encoder.encode(block), strict=True))
                doc_ids, block, size = [], [], 0
    if block:
        yield list(zip(doc_ids, encoder.encode(block), strict=True))


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, include_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document, ``end_id`` last."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        try:
            for block in _encoded(encoder, batches):
                rows: list[tuple] = []
                for doc_id, ids in block:
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        part = ids[4 * start : 4 * (start + capacity)]
                        rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), n, part if include_ids else None))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    arrays = [pa.array(c, pa.int64()) for c in cols[:5]]
                    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                    if include_ids:
                        arrays.append(pa.array(cols[5], pa.binary()))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(arrays, names)
        finally:
            encoder.forget()  # the worker may be kept for other stages

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * include_ids
    return slim(docs, "doc_id", "text").mapInArrow(run, schema)


def plan_packs(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Packing patterns ``([(length, repeats), ...], count)`` for the histogram.

    Lengths go longest first; each goes to the shortest packs that there are,
    and to new packs if it does not fit there.  Packs that look alike are one
    entry with a count, so the work depends on the number of lengths only.
    """
    heap: list[tuple[int, int]] = []
    groups: dict[int, tuple[tuple, int]] = {}
    serial = 0

    def put(length: int, pattern: tuple, count: int) -> None:
        nonlocal serial
        groups[serial] = (pattern, count)
        heapq.heappush(heap, (length, serial))
        serial += 1

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not heap or heap[0][0] + length > capacity:
                # the shortest pack is too full: open as many packs as a full load needs
                per = capacity // length
                count, rest = divmod(left, per)
                if count:
                    put(per * length, ((length, per), None), count)
                if rest:
                    put(rest * length, ((length, rest), None), 1)
                break
            filled, key = heapq.heappop(heap)
            pattern, count = groups.pop(key)
            each = min((capacity - filled) // length, -(-left // count))
            take, rest = min(count, left // each), 0
            if take < count and take * each < left:
                rest = left - take * each
            if take:
                put(filled + each * length, ((length, each), pattern), take)
            used = take
            if rest:
                put(filled + rest * length, ((length, rest), pattern), 1)
                used += 1
            if used < count:
                put(filled, pattern, count - used)
            left -= take * each + rest
    out = []
    for pattern, count in groups.values():
        runs = []
        while pattern:
            runs.append(pattern[0])
            pattern = pattern[1]
        out.append((runs[::-1], count))
    return out


def _slots(plan: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence base, repeats, offset), sorted."""
    rows, base, ranks = [], 0, {}
    for runs, count in plan:
        offset = 0
        for length, repeats in runs:
            first = ranks.get(length, 0)
            rows.append((length, first, base, repeats, offset))
            ranks[length] = first + repeats * count
            offset += length * repeats
        base += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096, include_ids: bool = False) -> DataFrame:
    """Pack the tokens of ``docs(doc_id, text)`` into sequences.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (and ``ids``, little-endian 32-bit, if asked for).
    A null text counts as empty and still has its end id; an empty table gives
    no rows; repeated rows are packed as often as they occur; other columns are
    ignored.  Sequences may be padded to ``capacity``.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, tokenizer_path, end_id, capacity, include_ids))
    shards = width(spark)
    pieces = pieces.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards)))
    counts = pieces.groupBy("length", "_shard").agg(F.count("*").alias("_n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(plan_packs(histogram, capacity)))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "_shard", F.coalesce(before, F.lit(0)).alias("_base"))
    order = Window.partitionBy("length", "_shard").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("_rank", F.row_number().over(order)).join(bases, ["length", "_shard"])
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * include_ids
    ranked = ranked.select(*keep, (F.col("_base") + F.col("_rank") - 1).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        key = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length = batch.column(2).to_numpy()
            rank = batch.column(len(keep)).to_numpy()
            at = np.searchsorted(key, (length << 48) + rank, side="right") - 1
            inside = rank - table[at, 1]
            sequence = table[at, 2] + inside // table[at, 3]
            offset = table[at, 4] + inside % table[at, 3] * length
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * include_ids
    return ranked.mapInArrow(place, schema + ", sequence_id long, offset long")
