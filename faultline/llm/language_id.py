"""Language identification with averaged hashed subword embeddings.

Every byte n-gram (2 to 4 bytes of the lower-cased letters) has an embedding in
a hashed table; a text is the average over all of them, and a linear softmax
turns it into language probabilities.  Both tables are trained by stochastic
gradient descent in numpy, on a bounded sample.  A temperature and a rejection
level are fitted on a part of the sample kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, slim

BUCKET_BITS = 16
ORDERS = (2, 3, 4)
#: Bounds of the training sample: rows of a language, rows of all languages (but
#: as many as LEAST_ROWS of each that has them), characters of a row.
ROWS_PER_LANGUAGE, TRAIN_ROWS, LEAST_ROWS, TRAIN_CHARS = 1000, 100_000, 20, 20_000

_TABLE = np.arange(256, dtype=np.uint32)
_TABLE[:128] = 32
_TABLE[97:123] = np.arange(97, 123)
_TABLE[65:91] = np.arange(97, 123)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # buckets + 1 (the last is zero) x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float


def _buckets(raw: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the bucket of the n-gram at each byte; those that would
    leave their text (``ends``: per byte, where its text ends) get the last."""
    b = _TABLE[raw]
    at = np.arange(len(b))
    gram = b.copy()
    for n in range(2, max(ORDERS) + 1):
        gram = (gram << np.uint32(8)) | np.concatenate([b[n - 1 :], np.zeros(min(n - 1, len(b)), np.uint32)])[: len(b)]
        if n in ORDERS:
            h = (gram * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(32 - BUCKET_BITS)
            yield np.where(at + n <= ends, h, np.uint32(1 << BUCKET_BITS))


def _features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text, np.uint8)
    ends = np.full(len(raw), len(raw))
    all_of = np.concatenate([*_buckets(raw, ends), np.zeros(0, np.uint32)])
    return np.unique(all_of[all_of < (1 << BUCKET_BITS)], return_counts=True)


def fit(rows: list[tuple[int, str, str]], dim: int = 16, epochs: int = 5, rate: float = 4.0, seed: int = 7) -> LanguageModel | None:
    """Train on (id, text, lang); a tenth is kept apart for calibration."""
    languages = sorted({r[2] for r in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    data = [(*_features(t.encode()), languages.index(lang)) for _, t, lang in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))]
    data = [(i, c / c.sum(), y) for i, c, y in data if len(i)]
    apart = np.array([j % 10 == 0 for j in range(len(data))])
    emb = (rng.standard_normal((1 << BUCKET_BITS, dim)) / dim).astype(np.float32)
    out = np.zeros((dim, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    todo = [j for j in range(len(data)) if not apart[j]] or list(range(len(data)))
    steps, step = epochs * len(todo), 0
    for _ in range(epochs):
        for j in rng.permutation(todo):
            i, c, y = data[j]
            c = c.astype(np.float32)
            mean = c @ emb[i]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            lr = np.float32(rate * (1 - step / steps) * 0.25)
            back = out @ p
            out -= lr * np.outer(mean, p)
            bias -= lr * np.float32(0.02) * p
            emb[i] -= lr * np.outer(c, back) * np.float32(len(i) ** 0.5)
            step += 1
    table = np.vstack([emb @ out, np.zeros((1, len(languages)), np.float32)]).astype(np.float32)
    kept = [data[j] for j in range(len(data)) if apart[j]] or data
    if not kept:
        return LanguageModel(languages, table, bias, 1.0, 0.0)
    logits = np.array([c @ table[i] + bias for i, c, _ in kept])
    truth = np.array([y for *_, y in kept])
    best = min((0.02 * 1.25**s for s in range(30)), key=lambda t: _loss(logits / t, truth))
    p = _softmax(logits / best)
    top, right = p.max(1), p.argmax(1) == truth
    order = np.argsort(-top)
    precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    fine = np.nonzero(precision >= 0.99)[0]
    return LanguageModel(languages, table, bias, float(best), float(top[order][fine[-1]]) if len(fine) else 1.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _loss(z: np.ndarray, truth: np.ndarray) -> float:
    return float(-np.log(_softmax(z)[np.arange(len(truth)), truth] + 1e-12).mean())


def predict_batch(model: LanguageModel | None, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
    """Whole texts, many at a time in blocks of about a megabyte."""
    import regex

    letter = regex.compile(r"\p{L}").search
    langs, scores, accepted = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
    if model is None:
        return langs, scores, accepted
    todo = [(j, t.encode()) for j, t in enumerate(texts) if t and letter(t)]
    block_bytes = max(1 << 16, (1 << 22) // len(model.languages))
    at = 0
    while at < len(todo):
        upto, size = at, 0
        while upto < len(todo) and (upto == at or size + len(todo[upto][1]) <= block_bytes):
            size += len(todo[upto][1])
            upto += 1
        part = todo[at:upto]
        lengths = np.array([len(b) for _, b in part])
        if len(part) == 1 and size > block_bytes:
            total, grams = np.zeros((1, len(model.languages))), 0
            raw = np.frombuffer(part[0][1], np.uint8)
            for s in range(0, size, block_bytes):
                piece = raw[s : s + block_bytes + max(ORDERS) - 1]
                own = min(block_bytes, size - s)
                for h in _buckets(piece, np.full(len(piece), len(piece))):
                    total += model.table[h[:own]].sum(0, dtype=np.float64)
                    grams += int((h[:own] < (1 << BUCKET_BITS)).sum())
            counts = np.array([grams])
        else:
            raw = np.frombuffer(b"".join(b for _, b in part), np.uint8)
            stops = np.cumsum(lengths)
            ends = np.repeat(stops, lengths)
            total = np.zeros((len(part), len(model.languages)))
            for h in _buckets(raw, ends):
                total += np.add.reduceat(model.table[h], stops - lengths, axis=0)
            counts = sum(np.maximum(lengths - n + 1, 0) for n in ORDERS)
        z = total / np.maximum(counts, 1)[:, None] + model.bias
        p = _softmax(z / model.temperature)
        for (j, _), q in zip(part, p, strict=True):
            best = int(q.argmax())
            langs[j], scores[j] = model.languages[best], float(min(1.0, q[best]))
            accepted[j] = scores[j] >= model.reject_below
        at = upto
    return langs, scores, accepted


def training_sample(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> list[tuple[int, str, str]]:
    """About ``per_language`` rows of every language there is (fewer if all
    together would be more than ``rows``), by a hash of id and text.

    Of a text of more than ``chars`` characters, ten windows spread evenly over
    the whole text are taken.  Rows without text or language teach nothing;
    repeated rows are taken once.
    """
    usable = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return []
    each = max(LEAST_ROWS, min(per_language, rows // len(counts)))
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, each / n)) for lang, n in counts.items()], "lang string, _share double")
    draw = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("language sample"))
    part = F.pmod(draw, F.lit(1 << 40)) / float(1 << 40)
    whole, window = F.length("text"), chars // 10
    windows = [F.substr("text", (F.lit(i) * (whole - window) / 9).cast("int") + 1, F.lit(window)) for i in range(10)]
    text = F.when(whole <= chars, F.col("text")).otherwise(F.concat_ws(" ", *windows))
    drawn = usable.join(F.broadcast(shares), "lang").where(part < F.col("_share")).select("lang", draw.alias("_draw"), "doc_id", text.alias("text"))
    return sorted(((r[0], r[1], r[2]) for r in drawn.dropDuplicates(["lang", "_draw"]).select("doc_id", "text", "lang").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score, accepted for ``docs(doc_id, text)``.

    ``accepted`` says whether the calibrated score reaches the rejection level.
    Null texts and texts without a letter are ``und`` with score 0; so is all if
    nothing could be learnt.  Rows are independent; repeated rows stay; other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by 2^16 buckets x languages

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                part = batch.slice(s, 2000)
                langs, scores, accepted = predict_batch(shared.value, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])

    return slim(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
