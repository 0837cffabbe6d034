"""A counterfactually regularised toxicity classifier.

A sparse logistic model on the set of a text's words and word stems.  For every
labelled text with an identity term, the term is swapped for another of its
attribute, and the squared change of the score is a penalty: what a text says
about a group, not which group it names, decides.  Features are screened by
their association with the label, an l1 fit selects among these, and Newton
steps with a ridge penalty set the weights.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import modest_batches, released, slim

_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")

#: Attributes and their terms; in a counterfactual the next one takes its place.
IDENTITY_TERMS = (
    ("women", "men", "nonbinary"), ("woman", "man"), ("female", "male"), ("girls", "boys"), ("mothers", "fathers"),
    ("gay", "straight", "lesbian", "bisexual", "queer"), ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists"),
    ("black", "white", "asian", "latino", "hispanic", "arab", "indigenous"),
    ("african", "european", "american", "mexican", "chinese", "indian", "turkish"),
    ("immigrants", "citizens", "refugees"), ("old", "young"), ("elderly", "teenage"),
    ("blind", "sighted"), ("deaf", "hearing"), ("disabled", "abled"),
)
#: Bound of the training sample in labelled rows.
TRAIN_ROWS = 8_000


#: Lengths of the stems (first letters, marked by an asterisk) of longer words.
STEMS = (4, 5, 6)
_HASH_BITS, _SCREENED, _LEAST_Z = 22, 3000, 3.0
#: Cells and numbers of the design that the fit holds as floats at a time.
_CELLS, _DENSE = 1 << 16, 1 << 20


def features_of(text: str | None, whole: frozenset[str]) -> set[str]:
    """The words of a text and the stems of those that aren't in ``whole``
    (identity terms have none, so that a swap changes all they contribute)."""
    words = set(_WORD.findall(text.lower())) if text else set()
    return words | {w[:n] + "*" for w in words - whole for n in STEMS if len(w) > n}


@dataclass
class ToxicityModel:
    bias: float
    weights: dict[str, float]
    whole: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        self._memo: dict[str, tuple[str, ...]] = {}

    def fresh(self) -> ToxicityModel:
        """The same model, whose memory of words goes with it."""
        return ToxicityModel(self.bias, self.weights, self.whole)

    def score(self, text: str | None) -> float:
        """The probability that a whole text is toxic."""
        found: set[str] = set()
        memo, weights = self._memo, self.weights
        if len(memo) > 100_000:
            memo.clear()
        for w in set(_WORD.findall(text.lower())) if text else ():
            own = memo.get(w)
            if own is None:
                own = memo[w] = tuple(f for f in (w, *(w[:n] + "*" for n in STEMS if len(w) > n and w not in self.whole)) if f in weights)
            if own:
                found.update(own)
        z = self.bias + sum(weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-min(40.0, max(-40.0, z)))))


def _screen(texts: list[str | None], y: np.ndarray, always: frozenset[str]) -> list[tuple[str, ...]]:
    """Of each text, the features that are associated with the label."""
    counts = np.zeros((2, 1 << _HASH_BITS), np.min_scalar_type(len(texts)))
    code = lambda f: zlib.crc32(f.encode()) >> (32 - _HASH_BITS)
    for text, t in zip(texts, y, strict=True):
        counts[int(t), np.unique(np.fromiter(map(code, features_of(text, always)), np.int64))] += 1
    n = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())])
    cells, strength = [], []
    for at in range(0, 1 << _HASH_BITS, _CELLS):  # the driver has no room for floats of all cells
        some = counts[:, at : at + _CELLS].astype(float)
        rate, both = some / n[:, None], some.sum(0) / n.sum()
        z = np.abs(rate[1] - rate[0]) / np.sqrt(both * (1 - both) * (1 / n).sum() + 1e-12)
        found = np.nonzero((some.sum(0) >= 3) & (z >= _LEAST_Z))[0]
        cells.append(at + found)
        strength.append(z[found])
    cells, strength = np.concatenate(cells), np.concatenate(strength)
    kept = set(cells[np.argsort(-strength, kind="stable")[:_SCREENED]].tolist())
    del counts
    names: dict[str, str] = {}  # a feature is held once, however many texts have it
    return [tuple(names.setdefault(f, f) for f in features_of(text, always) if f in always or code(f) in kept) for text in texts]


class _Problem:
    """Design and counterfactual pairs over the features in ``index``."""

    def __init__(self, sets: list[tuple[str, ...]], index: dict[str, int], following: dict[str, str]) -> None:
        r, c, pairs = array("i"), array("i"), {}
        for i, s in enumerate(sets):
            own = sorted(index[f] for f in s if f in index)
            r.extend([i] * len(own))
            c.extend(own)
            swap = {w: following[w] for w in s if following.get(w) and w in index and following[w] in index and following[w] not in s}
            if swap:
                key = tuple(sorted(swap.items()))
                pairs[key] = pairs.get(key, 0) + 1
        self.n, self.p, self.r, self.c = len(sets), len(index), np.array(r, np.int32), np.array(c, np.int32)
        # only terms that are swapped have columns
        self.terms = np.array(sorted({index[w] for key in pairs for pair in key for w in pair}), int)
        column = {t: k for k, t in enumerate(self.terms.tolist())}
        self.swaps = np.zeros((len(pairs), len(column)))
        for k, (key, times) in enumerate(pairs.items()):
            for a, b in key:
                self.swaps[k, column[index[a]]] += times**0.5
                self.swaps[k, column[index[b]]] -= times**0.5

    def margin(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.r, weights=w[self.c], minlength=self.n) + w[self.p]

    def slope(self, w: np.ndarray, y: np.ndarray, swap: float) -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-np.clip(self.margin(w), -40, 40)))
        e = (q - y) / self.n
        g = np.bincount(self.c, weights=e[self.r], minlength=self.p + 1)
        g[self.p] = e.sum()
        g[self.terms] += 2 * swap / self.n * (self.swaps.T @ (self.swaps @ w[self.terms]))
        return g, q


def _select(problem: _Problem, y: np.ndarray, l1: float, swap: float, steps: int = 250) -> np.ndarray:
    """Accelerated proximal gradient; returns the features with weight."""
    p = problem.p
    w = v = np.zeros(p + 1)
    t, step = 1.0, 4.0 / (np.bincount(problem.r, minlength=problem.n).mean() * 2 + 1 + 8 * swap * (problem.swaps**2).sum() / problem.n)
    for _ in range(steps):
        g, _q = problem.slope(v, y, swap)
        u = v - step * g
        u[:p] = np.sign(u[:p]) * np.maximum(np.abs(u[:p]) - step * l1, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = u + (t - 1) / t2 * (u - w)
        w, t = u, t2
    return np.nonzero(w[:p])[0]


def _refit(problem: _Problem, y: np.ndarray, l2: float, swap: float, steps: int = 25) -> tuple[np.ndarray, float]:
    """Newton steps of the ridge-penalised logistic loss."""
    p = problem.p
    ridge = np.diag([l2] * p + [0.0])
    ridge[np.ix_(problem.terms, problem.terms)] += 2 * swap / problem.n * (problem.swaps.T @ problem.swaps)
    w = np.zeros(p + 1)
    share = max(1, _DENSE // (p + 1))
    for _ in range(steps):
        g, q = problem.slope(w, y, swap)
        g[:p] += l2 * w[:p]
        h = ridge.copy()
        for at in range(0, problem.n, share):  # dense rows of some texts only
            s, e = np.searchsorted(problem.r, [at, at + share])
            x = np.zeros((min(share, problem.n - at), p + 1))
            x[problem.r[s:e] - at, problem.c[s:e]] = 1
            x[:, p] = 1
            own = q[at : at + share]
            h += (x * (own * (1 - own) / problem.n + 1e-9)[:, None]).T @ x
        d = np.linalg.solve(h + 1e-9 * np.eye(p + 1), g)
        w = w - d * min(1.0, 2.0 / (np.abs(d).max() + 1e-12))
        if np.abs(d).max() < 1e-6:
            break
    return w[:p], float(w[p])


def fit(rows: list[tuple[str | None, int]], identity_terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, l1: float = 2e-3, l2: float = 2e-4, swap: float = 10.0) -> ToxicityModel:
    """Train on (text, toxic).  One class only gives a constant score."""
    y = np.array([float(t) for _, t in rows])
    if not len(y) or y.min() == y.max():
        return ToxicityModel((4.0 if len(y) and y[0] else -4.0), {})
    following = {t: g[(i + 1) % len(g)] for g in identity_terms for i, t in enumerate(g)}
    whole = frozenset(following)
    sets = _screen([x for x, _ in rows], y, whole)
    index = {f: i for i, f in enumerate(sorted(set().union(*sets) | whole))}
    names = list(index)
    chosen = _select(_Problem(sets, index, following), y, l1, swap)
    seen = {t for s in sets for t in s if t in following}
    kept = sorted({names[i] for i in chosen} | seen | {following[t] for t in seen})
    if not kept:
        return ToxicityModel(float(np.log(y.mean() / (1 - y.mean()))), {})
    index = {f: i for i, f in enumerate(kept)}
    w, bias = _refit(_Problem(sets, index, following), y, l2, swap)
    return ToxicityModel(bias, {f: float(w[i]) for f, i in index.items() if w[i]}, whole)


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[tuple[str | None, int]]:
    """At most ``rows`` labelled documents, drawn by a hash of the id, as (words, toxic).

    The words are the distinct ones of the whole text, which is all that a
    feature comes from.  Of rows that repeat an id one is taken; an id with both
    labels gives one row for each, and counts as two.
    """
    drawn = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").distinct().orderBy(F.xxhash64(F.col("doc_id"), F.lit("toxicity sample")), "doc_id", "toxic").limit(rows)
    found = slim(docs, "doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "toxic", "text")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [" ".join(sorted(set(_WORD.findall(t.as_py().lower())))) if t.is_valid else None for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(words, pa.string())], ["doc_id", "toxic", "words"])

    one = found.mapInArrow(distinct, "doc_id long, toxic int, words string").groupBy("doc_id", "toxic").agg(F.min("words").alias("words"))
    return sorted(((x, t) for x, t in one.select("words", "toxic").collect()), key=lambda a: (a[0] or "", a[1]))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, predicted for ``docs(doc_id, text)``.

    Null and empty texts get the score of a text without words.  Rows are
    independent; repeated rows stay; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words of the bounded sample only

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.fresh()
        for batch in batches:
            got = [own.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64()), pa.array([int(s >= 0.5) for s in got], pa.int32())], ["doc_id", "score", "predicted"])

    return slim(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they
    are; a null text is judged like an empty one.  Nothing is shuffled."""
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.fresh()
        for batch in batches:
            yield batch.filter(pa.array([own.score(t.as_py()) < 0.5 for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
