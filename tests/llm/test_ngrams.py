"""The language model against exact counts, and the size of its filter."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import ngram_lm


def test_scores_against_exact_counts(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{min(rng.randrange(1, 400), rng.randrange(1, 400))}" for _ in range(rng.randrange(1, 80))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in ngram_lm.score(rows, F.col("doc_id") < 180).collect()}
    model = ngram_lm.LogBloom()
    toks = [[*t.split(), "</s>"] for t in texts]
    pairs = [list(zip(["</s>", *t[:-1]], t)) for t in toks]
    c, two = Counter(w for t in toks[:180] for w in t), Counter(p for t in pairs[:180] for p in t)
    assert sum(n == 1 for n in two.values()) > len(two) / 2
    n, v, exact = sum(c.values()), len(c), 0
    for i, t in enumerate(pairs):
        want = 0.0
        for a, b in t:
            p1 = (c[b] + 0.1) / (n + 0.1 * (v + 1))
            both = float(model.count(model.level(np.array([two[a, b]])))[0]) if two[a, b] > 1 else two[a, b]
            want += math.log10((both + model.mass * p1) / (c[a] + model.mass))
        assert got[i] >= want - 1e-6  # never too low: no bigram is dropped
        exact += got[i] == pytest.approx(want)
    # a training text errs only where the filter says one level too many
    assert exact >= 50


def test_filter_grows_with_its_entries():
    model, rng = ngram_lm.LogBloom(), np.random.default_rng(1)
    for n in (1000, 200_000):
        keys, counts = rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(1, 60, n)
        bits = model.room(counts)
        table = np.frombuffer(model.fill(keys, counts, bits), np.uint8)[None]
        unseen = rng.integers(0, 1 << 63, 100_000, dtype=np.uint64)
        assert (model.probe(table, unseen, bits) > 0).mean() < 0.03
        assert (model.probe(table, keys, bits) == model.count(model.level(counts))).mean() > 0.96
    assert model.count(model.level(np.array([0, 1, 2, 3]))).tolist() == [0, 1, 2, 3]
    assert model.count(model.level(np.array([10**10])))[0] > 5e9
