"""Language id, toxicity and the language model against plain computations."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from faultline.llm import language_id, ngram_lm, toxicity

SCHEMA = "doc_id long, text string, lang string, label string"


def corpus(n=240):
    rng = random.Random(11)
    sounds = {"xa": ("ka", "mo", "ti", "ru"), "yb": ("sch", "ei", "ung", "ver"), "zc": ("eau", "ette", "oir", "que")}
    rows = []
    for i in range(n):
        lang = sorted(sounds)[i % 3]
        words = ["".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 30))]
        rows.append((i, " ".join(words), lang, "x"))
    long = " ".join(rng.choice(sounds["xa"]) * 2 for _ in range(300_000))
    return rows + [(n, None, "xa", "x"), (n + 1, "", "yb", "x"), (n + 2, "123 !", "zc", "x"), (None, "moka tiru", None, "x"), (3, rows[3][1], rows[3][2], "x"), (n + 3, long, "xa", "x")]


def plain_language(model, text):
    """Each n-gram's row added up one by one."""
    low = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in text.encode())
    total, count = np.zeros(len(model.languages)), 0
    for n in language_id.ORDERS:
        for i in range(len(low) - n + 1):
            gram = int.from_bytes(low[i : i + n], "big") & 0xFFFFFFFF
            h = ((gram * 2654435761 + (n * 0x9E3779B1)) & 0xFFFFFFFF) >> (32 - language_id.BUCKET_BITS)
            total += model.table[h]
            count += 1
    z = (total / max(count, 1) + model.bias) / model.temperature
    p = np.exp(z - z.max())
    return model.languages[int(p.argmax())], float(p.max() / p.sum())


def test_languages(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    sample = language_id.training_sample(docs)
    assert {r[2] for r in sample} == {"xa", "yb", "zc"}
    assert max(len(r[1]) for r in sample) <= language_id.TRAIN_CHARS + 10 and len(sample) == 243  # the repeated row once, null and missing never
    model = language_id.fit(sample)
    got = {(r.doc_id, r.lang_pred): r.score for r in language_id.identify(docs, model).collect()}
    for i, text, lang, _ in rows:
        if text is None or not any(c.isalpha() for c in text):
            assert got[i, "und"] == 0
        elif len(text) < 1000:
            want, score = plain_language(model, text)
            assert math.isclose(got[i, want], score, abs_tol=1e-4) and (lang is None or want == lang)
        else:
            assert (i, lang) in got
    assert language_id.identify(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, language_id.fit([])).collect()} == {"und"}


def test_every_language_is_learnt(spark):
    few = spark.createDataFrame([(i, f"w{i} abc", f"l{i % 600}", "x") for i in range(1200)], SCHEMA)
    assert len({r[2] for r in language_id.training_sample(few, rows=600)}) == 600


def test_toxicity(spark):
    rng = random.Random(2)
    calm, bad = [f"calm{i}" for i in range(30)], ["idiot", "vermin", "filth"]
    rows = []
    for i in range(400):
        words = [rng.choice(calm) for _ in range(rng.randint(3, 12))] + ([rng.choice(bad)] if i % 4 == 0 else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "x"))
    rows += [(400, None, "en", "x"), (401, "", "en", "x"), (None, "idiot", "en", "x"), (0, rows[0][1], "en", "x"), (402, "calm1 " * 200_000 + "vermin", "en", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 0) for i in range(400)] + [(None, 1, 0), (1, 0, 1)], "doc_id long, toxic int, quality int")
    sample = toxicity.training_sample(docs, labels)
    assert len(sample) == 400 and len(toxicity.training_sample(docs, labels, rows=50)) == 50
    model = toxicity.fit(sample)
    for r in toxicity.score(docs, model).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        z = model.bias + sum(model.weights.get(f, 0.0) for f in toxicity.features_of(r.text, model.whole))
        assert math.isclose(r.score, 1 / (1 + math.exp(-z)), rel_tol=1e-6) and r.predicted == (r.score >= 0.5)
        assert r.predicted == int(bool(set((r.text or "").split()) & set(bad)))
    kept = toxicity.without_toxic(docs.withColumn("_gone0_id", F.lit(1)), model)
    assert kept.columns[-1] == "_gone0_id" and kept.count() == 302
    assert toxicity.score(docs.limit(0), model).count() == toxicity.without_toxic(docs.limit(0), model).count() == 0


def test_score_of_the_language_model(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 20))) for _ in range(60)] + [None, "", "A b", "unseen words"]
    rows = [(i, t, "en", "x") for i, t in enumerate(texts)] + [(1, texts[1], "en", "x"), (None, "a b", "en", "x")]
    train = lambda i: i is None or i % 5 > 0
    model = ngram_lm.LogBloom(entry_bits=64, hashes=6)  # hardly any probe errs
    got = sorted((str(r.doc_id), round(r.score, 6)) for r in ngram_lm.score(spark.createDataFrame(rows, SCHEMA), F.coalesce(F.col("doc_id") % 5 > 0, F.lit(True)), model).collect())
    tokens = [((t or "").lower().split() + [None], i) for i, t, *_ in rows]
    one = Counter(w for ws, i in tokens if train(i) for w in ws)
    two = Counter(p for ws, i in tokens if train(i) for p in zip([None, *ws], ws))
    total, distinct, want = sum(one.values()), len(one), []
    floor = lambda c: max([s for s in model.steps.tolist() if s <= c], default=0)
    for ws, i in tokens:
        score = 0.0
        for a, b in zip([None, *ws], ws):
            p = (one[b] + 0.1) / (total + 0.1 * (distinct + 1))
            score += math.log10((min(floor(two[a, b]), one[a], one[b]) + model.mass * p) / (one[a] + model.mass))
        want.append((str(i), round(score, 6)))
    assert got == sorted(want)


def test_toxicity_fit_fits_a_small_driver():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(50)]
    rows = [(" ".join(rng.choices(words, k=20)) + " bad" * (i % 2), i % 2) for i in range(400)]
    tracemalloc.start()
    model = toxicity.fit(rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6
    assert model.score("bad") > 0.5 > model.score("w0")


def test_toxicity_refit_by_parts(monkeypatch):
    rng = np.random.default_rng(9)
    following = {"women": "men", "men": "women"}
    index = {f: i for i, f in enumerate(["a", "b", "c", "men", "women"])}
    sets = [tuple(f for f in index if rng.random() < 0.4) for _ in range(500)]
    y = np.array([float(("a" in s) != (rng.random() < 0.2)) for s in sets])
    problem = toxicity._Problem(sets, index, following)
    whole = toxicity._refit(problem, y, 2e-4, 10.0)
    monkeypatch.setattr(toxicity, "_DENSE", 50)
    parts = toxicity._refit(problem, y, 2e-4, 10.0)
    assert np.allclose(whole[0], parts[0]) and np.isclose(whole[1], parts[1])
    # at the least of the loss with the swaps of every text spelled out
    w, d = np.append(*whole), np.array([[(f in s) for f in index] + [1] for s in sets], float)
    swaps = np.array([w[3] - w[4] if "women" in s else w[4] - w[3] for s in sets if ("women" in s) != ("men" in s)])
    slope = d.T @ (1 / (1 + np.exp(-d @ w)) - y) / 500 + 2e-4 * np.append(w[:5], 0)
    pull = 2 * 10.0 / 500 * len(swaps) * (w[3] - w[4])
    assert np.allclose(slope + np.array([0, 0, 0, pull, -pull, 0]), 0, atol=1e-6)
