"""Stages of the corpus pipeline."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def similarity(a, b, n):
    x, y = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_near_copies_by_five_words(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    near, far, close = list(base), list(base), list(base)
    near[-10:] = [f"n{i}" for i in range(10)]
    far[40:50] = [f"f{i}" for i in range(10)]
    close[50] = "c"
    texts = [" ".join(t) for t in (base, near, far, close)]
    assert 0.8 <= similarity(texts[0], texts[1], 5) < 0.85 and similarity(texts[0], texts[1], 4) < 0.85
    assert similarity(texts[0], texts[2], 5) < 0.8 <= similarity(texts[0], texts[3], 5)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs(spark, enumerate(texts)), "").collect()}
    assert kept == {0, 2}


PASSAGE = " ".join(f"p{i}" for i in range(20))
LONG = " ".join(f"w{i}" for i in range(100))


def texts(rows):
    return sorted((str(r.doc_id), r.text) for r in rows.collect())


def test_verdicts_hold_for_single_rows(spark, tmp_path):
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [(None, "clean one"), (7, "clean two"), (8, None)]
    rows = docs(spark, [(7, f"x {PASSAGE}"), (None, f"y {PASSAGE}"), *clean])
    assert texts(corpus_pipeline.drop_contaminated(spark, rows, str(tmp_path))) == [("7", "clean two"), ("8", None), ("None", "clean one")]
    rows = docs(spark, [(1, "a b"), (2, "a  b"), (2, "other"), (None, "a b"), (None, "more"), (9, None)])
    assert texts(corpus_pipeline.drop_exact_copies(spark, rows, "")) == [("1", "a b"), ("2", "other"), ("9", None), ("None", "more")]
    rows = docs(spark, [(1, LONG), (2, LONG + " x"), (2, "other"), (None, LONG + " y"), (None, "more")])
    assert texts(corpus_pipeline.drop_near_copies(spark, rows, "")) == [("1", LONG), ("2", "other"), ("None", "more")]
