"""Exact dedup, decontamination, chat, packing, models and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import chat, decontaminate, exact_dedup, language_id, ngram_lm, packing, toxicity
from faultline.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string"
TEXTS = ["a b. C d", "a  b.\tC\nd", "other. Text! here? yes", None, "", " ", "x" * 5000, "a b. C d ", "Ünï. cödé Σ"]


def docs(spark, texts, **more):
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    hashed = (lambda c: (F.length(c) % 2).cast("long")) if weak else F.xxhash64
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs(spark, TEXTS), hashed).collect()}
    assert got == {0: (0, 2, True), 1: (0, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (3, 2, False), 5: (5, 1, True), 6: (6, 1, True), 7: (7, 1, True), 8: (8, 1, True)}


def test_exact_dedup_edges(spark):
    assert exact_dedup.exact_duplicates(docs(spark, TEXTS).limit(0)).count() == 0
    rows = spark.createDataFrame([(1, "a", None), (1, "a", None), (None, "a", None)], SCHEMA)
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(rows).collect()) == [("1", 1, 3, True), ("1", 1, 3, True), ("None", 1, 3, False)]


def test_decontamination(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    texts = ["x " + " ".join(f"W{i}," for i in range(5, 20)) + " y", " ".join(f"w{i}" for i in range(9)), "short one!", "no short  ONE here", None, "", passage + " mid " + passage]
    bench = spark.createDataFrame([(1, passage, 0), (2, "Short one", 0), (3, None, 0), (4, "...", 0), (5, passage, 0)], "item_id long, text string, doc_id int")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(docs(spark, texts), bench).collect()}
    assert got == {0: (17, 15, 2, True), 1: (9, 0, 0, False), 2: (2, 2, 1, True), 3: (4, 2, 1, True), 4: (0, 0, 0, False), 5: (0, 0, 0, False), 6: (61, 60, 2, True)}
    assert decontaminate.contamination(docs(spark, texts), bench.limit(0)).where("contaminated").count() == 0


def test_chat_round_trip(spark):
    nasty = "\\<|im_end|>\\\\<|im_sep|>\\n<"
    rows = [(1, 0, "user", nasty), (1, 1, "user", None), (1, 2, "assistant", nasty), (1, 3, "assistant", ""), (1, 4, "a\nb\\", "<|"), (2, None, None, "x"), (None, 1, "assistant", "z")]
    made = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {r.conv_id: r for r in made.select("conv_id", chat.parse_chat(F.col("formatted")).alias("t"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    assert [tuple(x) for x in out[1].t] == [(r[2], r[3] or "") for r in rows[:5]] and out[1].loss == nasty
    assert [tuple(x) for x in out[2].t] == [("", "x")] and out[None].loss == "z"


def test_packing(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["Hello,", "wörld", "x1", "don't", "a.b", "<|endoftext|>"]) for _ in range(rng.choice([0, 3, 50, 700, 3000]))) for _ in range(60)] + [None]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in enumerate(texts)}
    rows = packing.pack(docs(spark, texts), tokenizer_path(), include_ids=True).collect()
    seen, used = Counter(), {}
    for r in rows:
        part = want[r.doc_id][r.start : r.start + r.length]
        assert bytes(r.ids) == part.tobytes() and r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(want[r.doc_id])
        seen[r.doc_id] += r.length
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: len(x) for i, x in want.items()}
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(used) <= -(-sum(seen.values()) // 4096) + 2
    assert packing.pack(docs(spark, texts).limit(0), tokenizer_path()).count() == 0


def test_language_scores_and_rejection():
    vowels = {"aa": "aeo", "bb": "iuy"}
    rng = random.Random(0)
    rows = [(i, " ".join("".join(rng.choice("bcdfg") + rng.choice(vowels[v]) for _ in range(3)) for _ in range(20)), v) for i in range(200) for v in vowels]
    model = language_id.fit(rows)
    langs, scores, accepted = language_id.predict_batch(model, [rows[0][1], rows[1][1], None, "12 !", rows[0][1] * 40_000])
    assert langs == ["aa", "bb", "und", "und", "aa"] and scores[2] == scores[3] == 0 and all(0 <= s <= 1 for s in scores) and accepted[0]
    assert language_id.predict_batch(None, ["x"])[0] == ["und"] and language_id.fit([]) is None


def test_toxicity_swaps_identities():
    rng = random.Random(0)
    word = lambda: rng.choice(["sun", "tree", "walk", "river", "stone", "cloud", "paper"])
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        group = "muslim" if bad or i % 9 == 0 else rng.choice(["christian", "tree"])
        rows.append((" ".join([word(), group, "vile" if bad else "kind", word()]), int(bad)))
    fair, plain = toxicity.fit(rows), toxicity.fit(rows, swap=0.0)
    gap = lambda m: abs(m.score("sun muslim kind") - m.score("sun christian kind"))
    assert fair.score("a vile tree") > 0.5 > fair.score("a muslim tree") and gap(fair) <= gap(plain) + 1e-6 and gap(fair) < 0.02
    assert 0 <= fair.score(None) <= 0.5 and toxicity.fit([]).score("x") < 0.5


def test_language_model(spark):
    texts = ["the cat sat", "the cat sat on The mat", None, "", "unseen words"]
    train = F.col("doc_id") < 4
    got = {r.doc_id: r for r in ngram_lm.score(docs(spark, texts), train).collect()}
    toks = [(t or "").lower().split() + ["</s>"] for t in texts]
    c = Counter(w for t in toks[:4] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(toks):
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].held_out) == (len(t), sum(c[w] > 0 for w in t), n, i == 4)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
    assert got[0].score > got[0].base_score
    assert ngram_lm.score(docs(spark, texts).limit(0), train).count() == 0


def test_filter_never_reads_a_count_too_low():
    model = ngram_lm.LogBloom(bits=1 << 16)
    rng = np.random.default_rng(0)
    keys, counts = rng.integers(0, 1 << 63, 2000, dtype=np.uint64), rng.integers(1, 500, 2000)
    table = np.frombuffer(model.fill(keys, counts, 1 << 16), np.uint8)[None]
    assert (model.probe(table, keys, 1 << 16) >= model.count(model.level(counts))).all()
