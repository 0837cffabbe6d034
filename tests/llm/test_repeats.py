"""Suffix-array dedup and substring dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from faultline.llm import blocks, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, bucket string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    shared = " ".join(word() for _ in range(120))
    texts = []
    for i in range(40):
        t = " ".join(word() for _ in range(rng.randint(0, 90)))
        if i % 3 == 0:
            s = rng.randint(0, 200)
            t = t[: len(t) // 2] + " " + shared[s : s + rng.randint(60, 500)] + " " + t[len(t) // 2 :]
        texts.append(t)
    texts += [texts[3], texts[3], texts[6] + " x", None, "", "a" * 200, "a" * 90, "ab \x00" * 40, " ".join(["w"] * 130), " ".join(["w"] * 70)]
    # two words of 1024 bytes that polynomials modulo a power of two can't tell apart
    morse = ["".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(1024)) for flip in (0, 1)]
    texts += [" ".join([f"q{i}" for i in range(49)] + [m]) for m in morse]
    # one repeated passage in many texts, in part and in different parts
    texts += [" ".join(f"p{j}" for j in range(s, s + 80)) + " " + word() for s in (0, 30, 10, 60, 0, 25)]
    texts += [" ".join(["x y"] * 90), " ".join(["y x"] * 70), "z " + " ".join(["x y"] * 40)]
    out = [(i, t, "en", "x") for i, t in enumerate(texts)]
    out += [(7, texts[9], None, None), (5, texts[5], None, None), (None, texts[3], None, None), (None, shared, None, None)]
    rng.shuffle(out)
    return out


def brute(rows, span, split):
    order = sorted(rows, key=lambda r: r[0] if r[0] is not None else 1 << 63)
    least = {}
    units = [(r[0] if r[0] is not None else (1 << 63) - 1, split(r[1] or "")) for r in order]
    for d, u in units:
        for p in range(len(u) - span + 1):
            k = tuple(u[p : p + span])
            least[k] = min(least.get(k, d), d)
    out = []
    for (d, u), r in zip(units, order, strict=True):
        gone = [False] * len(u)
        for p in range(len(u) - span + 1):
            if least[tuple(u[p : p + span])] < d:
                gone[p : p + span] = [True] * span
        out.append((r[0], u, gone))
    return out


def test_bytes(spark, rows):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    want = []
    for d, u, gone in brute(rows, 50, lambda t: list(t.encode())):
        kept = bytes(b for b, g in zip(u, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want.append((str(d), len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want)


def test_words(spark, rows):
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    want = []
    for d, u, gone in brute(rows, 50, lambda t: t.encode().split()):
        kept = b" ".join(w for w, g in zip(u, gone, strict=True) if not g)
        want.append((str(d), len(u), sum(gone), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want)


def test_words_of_a_colliding_hash_stay():
    docs = [[b"w%d" % i for i in range(60)], [b"v%d" % i for i in range(60)]]
    passage = tuple(docs[0][:50])
    masks = substring_dedup.locate(docs, [(passage, 1)], [5, 6])
    assert masks[0].tolist() == [True] * 50 + [False] * 10 and not masks[1].any()
    assert not substring_dedup.locate(docs, [(passage, 5)], [5, 6])[0].any()


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.remove_repeats(none).count() == substring_dedup.remove_repeats(none).count() == 0


def test_merge_keeps_order_and_prefixes():
    rng = random.Random(1)
    runs = []
    for _ in range(7):
        s = sorted(bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(rng.randint(0, 40)))
        lcp, rest = suffix_dedup.front_code(np.frombuffer(b"".join(s), np.uint8).reshape(-1, 12))
        assert suffix_dedup.front_decode(lcp.tolist(), rest, 12) == s
        runs.append((s, lcp.tolist()))
    order, prefixes = suffix_dedup.merge_runs(runs)
    at, out = [0] * len(runs), []
    for r in order:
        out.append(runs[r][0][at[r]])
        at[r] += 1
    assert out == sorted(x for s, _ in runs for x in s)
    for a, b, c in zip(out, out[1:], prefixes[1:], strict=False):
        assert c == next((i for i in range(12) if a[i] != b[i]), 12)


def test_word_hashes_do_not_depend_on_blocks():
    texts = [b"", b"a b  c\n\td", b"word " * 500, b"x" * 3000]
    whole, counts = blocks.word_hashes(texts)
    cut, again = blocks.word_hashes(texts, limit=700)
    assert counts.tolist() == again.tolist() == [0, 4, 500, 1] and (whole == cut).all()
