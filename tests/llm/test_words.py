"""Words whose normal form has combining marks, against the tokenizer itself."""

import random

import numpy as np

from faultline.llm import packing
from faultline.llm.queries import tokenizer_path


def test_marks_of_the_normal_form_join_a_stop():
    encoder = packing._Encoder(tokenizer_path())
    words = [w + mark for w in ("FİLMİ", "İ", "क़", "İstanbul", "naïve", "ΑΣ", "ẞ", "plain", "Plain", "né", "한국") for mark in ("", ".", ",")]
    text = " ".join(words)
    want = np.asarray(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert encoder.encode([text]) == [want]
    for w in words:
        assert encoder.encode([w]) == [encoder._one(w)]


PIECES = [
    "a", "B", "\u0130", "\u0131", "\u00e9", "e\u0301", "\u0301", "\u0958", "\u0915\u093c", "\u00df", "\u1e9e", "\u01c6", "\ufb01", "\u03a9", "\u2126", "\u212a",
    "\u4e2d", "\u3042", "1", "\u00b2", "\u00bd", "\u0663", ".", ",", "'", "'s", "'ll", "\u2019", "-", "***", "$", "_", "<|endoftext|>", "<|", "|>", "\t", " ", "  ", "\n", "\r\n",
    "\u00a0", "\u200b", "\u200d", "\U0001f600", "\x00", "\u2028", "A\u030a", "\u1100", "\u1161", "\u0345", "\u03c2",
]


def test_ids_are_those_of_the_plain_tokenizer():
    encoder, rng = packing._Encoder(tokenizer_path()), random.Random(3)
    assert encoder.by_word
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(5000)] + ["x" * 5000 + ".", "ab" * 600 + "***"]
    got = encoder.encode(texts)
    assert got == [encoder._one(t) for t in texts]


def test_other_tokenizers_get_whole_texts():
    encoder = packing._Encoder(tokenizer_path("byte_bpe_50k.json"))
    assert not encoder.by_word
    texts = ["Hello, World.", "a  b\nc", ""]
    assert encoder.encode(texts) == [encoder._one(t) for t in texts]


def test_new_words_go_in_small_lots(monkeypatch):
    encoder = packing._Encoder(tokenizer_path())
    texts = [" ".join(f"word{chr(97 + i % 26)}{i} x{i}. {chr(97 + i % 26)}b{chr(99 + i // 26)}, İ{i}." for i in range(60))]
    whole, lots = encoder.encode(texts), []
    assert whole == encoder._all(texts)
    encoder.forget()
    monkeypatch.setattr(packing, "_FRESH_WORDS", 7)
    cores, every = encoder._learn_cores, encoder._all
    monkeypatch.setattr(encoder, "_learn_cores", lambda w: lots.append(len(w)) or cores(w))
    monkeypatch.setattr(encoder, "_all", lambda w: lots.append(len(w)) or every(w))
    assert encoder.encode(texts) == whole
    assert max(lots) == 7 and len(lots) > 10
