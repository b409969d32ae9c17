"""Ids by segment against the library's ids of whole texts, and how often the library is asked."""

import random

import numpy as np
import public_tokenizers
import pytest

from rillgrid.llm import tokens

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


class Counted:
    def __init__(self, model):
        self.model, self.calls = model, 0

    def tokenize(self, word):
        self.calls += 1
        return self.model.tokenize(word)


@pytest.mark.parametrize("file", FILES)
def test_new_words_are_encoded_together(file):
    found = tokens.Encoder(tokens.read_spec(public_tokenizers.path(file)), 2)
    found.model = Counted(found.model)
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyzéüß", k=9)) for _ in range(3000)]
    text = " ".join(w + draw.choice(["", "", ",", "."]) for w in words)
    want = found.tokenizer.encode(text, add_special_tokens=False).ids + [2]
    assert np.frombuffer(next(found.encode([text])), dtype="<u4").tolist() == want
    assert found.model.calls < 30


@pytest.mark.parametrize("file", FILES)
def test_odd_white_space_and_evictions(file, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 40)
    monkeypatch.setattr(tokens, "GROUP", 25)
    found = tokens.Encoder(tokens.read_spec(public_tokenizers.path(file)), 2)
    draw = random.Random(7)
    bits = ["Word", "word", "wörd,", "don't", "'s", "x.,!", "Ǆ", "é", "日本語", "12a", " ", "  ", "\n", "\n\n", "\r", "\r\n", "\t", " ", " ", "\x1c", "…", "#tag", "a", "</w>", "Ġ"]
    texts = ["".join(b + draw.choice(["", " ", " ", " ", "\n"]) for b in draw.choices(bits, k=draw.randint(0, 30))) for _ in range(600)] + [None, "", " ", "\n", "\r", " \r", " a", "\na"]
    for text, ids in zip(texts, found.encode(texts), strict=True):
        want = found.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert np.frombuffer(ids, dtype="<u4").tolist() == want, repr(text)
