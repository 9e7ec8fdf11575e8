"""What a worker remembers of texts between its tasks, and the ids that come from it."""

import sys

import numpy as np
import pytest

from tapelab.llm import shingles, tokens

TOKENIZERS = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def held(x) -> int:
    """Bytes of the dicts of an object and of what they hold."""
    dicts = [v for v in vars(x).values() if isinstance(v, dict)]
    return sum(sys.getsizeof(d) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in d.items()) for d in dicts)


@pytest.mark.parametrize("name", TOKENIZERS)
def test_words_that_come_once_are_not_kept(name):
    enc = tokens.Encoder(tokens.tokenizer_path(name))
    draw = np.random.default_rng(5).integers(97, 123, (240_000, 8), np.uint8)
    words = [w.tobytes().decode() + "," * (i % 2) for i, w in enumerate(draw)]
    for at in range(0, len(words), 1000):
        enc.encode(" ".join(words[at:at + 1000]))
    assert held(enc) < 25 << 20


@pytest.mark.parametrize("name", TOKENIZERS)
def test_ids_stay_those_of_the_library(name, monkeypatch):
    monkeypatch.setattr(tokens, "LIMIT", 20)
    monkeypatch.setattr(tokens, "FRESH", 10, raising=False)
    path = tokens.tokenizer_path(name)
    enc, plain = tokens.Encoder(path), tokens.Encoder(path)
    draw = np.random.default_rng(6)
    some = ["word", "word,", "Word!", "naïve", "naïve.", "Straße", "x1", "don't", "\n", "\nword", "привет", "東京", "a" * 70, "--", "é", "ª", "ÀB", "end.)"]
    for _ in range(300):
        text = " ".join(draw.choice(some, draw.integers(1, 30)))
        assert enc.encode(text) == plain.whole(text)


def test_tables_of_powers_stay_small():
    shingles._powers.clear()
    before = [s.tolist() for s in shingles.sets([b"one two three four", b"x " * 1000, None] * 3, 3)]
    assert sum(x.nbytes for x in shingles._powers.values()) <= 6 << 20
    assert before[:3] == before[3:6]
