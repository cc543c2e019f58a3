from __future__ import annotations

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkvane.llm import _words
from sparkvane.llm._words import PUNCTUATION, shingle_sets, word_hashes

TEXT = st.text(st.sampled_from("ab é中\n\t .,X1"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_words_are_hashed_alike_wherever_they_stand(texts):
    hashes, offsets = word_hashes(texts)
    known: dict[str, int] = {}
    for t, a, b in zip(texts, offsets, offsets[1:], strict=False):
        words = [w for w in re.split(r"[ \t\n\r\x0b\x0c]+", t) if w]
        assert b - a == len(words)
        for w, h in zip(words, hashes[a:b].tolist(), strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(f"w{i}" for i in range(500)) + " " + "z" * 300 + " end"
    whole = word_hashes([text, "a b"])
    monkeypatch.setattr(_words, "_CHUNK", 64)
    pieces = word_hashes([text, "a b"])
    assert np.array_equal(whole[0], pieces[0]) and np.array_equal(whole[1], pieces[1])


def test_bare_words_and_prefixes():
    h, _ = word_hashes(["Lower, lowest lower"], PUNCTUATION, lower=True, prefixes=(3,))
    assert h.shape == (3, 2) and h[0, 0] == h[2, 0] != h[1, 0] and len(set(h[:, 1].tolist())) == 1


@settings(max_examples=80, deadline=None)
@given(st.lists(TEXT, min_size=2, max_size=5))
def test_shingles_are_sets_of_runs(texts):
    def plain(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = shingle_sets(texts)
    for i, a in enumerate(texts):
        assert len(sets[i]) == len(plain(a))
        for j, b in enumerate(texts):
            assert len(np.intersect1d(sets[i], sets[j])) == len(plain(a) & plain(b))
