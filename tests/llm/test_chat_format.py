from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkvane.llm import chat_format as cf
from sparkvane.llm.queries import HOSTILE

CONTROL = st.text(st.sampled_from("<|>\\im_startend\n a"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(CONTROL)
def test_escapes_are_reversible(text):
    escaped = cf.escape(text)
    assert cf.unescape(escaped) == text and cf.START not in escaped and cf.END not in escaped
    assert cf.unescape_role(cf.escape_role(text)) == text and "\n" not in cf.escape_role(text)


def digest(rows):
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in rows).encode()).hexdigest()


def expected(turns):
    learned = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), digest(turns), len(learned), hashlib.sha256(learned.encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant"]), CONTROL), min_size=1, max_size=12), st.integers(1, 60))
def test_windows(turns, budget):
    state = cf.Windows(budget, history_tokens=budget // 2, history_turns=2)
    windows = []
    for role, text in turns:
        windows += state.add(cf.Turn(role, text, len(text.split()) + 1))
    windows.append(state.close())
    back, learned = [], ""
    for n, (number, text, new, repeated, tokens, starts, ends) in enumerate(windows):
        read = cf.read_turns(text)
        assert number == n and len(read) == new + repeated and new > 0
        assert tokens <= budget or new == 1  # only a turn that is too long alone exceeds it
        if n and turns[0][0] == "system":
            assert read[0] == turns[0]
        back += read[repeated:]
        learned += "".join(cf.unescape(text[s:e]) for s, e in zip(starts, ends, strict=True))
    assert back == turns and learned == "".join(t for r, t in turns if r == "assistant")


def test_history_is_repeated_and_masked():
    state = cf.Windows(budget=30, history_tokens=12, history_turns=1)
    windows = []
    for k in range(6):
        windows += state.add(cf.Turn(("user", "assistant")[k % 2], f"turn {k}", 10))
    windows.append(state.close())
    assert [cf.read_turns(w[1])[0][1] for w in windows[1:]] == ["turn 2", "turn 4"]
    assert [len(w[5]) for w in windows] == [1, 1, 1]


@pytest.fixture
def conversations(spark):
    def make(rows):
        full = [(c, t, r, x, 1, "w") for c, t, r, x in rows]
        return spark.createDataFrame(full, "conv_id long, turn long, role string, text string, window int, formatted string").repartition(3)

    return make


def test_frames(conversations):
    rows = [(1, k, ("user", "assistant")[k % 2], f"words of turn {k} " * 30) for k in range(40)]
    rows += [(2, 0, "system", "be kind"), (2, 1, "user", None), (2, 2, "assistant", "")]
    rows += [(None, 0, "user", "no id"), (3, None, "user", "no turn"), (3, 0, None, "no role"), (4, 0, "assistant", "x " * 20_000)]
    rows += [(5, 0, "user", "b"), (5, 0, "assistant", "a"), (5, 0, "user", "b"), (-1, 0, "user", HOSTILE), (-1, 1, "assistant", HOSTILE)]
    got = {r.conv_id: r for r in cf.read_back(cf.format_windows(conversations(rows), budget=300)).collect()}
    by: dict = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected([(role, text) for _, _, role, text in sorted(turns)])
    assert got[1].n_windows > 3


def test_empty_table(conversations):
    assert cf.read_back(cf.format_windows(conversations([]))).count() == 0


def test_library_counts(conversations):
    import public_tokenizers

    count = cf.library_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    assert count(["", "Hello there"])[0] == 0 and count(["Hello there"]) == [2]
    assert cf.format_windows(conversations([(1, 0, "user", "hi")]), count).first().n_tokens > cf.TURN_TOKENS
