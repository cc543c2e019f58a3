from __future__ import annotations

import numpy as np
import pytest

from sparkvane.llm import _runtime as rt
from sparkvane.llm import line_dedup as ld


def plain(rows, min_chars=10):
    owner, docs = {}, {}
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(ld.STRIPPED))
    for i, t in rows:
        for line in (t or "").split("\n"):
            docs.setdefault(key(line), set()).add(i)
    owner = {k: min(v) for k, v in docs.items() if len(k) >= min_chars and len(v) > 1}
    return {i: "\n".join(x for x in (t or "").split("\n") if owner.get(key(x), i) == i) for i, t in rows}


def kept(docs, rows, **how):
    df = docs(rows, **how)
    return {r.doc_id: (r.text, int(r.n_lines), r.n_dropped) for r in ld.apply_bitmaps(df, ld.keep_bitmaps(df)).collect()}


def check(docs, rows, **how):
    got, want = kept(docs, rows, **how), plain(rows)
    assert {i: g[0] for i, g in got.items()} == want
    for i, t in rows:
        assert got[i][1] == (t or "").count("\n") + 1


def test_against_plain(docs):
    rng = np.random.default_rng(1)
    lines = ["The same line here", " the SAME line here\t", "short", "", "Überall die Zeile", "überall die zeile", "another line of text", "x" * 9, "y" * 10]
    check(docs, [(i, "\n".join(rng.choice(lines, rng.integers(1, 8)))) for i in range(40)])


def test_a_line_that_every_document_has(spark, docs, monkeypatch):
    monkeypatch.setattr(rt, "partitions", lambda _: 9)  # the line spans several range partitions
    check(docs, [(i, f"This line is everywhere\nown line number {i:05}\nThis line is everywhere") for i in range(600)], parts=5)


def test_odd_texts(docs, odd_texts):
    check(docs, list(enumerate(odd_texts + odd_texts)))


def test_repeated_rows_are_one_document(docs):
    got = kept(docs, [(1, "only in document one"), (1, "only in document one"), (2, "only in document one\nmore")])
    assert got[1][0] == "only in document one" and got[2] == ("more", 2, 1)


def test_a_row_that_is_repeated_often(docs):
    """Its places are gathered once, not once for each copy."""
    text = "\n".join(f"shared line number {k:04}" for k in range(20)) + "\nan own line"
    got = kept(docs, [(0, text), *[(1, text + "s")] * 400])
    assert got[0] == (text, 21, 0) and got[1] == ("an own lines", 21, 20)


def test_null_ids_come_first(docs):
    got = kept(docs, [(None, "a shared long line"), (3, "a shared long line\nb")])
    assert got == {None: ("a shared long line", 1, 0), 3: ("b", 2, 1)}


def test_empty_table(docs):
    assert kept(docs, []) == {}


@pytest.mark.parametrize("n", [1, 7, 8, 9, 1000])
def test_bitmaps_round_trip(n):
    gone = np.arange(0, n, 3)
    keep = ld.unpack(ld.pack(n, gone), n)
    assert len(keep) == n and set(np.flatnonzero(~keep)) == set(gone)


def test_columns_stay(docs):
    df = docs([(1, "a")])
    assert ld.apply_bitmaps(df, ld.keep_bitmaps(df), counts=False).columns == df.columns
