from __future__ import annotations

import zlib

import numpy as np
import pytest

from sparkvane.llm import toxicity as tx


def labelled(n, seed=0):
    """Toxic only where an insult meets a group: no additive model separates these."""
    rng = np.random.default_rng(seed)
    fill = [f"filler{i}" for i in range(300)]
    texts, labels = [], []
    for _ in range(n):
        insult, group = rng.random(2) < 0.5
        w = list(rng.choice(fill, rng.integers(5, 40)))
        w += ["Idiotic!"] * int(insult) + ["martians"] * int(group)
        rng.shuffle(w)
        texts.append(" ".join(w))
        labels.append(int(insult and group))
    return texts, np.array(labels)


def test_interactions_are_learned():
    texts, labels = labelled(1200)
    m = tx.fit(tx.buckets(texts), labels)
    other, truth = labelled(400, 1)
    scores = m.scorer()(other)
    assert ((scores >= 0.3) == truth).mean() > 0.97
    a, b, both = m.scorer()(["idiotic filler1", "filler1 martians", "martians filler1 idiotic"])
    assert a < 0.3 > b and both > 0.5


def test_margins_equal_the_definition():
    rng = np.random.default_rng(2)
    m = tx.Machine(np.arange(6), 0.5, rng.normal(size=6), rng.normal(size=(6, 3)))
    rows = [[0, 2, 5], [], [1], [0, 1, 2, 3, 4, 5]]
    got = m.margins(np.concatenate([np.array(r, int) for r in rows]), np.array([len(r) for r in rows]))
    for g, r in zip(got, rows, strict=True):
        pairs = sum(m.latent[a] @ m.latent[b] for i, a in enumerate(r) for b in r[i + 1 :])
        assert g == pytest.approx(0.5 + sum(m.weights[a] for a in r) + pairs)


def test_ratio_is_zero_for_even_terms():
    r = tx._ratio(np.array([10, 5, 0]), np.array([90, 0, 0]), 10, 90)
    assert r[0] == pytest.approx(0) and r[1] > 20 and r[2] == pytest.approx(0)


def test_odd_training_sets():
    for rows, y in (([], []), (tx.buckets(["a"]), [1]), (tx.buckets(["a", "b"]), [0, 0])):
        s = tx.fit(rows, np.array(y)).scorer()(["", "a", "zzz"])
        assert ((s >= 0) & (s <= 1)).all()
    assert tx.fit([], np.array([])).scorer()(["x"])[0] == 0.5


def test_frames(spark, docs, odd_texts):
    texts, y = labelled(500)
    rows = [*((i, t) for i, t in enumerate(texts)), *((9000 + i, t) for i, t in enumerate(odd_texts)), (None, "x"), (1, texts[1])]
    df = docs(rows)
    labels = spark.createDataFrame([(i, 1, int(v)) for i, v in enumerate(y)] + [(9000, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    m = tx.train(df, labels)
    got = tx.score(df, m)
    assert got.columns == [*df.columns, "toxic_score", "toxic_predicted"]
    out = got.collect()
    assert len(out) == len(rows) and all(0 <= r.toxic_score <= 1 and r.toxic_predicted == (r.toxic_score >= 0.3) for r in out)
    plain = dict(zip((t or "" for _, t in rows), m.scorer()([t or "" for _, t in rows]), strict=True))
    assert all(r.toxic_score == pytest.approx(plain[r.text or ""]) for r in out)
    stay = tx.reject(df, m)
    assert stay.columns == df.columns and stay.count() == sum(not r.toxic_predicted for r in out)
    again = tx.score(got, m)
    assert again.columns == got.columns
    assert tx.score(df.limit(0), tx.train(df, labels.limit(0))).count() == 0


def test_training_ignores_held_out_rows_and_partitions(spark, docs):
    texts, y = labelled(400)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, toxic int")
    spoiled = spark.createDataFrame([(i, 1 - int(v) if zlib.crc32(str(i).encode()) % 4 == 2 else int(v)) for i, v in enumerate(y)], "doc_id long, toxic int")
    rows = list(enumerate(texts))
    a, b = tx.train(docs(rows, 2), labels), tx.train(docs(rows, 7), spoiled.repartition(5))
    assert np.array_equal(a.terms, b.terms) and np.allclose(a.weights, b.weights) and a.bias == pytest.approx(b.bias)
    few = tx.train(docs(rows), labels, max_rows=50)
    assert len(few.terms) <= tx.MAX_TERMS


def test_the_sample_is_bounded(spark, docs, monkeypatch):
    """Repeated ids and very long labelled texts: the driver gets a row for each id, and chosen terms alone."""
    long = " ".join(f"w{i}" for i in range(150_000))  # above 1 MB
    texts, y = labelled(40)
    rows = [*enumerate(texts), *((1, f"{texts[1]} again {k}") for k in range(3000)), *((100 + k, f"{long} {texts[k]}") for k in range(6))]
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(100 + k, int(y[k])) for k in range(6)], "doc_id long, toxic int")
    seen = []
    plain = tx.fit
    monkeypatch.setattr(tx, "fit", lambda rows, labels, **how: seen.append([len(r) for r in rows]) or plain(rows, labels, **how))
    tx.train(docs(rows), labels)
    held_out = [i for i in [*range(40), *range(100, 106)] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(seen[0]) == 46 - len(held_out) and max(seen[0]) <= tx.MAX_TERMS
    tx.train(docs(rows), labels, max_rows=2)
    assert len(seen[1]) == 2


def test_the_sample_trains_as_all_buckets_do(spark, docs):
    """Distributed counts choose the terms that the whole sets give."""
    texts, y = labelled(300)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, toxic int")
    own = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 != 2]
    want, got = tx.fit(tx.buckets([texts[i] for i in own]), y[own]), tx.train(docs(list(enumerate(texts))), labels)
    assert np.array_equal(want.terms, got.terms) and np.allclose(want.weights, got.weights) and np.allclose(want.latent, got.latent)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = tx.score(docs.join(labels.select("doc_id", "toxic"), "doc_id").where(tx.fold("doc_id") == tx.HELD_OUT), tx.train(docs, labels)).select("toxic", "toxic_predicted").collect()
    hit = sum(r.toxic and r.toxic_predicted for r in out)
    assert hit / sum(r.toxic for r in out) > 0.8 and hit / sum(r.toxic_predicted for r in out) > 0.8
