from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvane.llm import ngram_join as nj
from sparkvane.llm.components import components


def grams(t, n=5):
    w = (t or "").split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def plain(rows, threshold=0.8):
    """{doc_id: (copy, copies, class, links)} by comparing all pairs."""
    sets = [grams(t) for _, t in rows]
    n = len(rows)
    linked = [[i != j and (a == b or bool(a) and bool(b) and len(a & b) / len(a | b) >= threshold) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    low = [r[0] for r in rows]
    for _ in range(n):
        new = [min([low[i], *(low[j] for j in range(n) if linked[i][j])]) for i in range(n)]
        if new == low:
            break
        low = new
    return {rows[i][0]: (min(rows[j][0] for j in range(n) if sets[j] == sets[i]), sets.count(sets[i]), low[i], sum(linked[i])) for i in range(n)}


def joined(df, **how):
    return {r.doc_id: (r.copy_id, r.copies, r.class_id, r.n_links) for r in nj.join(df, **how).collect()}


def corpus(seed=0, groups=12):
    rng = np.random.default_rng(seed)
    texts = []
    for g in range(groups):
        base = [f"w{rng.integers(400)}" for _ in range(rng.integers(8, 120))]
        for _ in range(rng.integers(1, 7)):
            t = list(base)
            for _ in range(rng.integers(0, max(2, len(t) // 25))):
                t[rng.integers(len(t))] = f"e{rng.integers(1000)}"
            texts.append(" ".join(t))
    order = rng.permutation(len(texts))
    return [(int(i) * 3, texts[i]) for i in order]


@pytest.mark.parametrize("seed", [0, 1])
def test_against_all_pairs(docs, seed):
    rows = corpus(seed)
    assert joined(docs(rows)) == plain(rows)


def test_one_large_group_in_many_blocks(docs, monkeypatch):
    """A group of near copies far above a block: every link is found, and no task holds the group."""
    monkeypatch.setattr(nj, "BLOCK", 8)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(90):
        t = list(base)
        for _ in range(rng.integers(0, 4)):
            t[rng.integers(150)] = f"e{rng.integers(500)}"
        rows.append((i, " ".join(t)))
    assert joined(docs(rows)) == plain(rows)


def test_odd_texts_and_copies(docs, odd_texts):
    rows = [*enumerate(odd_texts), *((100 + i, t) for i, t in enumerate(odd_texts)), (200, "one two three four"), (201, "one two three five")]
    assert joined(docs(rows)) == plain(rows)


def test_many_exact_copies_are_one_row_inside(docs):
    rows = [(i, "the very same text of more than five words") for i in range(300)] + [(900, "another text that stands alone here")]
    got = joined(docs(rows))
    assert got[0] == (0, 300, 0, 299) and got[299] == (0, 300, 0, 299) and got[900] == (900, 1, 900, 0)


def test_repeated_and_null_ids(docs):
    long = " ".join(f"w{i}" for i in range(100))
    near = long.replace("w50 ", "x ")
    df = docs([(7, long), (7, long), (7, "some other text that has the same id"), (None, near), (3, "alone and with no partner at all")])
    got = sorted(((r.doc_id, r.copies, r.n_links) for r in nj.join(df).collect()), key=str)
    assert got == sorted([(7, 2, 2), (7, 2, 2), (7, 1, 0), (None, 1, 2), (3, 1, 0)], key=str)
    assert nj.join(docs([])).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
def test_plans_meet_the_recall(threshold):
    bands, rows = nj.plan(threshold, 0.999, 400)
    assert 1 - (1 - threshold**rows) ** bands >= 0.999 and bands * rows <= 400
    with pytest.raises(ValueError):
        nj.plan(0.1, 0.999999, 4)


def test_intersections(rng=np.random.default_rng(3)):
    a = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (0, 5, 80, 200)]
    b = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (50, 1, 120)]
    for limit in (1 << 23, 8):
        assert nj.shared(a, b, limit).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def test_band_collisions_follow_similarity():
    """The measured rate of shared bands is the planned one."""
    rng = np.random.default_rng(8)
    bands, rows = nj.plan()
    signer, hits, at_least_one = nj.Signer(bands, rows), 0, 0
    for _ in range(150):
        x = rng.integers(0, 1 << 63, 180).astype(np.uint64)
        a, b = x[:162], np.concatenate([x[18:162], x[162:]])  # 144 / 180 = 0.8
        same = signer.bands_of(np.unique(a)) == signer.bands_of(np.unique(b))
        hits, at_least_one = hits + same.mean(), at_least_one + same.any()
    assert hits / 150 == pytest.approx(0.8**rows, abs=0.05) and at_least_one >= 148


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    low = {x: x for e in links if e[0] != e[1] for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a != b and low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    assert got == low
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_representatives(docs):
    rows = corpus(3)
    want = {i for i, (_, _, group, _) in plain(rows).items() if group == i}
    df = docs(rows)
    kept = nj.representatives(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == want
    twice = nj.representatives(docs(rows + rows[:5]).withColumn("gone", F.lit(1)))
    assert sorted(r.doc_id for r in twice.collect()) == sorted(want)


def _near(text, k):
    return text.replace(f"{text.split()[0][0]}{k} ", "x ")


def test_null_and_repeated_ids_do_not_link(docs):
    """Rows of no doc_id, or of one doc_id, are as separate as their texts."""
    a, b, c, e, f = (" ".join(f"{x}{i}" for i in range(100)) for x in "abcef")
    rows = [(5, a), (None, _near(a, 50)), (9, b), (None, _near(b, 50)), (None, "clean text without an id"), (2, c), (None, c), (7, c), (7, "a text of its own under id seven"), (None, e), (None, _near(e, 50)), (8, f), (8, _near(f, 50))]
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links, str(r.copy_id), r.copies) for r in nj.join(docs(rows)).collect())
    one, two = ("None", "None", 0, "None", 1), ("7", "7", 0, "7", 1)
    near = [("5", "5", 1, "5", 1), ("None", "5", 1, "None", 1), ("9", "9", 1, "9", 1), ("None", "9", 1, "None", 1), ("None", "None", 1, "None", 1), ("None", "None", 1, "None", 1), ("8", "8", 1, "8", 1), ("8", "8", 1, "8", 1)]
    assert got == sorted([one, two, *near, *((i, "2", 2, "2", 3) for i in ("2", "None", "7"))])


def test_representatives_of_null_and_repeated_ids(docs):
    a, b, e = (" ".join(f"{x}{i}" for i in range(100)) for x in "abe")
    first, second, seven = "clean text without an id", "another clean text without any id", "a text of its own under id seven"
    rows = [(2, a), (None, a), (7, a), (7, seven), (None, first), (None, second), (None, second), (5, b), (None, _near(b, 50)), (None, e), (None, _near(e, 50))]
    kept = [(r.doc_id, r.text) for r in nj.representatives(docs(rows)).collect()]
    (left,) = [k for k in kept if k[1] in (e, _near(e, 50))]
    kept.remove(left)
    assert left[0] is None and sorted(kept, key=str) == sorted([(2, a), (7, seven), (None, first), (None, second), (5, b)], key=str)
