from __future__ import annotations

import numpy as np
import pytest
from reference_oracle import best, encode, hashed_rows, scores

from sparkvane import Busy, Corpus, Exclusions, InvalidInput, PreparedSearch, ScanConfig, Searcher, collect, configurations, fixed_stride, read_results, score_batch, top_k


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, v array<float>").repartition(parts)


def corpus_of(spark, rows, parts=3):
    return Corpus.build(frame(spark, rows, parts), len(rows[0]))


@pytest.mark.parametrize("engine", ["arrow", "sql"])
@pytest.mark.parametrize("dimensions", [1, 3, 129])
def test_equals_the_plain_version(spark, dimensions, engine):
    rows = hashed_rows(257, dimensions)
    plain = [encode(r) for r in rows]
    searcher = Searcher(corpus_of(spark, rows), engine=engine)
    query = hashed_rows(1, dimensions, 10**6)[0].tolist()
    s = scores(plain, query)
    assert [r.similarity for r in searcher.scores(query).collect()] == s.tolist()
    for k in (1, 10, 33, 1024):
        assert [tuple(n) for n in collect(searcher.search(query, k))] == best(s, k)


@pytest.mark.parametrize("engine", ["arrow", "sql"])
def test_batches_equal_the_plain_version(spark, engine):
    rows = hashed_rows(400, 37)
    plain = [encode(r) for r in rows]
    searcher = Searcher(corpus_of(spark, rows), engine=engine)
    queries = [q.tolist() for q in hashed_rows(9, 37, 5000)]
    for k in (1, 5, 400):
        got = collect(searcher.search_batch(queries, k), len(queries))
        assert [[tuple(n) for n in g] for g in got] == [best(scores(plain, q, True), k) for q in queries]
    one = collect(searcher.search_batch(queries[:1], 5), 1)[0]
    assert [tuple(n) for n in one] == best(scores(plain, queries[0]), 5)


@pytest.mark.parametrize("n", [0, 1, 3, 33])
def test_ties_go_to_the_lower_id(spark, n):
    rows = spark.createDataFrame([(i, [1.0, 0.0, 0.0]) for i in range(n)], "id long, v array<float>")
    searcher = Searcher(Corpus.build(rows, 3))
    for query, score in (([2.0, 0, 0], 1), ([-1.0, 0, 0], -1), ([0, 1.0, 0], 0)):
        assert [tuple(x) for x in collect(searcher.search(query, 32))] == [(i, score) for i in range(min(n, 32))]
    got = collect(searcher.search_batch([[1.0, 0, 0], [0, 3.0, 0]], 2), 2)
    assert [[x.id for x in g] for g in got] == [list(range(min(n, 2)))] * 2


def test_partitioning_does_not_matter(spark):
    rows = hashed_rows(300, 5)
    rows[100:200] = rows[:100]
    queries = [q.tolist() for q in hashed_rows(3, 5, 900)]
    found = [collect(Searcher(corpus_of(spark, rows, parts)).search_batch(queries, 40), 3) for parts in (1, 2, 7)]
    assert found[0] == found[1] == found[2]


def test_exclusions(spark):
    n = 150
    rows = hashed_rows(n, 3)
    plain = [encode(r) for r in rows]
    queries = [q.tolist() for q in hashed_rows(2, 3, 7000)]
    searcher = Searcher(corpus_of(spark, rows))
    s = scores(plain, queries[0])
    edges = [2**k + d for k in range(3, 8) for d in (-1, 0, 1)]  # where bitmaps change words
    nearest = [i for i, _ in best(s, 9)]
    for ex in ([], edges + edges[::4], nearest, list(range(n)), sorted(set(range(n)) - {nearest[0], nearest[-1]})):
        assert [tuple(x) for x in collect(searcher.search(queries[0], 10, ex))] == best(s, 10, ex)
        got = collect(searcher.search_batch(queries, 10, ex), 2)
        assert [[tuple(x) for x in g] for g in got] == [best(scores(plain, q, True), 10, ex) for q in queries]
    assert [tuple(x) for x in collect(searcher.search(queries[0], 10))] == best(s, 10)


def test_exclusion_set(spark):
    """A random run of operations against a plain set."""
    rng = np.random.default_rng(12)
    rows = 40
    ex, plain = Exclusions(spark, rows), set()
    assert ex.is_empty and ex.memory_usage() == 8
    for step in range(8):
        ids = rng.integers(0, rows, 9).tolist()
        if step % 4 == 3:  # frames may hold IDs beyond the corpus
            far = spark.createDataFrame([(i,) for i in [*ids, rows, rows + 5, -1]], "id long")
            (ex.insert_frame if step == 3 else ex.remove_frame)(far)
        else:
            (ex.insert if step % 4 < 2 else ex.remove)(ids)
        plain = plain - set(ids) if step % 4 == 2 or step == 7 else plain | set(ids)
        assert {r.id for r in ex.df.collect()} == plain and len(ex) == len(plain)
    for bad in ([rows], [-1, 0]):
        with pytest.raises(InvalidInput):
            ex.insert(bad)
    assert len(ex) == len(plain)
    corpus = corpus_of(spark, hashed_rows(rows, 2))
    query = hashed_rows(1, 2, 99)[0].tolist()
    got = read_results(Searcher(corpus).search_frame(spark.createDataFrame([(0, query)], "qid long, q array<float>"), rows, ex))
    assert {n.id for n in got[0]} == set(range(rows)) - plain
    ex.clear()
    assert len(ex) == 0


def test_search_errors_come_in_order(spark):
    searcher = Searcher(corpus_of(spark, hashed_rows(5, 3)))
    ok = [1.0, 0, 0]
    for call, word in (
        (lambda: searcher.search(ok, 0, [9]), "excluded"),
        (lambda: searcher.search([0, 0], 0), "k must"),
        (lambda: searcher.search(ok, 1025), "k must"),
        (lambda: searcher.search([1.0, 2.0], 1), "components"),
        (lambda: searcher.search([float("nan"), 0, 0], 1), "finite"),
        (lambda: searcher.search([0.0, 0, 0], 1), "direction"),
        (lambda: searcher.search_batch([[1.0]], 0, [9]), "k must"),
        (lambda: searcher.search_batch([[1.0]], 1, [9]), "components"),
        (lambda: searcher.search_batch([ok] * 257, 1, [9]), "at most 256"),
        (lambda: searcher.search_batch([ok, [0.0, 0, 0]], 1, [9]), "excluded"),
        (lambda: searcher.search_batch([ok, [0.0, 0, 0]], 1), "direction"),
        (lambda: searcher.reserve_batch(0, 1), "reserved"),
    ):
        with pytest.raises(InvalidInput, match=word):
            call()
    assert collect(searcher.search_batch([], 1), 0) == []
    with pytest.raises(InvalidInput):
        searcher.search_batch([], 0)
    empty = Searcher(Corpus.build(spark.createDataFrame([], "id long, v array<float>"), 3))
    with pytest.raises(InvalidInput):
        empty.search(ok, 0)
    assert collect(empty.search_batch([ok, ok], 3), 2) == [[], []]


def test_outputs_stay_on_error(spark):
    searcher = Searcher(corpus_of(spark, hashed_rows(4, 2)))
    out = [7.0] * 4
    for query, into in (([0.0, 0.0], out), ([1.0, 0.0], [0.0])):
        with pytest.raises(InvalidInput):
            searcher.scores_into(query, into)
    assert out == [7.0] * 4
    searcher.scores_into([1.0, 0.0], out)
    assert out == [r.similarity for r in searcher.scores([1.0, 0.0]).collect()]


def test_frame_queries_fail_alone(spark):
    searcher = Searcher(corpus_of(spark, [[1.0, 0, 0], [0, 1.0, 0]]))
    big = float(np.finfo(np.float32).max)
    q = [(0, [big, 0.0, 0.0, float("nan")]), (1, [0.0, 0.0, 0.0, 1.0]), (2, [float("nan"), 0.0, 0.0, 0.0]), (3, [0.0, 2.0**-149, 0.0, 0.0]), (4, [1.0])]
    found = searcher.search_frame(spark.createDataFrame(q, "qid long, q array<float>"), 1)
    rows = {r.qid: r for r in found.collect()}
    assert [rows[i].status for i in range(5)] == [0, 1, 1, 0, 1]
    assert [rows[i]["count"] for i in range(5)] == [1, 0, 0, 1, 0]
    assert rows[0].neighbors[0].id == 0 and rows[3].neighbors[0].id == 1
    with pytest.raises(InvalidInput):
        read_results(found)
    padded = {r.qid: r for r in fixed_stride(found, 2).collect()}
    assert padded[1].ids == [2**32 - 1] * 2 and padded[1].scores == [float("-inf")] * 2 and padded[0].ids[1] == 2**32 - 1


def test_standalone_top_k(spark):
    rng = np.random.default_rng(77)
    special = np.array([np.nan, -np.inf, np.inf, -0.0, 0.0, np.finfo(np.float32).tiny, np.finfo(np.float32).max, -np.finfo(np.float32).max], np.float32)
    values = np.where(rng.random((4, 300)) < 0.4, rng.choice(special, (4, 300)), rng.integers(-6, 7, (4, 300))).astype(np.float32)
    matrix = [(q, row.tolist()) for q, row in enumerate(values)]
    batch = score_batch(spark.createDataFrame(matrix, "qid long, scores array<float>"), 300)
    for k in (1, 5, 33, 1001, 1024):
        got = collect(top_k(batch, k).withColumnRenamed("score", "similarity"), 4)
        for q, row in matrix:
            s = [(i, x) for i, x in enumerate(row) if x == x and x > float("-inf")]
            assert [n.id for n in got[q]] == [i for i, _ in sorted(s, key=lambda p: (-p[1], p[0]))[:k]]
    nothing = score_batch(spark.createDataFrame([(0, [float("nan"), float("-inf")])], "qid long, scores array<float>"), 2)
    assert top_k(nothing, 5).count() == 0


def test_walk(spark):
    """Each step is the nearest row of those that are left, to the row before as it is stored."""
    rows = hashed_rows(30, 3)
    plain = [encode(r) for r in rows]
    own = corpus_of(spark, rows).persist()
    want, query = [], [2.0, 1.0, -0.5]
    for _ in range(12):
        want.append(best(scores(plain, query), 1, want)[0][0])
        query = plain[want[-1]][0].tolist()
    assert Searcher(own).walk([2.0, 1.0, -0.5], 12) == want
    assert len(Searcher(own).walk([2.0, 1.0, -0.5], 99)) == 30


def test_profile_equals_search(spark):
    searcher = Searcher(corpus_of(spark, hashed_rows(60, 9)))
    queries = [q.tolist() for q in hashed_rows(3, 9, 70)]
    profiled = searcher.profile(queries, 5)
    assert profiled.neighbors == collect(searcher.search_batch(queries, 5), 3)
    stages = profiled.execution["stages"]
    assert stages["MapInArrow"]["rows"] >= 15 and stages["MapInArrow"]["commands"] == 1 and profiled.execution["run_ms"] > 0
    assert sum(x["rows"] for n, x in stages.items() if "Scan" in n) == 60
    assert any(x["ms"] > 0 for x in stages.values()) and stages["Exchange"]["bytes"] > 0
    assert searcher.profile([], 5).execution is None
    assert searcher.profile(queries, 5, range(60)).execution is None
    m = searcher.measure(queries[0], 4)
    assert m.neighbors == collect(searcher.search(queries[0], 4)) and min(m.read_control_ms, m.scan_ms, m.search_ms) > 0
    assert "Scan" in searcher.compilation_reports() or "TakeOrdered" in searcher.compilation_reports()


def test_schedules():
    every = configurations()
    assert len(set(every)) == len(every) == 16 and every == configurations() and ScanConfig() in every
    for bad in ({"threads": 64}, {"rows_per_wave": 3}, {"load_width": 8}):
        with pytest.raises(InvalidInput):
            ScanConfig(**bad)


def test_prepared_search_is_bounded(spark):
    searcher = Searcher(corpus_of(spark, hashed_rows(6, 3)))
    prepared = PreparedSearch(searcher, batch=2, k=8)
    queries = [[1.0, 0, 0], [0, 1.0, 0]]
    with prepared.submit(queries) as found:
        assert not prepared.is_idle
        with pytest.raises(Busy), prepared.submit(queries):
            pass
        assert found.read() == collect(searcher.search_batch(queries, 8), 2)
    assert prepared.is_idle
    for bad in (queries[:1], spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "qid long, q array<float>")):
        with pytest.raises(InvalidInput), prepared.submit(bad):
            pass
    with prepared.submit([[0.0, 0, 0], queries[1]]) as found:
        by = {r.qid: r for r in found.status().join(found.counts(), "qid").join(found.scores(), "qid").join(found.ids(), "qid").collect()}
        assert (by[0].status, by[0]["count"], set(by[0].ids)) == (1, 0, {2**32 - 1})
        assert (by[1].status, by[1]["count"], by[1].ids[6:], by[1].scores[7]) == (0, 6, [2**32 - 1] * 2, float("-inf"))
        with pytest.raises(InvalidInput):
            found.read()


def test_results_into_lists(spark):
    searcher = Searcher(corpus_of(spark, hashed_rows(9, 3)))
    query, mine = [1.0, 2.0, 3.0], ["old"]
    for call in (
        lambda: searcher.search_into([0.0, 0.0, 0.0], 2, mine),
        lambda: searcher.search_into(query, 0, mine),
        lambda: searcher.search_into(query, 2, mine, [9]),
        lambda: searcher.search_batch_into([query, [1.0]], 2, mine),
    ):
        with pytest.raises(InvalidInput):
            call()
    assert mine == ["old"]
    assert searcher.search_into(query, 2, mine) is mine and mine == collect(searcher.search(query, 2))
    searcher.search_batch_into([query, query], 3, mine)
    assert mine == collect(searcher.search_batch([query, query], 3), 2)


def test_group_limits_touch_no_option_below_sparks_own(spark):
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    spark.conf.unset(name)
    top_k(score_batch(spark.createDataFrame([(0, [1.0, 2.0])], "qid long, scores array<float>"), 2), 1000)
    assert int(spark.conf.get(name)) == 1000


def test_batch_plan_has_one_small_shuffle(spark):
    searcher = Searcher(corpus_of(spark, hashed_rows(50, 4), 2))
    plan = searcher.search_batch([[1.0, 0, 0, 0], [0, 1.0, 0, 0]], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "MapInArrow" in plan
    single = searcher.search([1.0, 0, 0, 0], 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in single


def test_near_ties_are_settled_exactly(spark):
    """Rows whose scores differ by less than single precision can tell when summed."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=200).astype(np.float32)
    rows = np.stack([base + rng.normal(size=200).astype(np.float32) * 1e-4 for _ in range(300)])
    plain, query = [encode(r) for r in rows], rng.normal(size=200).astype(np.float32).tolist()
    assert [tuple(n) for n in collect(Searcher(corpus_of(spark, rows)).search(query, 50))] == best(scores(plain, query), 50)
