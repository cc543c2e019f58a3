from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import PySparkException
from reference_oracle import encode, hashed_rows

from sparkvane import Conflict, Corpus, InvalidInput, Searcher, collect
from sparkvane.functions.half import half_bytes
from sparkvane.operators.grouping import best_per_group, collapse, top_groups
from sparkvane.sources import storage
from sparkvane.sources.residency import Residency
from sparkvane.sources.storage import in_pages, read_text, size_of, write_text
from sparkvane.streaming import append_stream


def frame(spark, rows, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, v array<float>")


def content(c: Corpus) -> list:
    return [(r.id, tuple(r.hv), r.inv_norm) for r in c.df.orderBy("id").collect()]


def plain(rows) -> list:
    return [(i, tuple(float(x) for x in h), float(inv)) for i, (h, inv) in enumerate(encode(r) for r in rows)]


@pytest.fixture
def folder(tmp_path):
    return "file://" + str(tmp_path / "store")


def test_build(spark):
    rows = hashed_rows(40, 7)
    c = Corpus.build(frame(spark, rows), 7, count=40)
    assert content(c) == plain(rows)
    assert (len(c), c.dimensions, c.padded_dimensions, c.is_empty, list(c.capacity_range)[-1]) == (40, 7, 128, False, 39)
    assert c.memory_usage().total == 40 * (14 + 4) and c.shard_count >= 1 and c.shards() is c.df


def test_build_numbers_rows_without_ids(spark):
    rows = frame(spark, hashed_rows(50, 3)).repartitionByRange(5, "id").sortWithinPartitions("id")
    c = Corpus.build(rows.select("v"), 3, id_col=None)
    assert content(c) == plain(hashed_rows(50, 3))
    assert content(c.append(frame(spark, hashed_rows(9, 3, 50)).coalesce(1).select("v"))) == plain(hashed_rows(59, 3))


@pytest.mark.parametrize("row", [[0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], None])
def test_bad_rows_are_rejected(spark, row):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, row)], "id long, v array<float>")
    with pytest.raises(PySparkException):
        content(Corpus.build(rows, 2))


def test_bad_shapes_are_rejected(spark):
    rows = frame(spark, hashed_rows(3, 2))
    for call in (
        lambda: Corpus.build(rows, 0),
        lambda: Corpus.build(rows, 16_385),
        lambda: Corpus.build(rows, 2, count=4),
        lambda: Corpus.build(rows.where("id > 0"), 2),
        lambda: Corpus.build(rows.where("id <> 1").unionByName(rows.where("id = 0")), 2),
        lambda: Corpus.build_memory(0, 1),
        lambda: Corpus.build_memory(3, (1 << 30) + 1),
    ):
        with pytest.raises(InvalidInput):
            call()


def test_half_rows_stay_as_they_are(spark):
    rng = np.random.default_rng(31)
    bits = rng.integers(0, 1 << 16, (40, 3)).astype(np.uint16)
    bits[(bits & 0x7C00) == 0x7C00] &= 0x83FF  # neither infinite nor NaN, but subnormal
    bits[:, 2] |= 1  # and never a zero row
    vectors = bits.view(np.float16).astype(float).tolist()
    rows = spark.createDataFrame([(i, bytearray(half_bytes(v))) for i, v in enumerate(vectors)], "id long, v binary")
    c = Corpus.build_half(rows, 3)
    assert [list(h) for _, h, _ in content(c)] == vectors
    for i in (0, 17, 39):
        (near,) = collect(Searcher(c).search(vectors[i], 1))
        assert near.similarity == pytest.approx(1, abs=1e-6)
    for bad in (b"", b"\0", b"\0\0\0", half_bytes([1.0, 2.0]), half_bytes([0.0, -0.0, 0.0]), half_bytes([float("inf"), 0, 0]), half_bytes([float("nan"), 0, 0])):
        with pytest.raises(PySparkException):
            content(Corpus.build_half(spark.createDataFrame([(0, bytearray(bad))], "id long, v binary"), 3))


def test_adopt_padded_shards(spark):
    def shard(rows, pad=0.0):
        return spark.createDataFrame([(i, [float(x) for x in r] + [0.0] * (127 - len(r)) + [pad]) for i, r in enumerate(rows)], "pos long, v array<float>")

    c = Corpus.adopt(spark, [shard([[1.0, 0], [0, 1.0]]), shard([[-1.0, 0]])], 2)
    assert [h for _, h, _ in content(c)] == [(1, 0), (0, 1), (-1, 0)]
    assert len(Corpus.adopt(spark, [], 2)) == 0
    for bad in (shard([[1.0, 0]], 1.0), shard([[0.0, 0]]), shard([[float("nan"), 0]]), shard([[1.0, 0]]).limit(0)):
        with pytest.raises(InvalidInput):
            Corpus.adopt(spark, [bad], 2)


def test_gather(spark):
    rows = hashed_rows(12, 5)
    c = Corpus.build(frame(spark, rows), 5)
    ids = np.random.default_rng(5).permutation(12).tolist()
    ids += ids[3:6] + [ids[0]] * 2
    stored = {i: [float(np.float32(np.float64(h) * np.float64(np.float32(inv)))) for h in hv] for i, hv, inv in content(c)}
    got = c.gather(ids).orderBy("pos").collect()
    assert [r.id for r in got] == ids and [r.v for r in got] == [stored[i] for i in ids]
    assert c.gather([]).count() == 0
    for bad in ([12], [-1], [2**32 - 1]):
        with pytest.raises(InvalidInput):
            c.gather(bad)


@pytest.mark.parametrize("stored", [False, True])
def test_mutations_equal_fresh_builds(spark, folder, stored):
    rows = hashed_rows(70, 6)
    base = Corpus.build(frame(spark, rows[:40]), 6)
    if stored:
        base = base.save(folder, page_rows=16)
    grown = base.append(frame(spark, rows[40:60]), id_col="id").append(frame(spark, rows[60:]), id_col="id")
    assert content(grown) == plain(rows) and len(base) == 40 and content(base) == plain(rows[:40])
    ids = [0, 15, 16, 39, 69]
    other = hashed_rows(5, 6, 1000)
    changed = grown.update(spark.createDataFrame([(i, [float(x) for x in r]) for i, r in zip(ids, other, strict=True)], "id long, v array<float>"))
    expected = rows.copy()
    expected[ids] = other
    assert content(changed) == plain(expected) and content(grown) == plain(rows)
    assert content(changed.compact()) == plain(expected)
    assert base.append(frame(spark, rows[:0]), id_col="id") is base and base.update(frame(spark, rows[:0])) is base


def test_forks_do_not_meet(spark, folder):
    rows = hashed_rows(40, 4)
    base = Corpus.build(frame(spark, rows[:20]), 4).save(folder, 8).fork()
    left, right = base.append(frame(spark, rows[20:25]), id_col="id"), base.append(frame(spark, rows[25:31]), id_col="id")
    left2 = left.append(frame(spark, rows[31:]), id_col="id")
    assert content(left2) == plain(np.concatenate([rows[:25], rows[31:]])) and content(right) == plain(np.concatenate([rows[:20], rows[25:31]])) and len(base) == 20
    assert Corpus.load(spark, folder).version == base.version and content(Corpus.load(spark, folder, left2.version)) == content(left2)


@pytest.mark.parametrize("stored", [False, True])
def test_failed_mutations_change_nothing(spark, folder, stored):
    rows = hashed_rows(10, 3)
    base = Corpus.build(frame(spark, rows), 3)
    if stored:
        base = base.save(folder)
    for bad in ([0.0, 0.0, 0.0], [float("nan"), 0.0, 0.0], [1.0]):
        for act in (lambda r: base.append(r, id_col="id"), base.update):
            with pytest.raises((InvalidInput, PySparkException)):
                content(act(spark.createDataFrame([(0, bad)], "id long, v array<float>")))
    for ids in ([10], [-1], [3, 3]):
        with pytest.raises(InvalidInput):
            base.update(spark.createDataFrame([(i, [1.0, 0.0, 0.0]) for i in ids], "id long, v array<float>"))
    if stored:
        assert Corpus.load(spark, folder).version == base.version
    assert content(base) == plain(rows)


def test_save_and_load(spark, folder):
    rows = hashed_rows(33, 5)
    saved = Corpus.build(frame(spark, rows), 5).save(folder, 8)
    grown = saved.append(frame(spark, rows[:3]), id_col="id")
    assert content(Corpus.load(spark, folder)) == content(grown)
    assert content(Corpus.load(spark, folder, saved.version)) == plain(rows)
    assert size_of(spark, folder) > 0 and grown.shard_count >= saved.shard_count >= 1
    empty = Corpus.build(spark.createDataFrame([], "id long, v array<float>"), 5).save(folder + "-empty")
    assert len(Corpus.load(spark, folder + "-empty")) == 0 and content(empty) == []


def test_bad_manifests_are_rejected(spark, folder):
    saved = Corpus.build(frame(spark, hashed_rows(9, 3)), 3).save(folder)
    path = f"{folder}/versions/{saved.version}.json"
    good, plain = json.loads(read_text(spark, path)), Path(path.removeprefix("file://"))
    plain.with_name(f".{plain.name}.crc").unlink()
    for field, value in (("dimensions", 0), ("count", 10), ("count", -1), ("format", 2), ("version", "x"), ("page_rows", 0), ("parts", None), ("extra", 1)):
        plain.write_text(json.dumps({**good, field: value}))
        with pytest.raises(InvalidInput):
            Corpus.load(spark, folder)
    plain.write_text(json.dumps(good)[:-5])
    with pytest.raises(InvalidInput):
        Corpus.load(spark, folder)
    with pytest.raises(InvalidInput):
        Corpus.load(spark, folder + "-none")
    with pytest.raises(OSError):
        write_text(spark, path, "a published file is never replaced")


def test_the_later_of_two_writers_conflicts(spark, folder):
    rows = hashed_rows(30, 4)
    Corpus.build(frame(spark, rows[:20]), 4).save(folder, 8)
    one, two = Corpus.load(spark, folder), Corpus.load(spark, folder)
    grown = one.append(frame(spark, rows[20:25]), id_col="id")
    for act in (lambda c: c.append(frame(spark, rows[25:]), id_col="id"), lambda c: c.update(frame(spark, rows[:2])), lambda c: c.compact()):
        with pytest.raises(Conflict):
            act(two)
    assert Corpus.load(spark, folder).version == grown.version and content(two) == plain(rows[:20])
    again = Corpus.load(spark, folder).append(frame(spark, rows[25:]), id_col="id")
    assert content(Corpus.load(spark, folder)) == content(again) == plain(rows)


def test_a_head_is_whole_or_not_there(spark, folder):
    """A writer that has only just created its head file hides no version, and no number is given twice."""
    saved = Corpus.build(frame(spark, hashed_rows(9, 3)), 3).save(folder)
    heads = Path(folder.removeprefix("file://")) / "heads"
    (heads / f"{2:020d}").write_text("")
    assert Corpus.load(spark, folder).version == saved.version
    grown = saved.append(frame(spark, hashed_rows(2, 3)), id_col="id")
    assert Corpus.load(spark, folder).version == grown.version and (heads / f"{3:020d}").exists()
    store = grown.store
    (heads / f"{4:020d}").write_text("x")  # between the check and the creation
    store.check_head = lambda parent: 4
    with pytest.raises(Conflict):
        grown.compact()


def test_updates_read_the_touched_pages_alone(spark, folder):
    base = Corpus.build(frame(spark, hashed_rows(64, 3)), 3).save(folder, page_rows=8)
    changed = base.update(frame(spark, hashed_rows(2, 3, 70), first=17))
    scan = changed.df.where("hv is not null")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(id,16)" in scan and "GreaterThanOrEqual(id,24)" in scan
    touched = in_pages(base.df, [2, 3, 6], 8)
    assert "GreaterThanOrEqual(id,16)" in touched._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in touched.collect()) == [*range(16, 32), *range(48, 56)]


def test_many_runs_of_pages_are_joined(spark, monkeypatch):
    monkeypatch.setattr(storage, "MAX_RANGES", 3)
    rows = spark.range(200)
    pages = [1, 2, 5, 7, 9, 11, 30]
    assert sorted(r.id for r in in_pages(rows, pages, 4).collect()) == [i for i in range(200) if i // 4 in pages]
    assert in_pages(rows, [], 4).count() == 0


@pytest.mark.parametrize("stored", [False, True])
def test_half_mutations(spark, folder, stored):
    rows = hashed_rows(30, 5)
    halves = lambda part: spark.createDataFrame([(i, bytearray(half_bytes(encode(r)[0].tolist()))) for i, r in part], "id long, v binary")
    base = Corpus.build(frame(spark, rows[:20]), 5)
    if stored:
        base = base.save(folder, 8)
    grown = base.append(halves(enumerate(rows[20:])), half=True, id_col="id")
    assert [(i, h) for i, h, _ in content(grown)] == [(i, h) for i, h, _ in plain(rows)]
    other = hashed_rows(3, 5, 400)
    changed = grown.update(halves(zip((0, 9, 29), other, strict=True)), half=True)
    expected = rows.copy()
    expected[[0, 9, 29]] = other
    assert [(i, h) for i, h, _ in content(changed)] == [(i, h) for i, h, _ in plain(expected)]
    for bad in (b"", b"\0" * 10, b"\0\x7c" * 5):
        with pytest.raises(PySparkException):
            content(changed.update(spark.createDataFrame([(0, bytearray(bad))], "id long, v binary"), half=True))


def test_handover(spark):
    small, large = (Corpus.build(frame(spark, hashed_rows(n, 3)), 3) for n in (7, 50))
    s = Searcher(small)
    s.set_corpus(large)
    assert len(s) == 50
    with pytest.raises(InvalidInput):
        s.set_corpus(Corpus.build(frame(spark, hashed_rows(3, 4)), 4))
    assert len(s) == 50
    s.set_corpus(small)
    assert len(s) == 7


def test_build_memory():
    assert (m := Corpus.build_memory(3, 1)).resident_bytes == 66_560 and m.peak_bytes == 67_080
    assert Corpus.build_memory(3, 257).resident_bytes == 133_120
    assert Corpus.build_memory(384, 0).peak_bytes == 0


def test_residency(spark):
    rows = spark.createDataFrame([(0, bytearray(half_bytes([0.0, 1.0, 0.0])))], "id long, v binary")
    made = []

    def source():
        made.append(1)
        return rows

    cache = Residency(3 * 67_080)
    with cache.lease(spark, "a", 3, 1, source) as first:
        with cache.lease(spark, "a", 3, 1, lambda: 1 / 0) as again:
            assert again is first
        assert cache.reserved_bytes == 66_560 and made == [1]
        with cache.lease(spark, "b", 3, 1, source), cache.lease(spark, "c", 3, 1, source), pytest.raises(InvalidInput), cache.lease(spark, "d", 3, 1, source):
            pass
    cache.pin(first)
    with cache.lease(spark, "d", 3, 1, source):
        assert cache.reserved_bytes == 3 * 66_560
    with cache.lease(spark, "a", 3, 1, lambda: 1 / 0) as still:
        assert still is first


def test_albums(spark):
    rows = hashed_rows(60, 3)
    c = Corpus.build(frame(spark, rows), 3)
    queries = [[1.0, 0, 0], [0, 1.0, 0]]
    albums = np.random.default_rng(9).integers(0, 5, 60).tolist()
    found = Searcher(c).search_batch(queries, 60)
    ordinals = spark.createDataFrame(list(enumerate(albums)), "id long, album long")
    best = best_per_group(found.select("qid", "id", found["similarity"].alias("score")), ordinals, spark.range(6).withColumnRenamed("id", "album"))
    got = {(r.qid, r.album): r.score for r in best.collect()}
    every = collect(found, 2)
    for q in range(2):
        assert got[q, 5] == float("-inf")
        for a in range(5):
            assert got[q, a] == max(n.similarity for n in every[q] if albums[n.id] == a)
    assert {r.album for r in top_groups(best, 6).collect()} == {0, 1, 2, 3, 4}
    page = [r.album for r in collapse(found, ordinals, 3).where("qid = 0").orderBy("slot").collect()]
    seen = list(dict.fromkeys(albums[n.id] for n in every[0]))[:3]
    assert page == seen


def test_streaming_appends(spark, folder, tmp_path):
    Corpus.build(frame(spark, hashed_rows(4, 3)), 3).save(folder)
    source = str(tmp_path / "in")
    frame(spark, hashed_rows(5, 3, 50)).select("v").write.parquet(source)
    stream = spark.readStream.schema("v array<float>").parquet(source)
    append_stream(stream, folder, str(tmp_path / "ck")).awaitTermination()
    grown = Corpus.load(spark, folder)
    assert len(grown) == 9
    # A batch that was appended, but not committed, comes again and changes nothing.
    for f in (tmp_path / "ck" / "commits").iterdir():
        f.unlink()
    append_stream(stream, folder, str(tmp_path / "ck")).awaitTermination()
    assert Corpus.load(spark, folder).version == grown.version
    frame(spark, hashed_rows(3, 3, 60)).select("v").write.mode("append").parquet(source)
    append_stream(stream, folder, str(tmp_path / "ck")).awaitTermination()
    assert len(Corpus.load(spark, folder)) == 12
