from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkvane.llm import piece_codec, token_files
from sparkvane.llm import transport_stream as ts

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "ab c  d.e,\n\t'éß中𝔘▁_1 2ThE'lĺ\x1c İſK<|²½"
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
TABLE = piece_codec.load(PIECES)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(ALPHABET), max_size=50))
def test_pieces_equal_the_library(text):
    ids = LIBRARY.encode(text)
    assert TABLE.encode(text).tolist() == ids and TABLE.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text_equals_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = LIBRARY.encode(text)
    assert TABLE.encode(text).tolist() == ids and TABLE.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 600), max_size=14))
def test_any_ids_decode_as_the_library_does(ids):
    assert TABLE.decode(ids) == LIBRARY.decode(ids)


def test_space_runs():
    for k in range(40):
        for text in (" " * k, " " * k + "x", "x" + " " * k, "a" + " " * k + "\t", "a" + " " * k + "b" + " " * (k // 2)):
            assert TABLE.encode(text).tolist() == LIBRARY.encode(text)


def test_full_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(piece_codec, "MAX_SEGMENTS", 5)
    monkeypatch.setattr(piece_codec, "MAX_PAIRS", 5)
    table = piece_codec.PieceTable(PIECES)
    for text in ("every word in this text is another one and none repeats", "antidisestablishmentarianism" * 3):
        assert table.encode(text).tolist() == LIBRARY.encode(text)


def test_piece_frames(docs, odd_texts):
    df = docs([*enumerate(odd_texts), (None, "no id"), (1, "")])
    rows = sorted((str(r.doc_id), r.ids, r.decoded) for r in piece_codec.round_trip(df, PIECES).collect())
    want = [(str(i), ids := LIBRARY.encode(t or ""), LIBRARY.decode(ids)) for i, t in [*enumerate(odd_texts), (None, "no id"), (1, "")]]
    assert rows == sorted(want)
    apart = piece_codec.decode(piece_codec.encode(df, PIECES), PIECES)
    assert sorted(r.text for r in apart.collect()) == sorted(d for *_, d in want)
    assert piece_codec.round_trip(df.limit(0), PIECES).count() == 0


def test_parts_equal_the_library(odd_texts):
    encoder, lib = token_files.PartEncoder(WORDS), Tokenizer.from_file(WORDS)
    rng = random.Random(4)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice(" '.,-sdltrevm1²éÉÀß\xa0\x85\xad×÷ªº") for _ in range(30)) for _ in range(1500)]
    texts += ["<|endoftext|> x", "a <|startoftext|>b", *(t or "" for t in odd_texts)]
    for _ in range(2):  # from scratch, then from memory
        got = encoder.encode(texts)
        for t, g, e in zip(texts, got, lib.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(g, np.int32).tolist() == e.ids, t


def test_counts():
    texts = ["", "one two, three!", "中文 text"]
    lib = Tokenizer.from_file(WORDS)
    assert token_files.counter(WORDS)(texts) == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_token_files(spark, docs, odd_texts, tmp_path, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = [*((10 * i, t) for i, t in enumerate(odd_texts)), *((5, f"five {k}") for k in range(40)), *((None, f"null id {k}") for k in range(60)), (5, "five 0"), (-(2**40), "x")]
        path = f"file://{tmp_path}/tokens"
        token_files.write(docs(rows), path, WORDS)
        got = sorted((r.start, r.n_tokens, str(r.doc_id), r.ids_crc32) for r in token_files.digests(token_files.read(spark, path)).collect())
        lib, at, want = Tokenizer.from_file(WORDS), 0, []
        for i, t in rows:
            ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
            want.append((str(i), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        assert sorted((i, n, c) for _, n, i, c in got) == sorted(want)
        for start, n, *_ in got:
            assert start == at
            at += n
        order = [-(2**63) if i == "None" else int(i) for _, _, i, _ in got]
        assert order == sorted(order)
        if parts == 23:  # an id that fills several ranges is not in one file
            files = spark.read.schema(token_files.FILE).orc(path).where("doc_id is null").select("_metadata.file_name").distinct().count()
            assert files > 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_ranges_are_looked_up_in_order(spark):
    bounds = sorted(random.Random(3).choices(range(-50, 50), k=40))
    ids = spark.range(-60, 60).select("id", F.lit(0).alias("zero"), F.lit(token_files._SPREAD - 1).alias("last"))
    for r in ids.select("id", token_files._place(bounds, F.col("id"), F.col("zero")).alias("a"), token_files._place(bounds, F.col("id"), F.col("last")).alias("b")).collect():
        assert (r.a, r.b) == (sum(b < r.id for b in bounds), sum(b <= r.id for b in bounds))


def test_files_are_ordered_by_part_number(spark):
    """Above 100,000 files names do not sort as the files were written."""
    names = spark.range(99_990, 100_101).select(F.format_string("part-%05d-6f0e-c000.zstd.orc", "id").alias("name"), "id")
    assert [r.id for r in names.orderBy("name").collect()] != [r.id for r in names.orderBy("id").collect()]
    assert [r.id for r in names.orderBy(token_files.part_number(F.col("name"))).collect()] == list(range(99_990, 100_101))


def test_token_files_of_nothing(spark, docs, tmp_path):
    path = f"file://{tmp_path}/none"
    token_files.write(docs([]), path, WORDS)
    assert token_files.digests(token_files.read(spark, path)).count() == 0


def _scanned(df) -> int:
    """Rows that the file scan of a plan without a shuffle gave."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_token_files_prune(spark, docs, tmp_path):
    """Row indexes and Bloom filters on doc_id keep a scan from rows it need not read."""
    path, n = f"file://{tmp_path}/pruned", 12_000
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        token_files.write(docs([(2 * i, f"text {i}") for i in range(n)]), path, WORDS)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = spark.read.schema(token_files.FILE).orc(path)
    assert _scanned(rows.select("doc_id")) == n
    assert 0 < _scanned(rows.where("doc_id = 4000").select("doc_id")) <= token_files.INDEX_STRIDE
    # Odd ids lie within the indexes' ranges; only a Bloom filter knows that they are absent.
    assert sum(_scanned(rows.where(f"doc_id = {4001 + 2 * k}").select("doc_id")) == 0 for k in range(5)) >= 4
    import glob

    import pyarrow.orc as orc

    (file,) = [orc.ORCFile(f) for f in glob.glob(f"{tmp_path}/pruned/*.orc")]
    assert (file.row_index_stride, file.compression, file.nrows) == (token_files.INDEX_STRIDE, "ZSTD", n)


def test_options_of_the_session_stay(spark, docs, tmp_path):
    before = dict(spark.conf.getAll)
    token_files.write(docs([(1, "a")]), f"file://{tmp_path}/t", WORDS)
    token_files.read(spark, f"file://{tmp_path}/t").collect()
    piece_codec.round_trip(docs([(1, "a")]), PIECES).collect()
    assert dict(spark.conf.getAll) == before


@settings(max_examples=120, deadline=None)
@given(st.binary(max_size=700))
def test_streams_round_trip(raw):
    payload = ts.pad(raw)
    assert len(payload) % 64 == 0 and payload and payload.startswith(raw) and not payload[len(raw) :].strip(b"\0")
    x = ts.demux(ts.mux(payload))
    assert x.payload == payload and x.discontinuities == x.duplicates == 0 and x.stream_type == 6


@pytest.mark.parametrize("size", [64, 128, 16_384, 16_448, 16_384 * 8, 16_384 * 9 + 64, 3_000_000 // 64 * 64])
def test_stream_structure(size):
    payload = np.random.default_rng(size).integers(0, 256, size, np.uint8).tobytes()
    stream = ts.mux(payload)
    x = ts.demux(stream)
    units = -(-size // ts.UNIT_BYTES)
    assert x.payload == payload and len(stream) % 188 == 0
    assert x.pts == [(k + 1) * 3600 for k in range(units)]
    assert [t for _, t in x.access_points] == x.pts[:: ts.ACCESS_EVERY]
    for packet, _ in x.access_points:  # an access point has the flag, a clock and a PES header
        at = packet * 188
        assert stream[at + 5] & 0x50 == 0x50 and stream[at + 12 : at + 15] == b"\0\0\1" or size == 64 or stream[at + 1] & 0x40


def test_stream_faults():
    stream = ts.mux(bytes(range(256)) * 200)
    cut = stream[: 188 * 20] + stream[188 * 23 :]
    with_gap = ts.demux(cut)
    assert with_gap.discontinuities == 1
    twice = stream[: 188 * 21] + stream[188 * 20 : 188 * 21] + stream[188 * 21 :]
    assert ts.demux(twice).duplicates == 1 and ts.demux(twice).payload == ts.demux(stream).payload
    broken_table = bytearray(stream)
    broken_table[12] ^= 1
    for bad in (b"", stream[:-1], b"x" + stream[1:], bytes(broken_table), stream[188:]):
        with pytest.raises(ValueError):
            ts.demux(bad)


def test_media_frames(docs, odd_texts):
    rows = [*enumerate(odd_texts), (None, "no id"), (77, "same"), (78, "same")]
    df = docs(rows)
    got = {r.doc_id: r for r in ts.round_trip(df).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = ts.pad(raw)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_bytes % 188 == 0
    assert got[77].asDict() | {"doc_id": 0} == got[78].asDict() | {"doc_id": 0}
    apart = {r.doc_id: r for r in ts.inspect(ts.store(df)).collect()}
    assert apart == got
    assert ts.round_trip(df.limit(0)).count() == 0
