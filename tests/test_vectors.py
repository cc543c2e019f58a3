from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkvane.functions.half import from_half_bytes, half_bytes, round_half, to_half_bytes
from sparkvane.functions.vectors import is_valid, ranks


def test_rounding_is_numpys(spark):
    every = np.arange(0, 0x7C00, 7, dtype=np.uint16).view(np.float16).astype(np.float64)
    between = (every[:-1] + every[1:]) / 2
    more = np.concatenate([every, between, np.nextafter(between, 0), np.nextafter(between, 9e9), [65503.0, 65519.9, 65520.0, 1e9, 2**-25, 2**-24]])
    x = np.concatenate([more, -more])
    got = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double").select("i", round_half(F.col("x")).alias("h")).orderBy("i").collect()
    with np.errstate(over="ignore"):
        assert np.array_equal(np.array([r.h for r in got]), x.astype(np.float16).astype(np.float64))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-60000, 60000), min_size=1, max_size=20))
def test_half_bytes_are_two_a_value(values):
    raw = half_bytes(values)
    assert len(raw) == 2 * len(values)
    assert np.array_equal(np.frombuffer(raw, "<f2"), np.array(values).astype(np.float16))


def test_byte_codec_keeps_bits(spark):
    words = np.array([0x4200, 0xC400, 0x8000, 0x0001, 0x7BFF], "<u2").tobytes()
    rows = spark.createDataFrame([(0, bytearray(words)), (1, bytearray(b"abc")), (2, None)], "id long, v binary")
    back = {r.id: r.v for r in to_half_bytes(from_half_bytes(rows)).collect()}
    assert bytes(back[0]) == words and back[1] is None and back[2] is None


def test_validity(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [1.0]), (5, None), (6, [None, 1.0]), (7, [2.0**-149, 0.0])]
    got = spark.createDataFrame(rows, "i long, v array<float>").select("i", is_valid(F.col("v"), 2).alias("ok")).collect()
    assert {r.i for r in got if r.ok} == {0, 7}


def test_what_ranks(spark):
    rows = [(0, float("nan")), (1, float("-inf")), (2, float("inf")), (3, -0.0), (4, None)]
    got = spark.createDataFrame(rows, "i long, s float").where(ranks(F.col("s"))).collect()
    assert {r.i for r in got} == {2, 3}
