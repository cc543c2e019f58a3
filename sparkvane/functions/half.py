"""Binary16 without a native type: exact values are held as floats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import ship

LEAST_NORMAL = 2.0**-14
OVERFLOW = 65_520.0  # rounds to infinity from here on


def round_half(x: Column) -> Column:
    """The nearest binary16 value of a double, ties to even, as a double.

    Powers of two are exact, so scaling to an integer, ``rint`` and scaling
    back round once.  Values that reach the overflow bound become infinite.
    """
    size = F.abs(x)
    unit = F.pow(F.lit(2.0), F.floor(F.log2(size)) - 10)
    normal = F.rint(x / unit) * unit
    tiny = F.rint(x * 2.0**24) * 2.0**-24
    return (
        F.when(x == 0, x)
        .when(size >= OVERFLOW, F.signum(x) * float("inf"))
        .when(size < LEAST_NORMAL, tiny)
        .otherwise(normal)
    )


def half_bytes(values: list[float]) -> bytes:
    """Little-endian binary16 bytes of a row."""
    return np.asarray(values, "<f2").tobytes()


def from_half_bytes(rows: DataFrame) -> DataFrame:
    """(id, v) with v from little-endian binary16 bytes to floats; an odd byte count gives null.

    A pass of its own, not an expression: expressions around it are inlined
    into lambdas, where Python cannot run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [None if x is None or len(x) % 2 else np.frombuffer(x, "<f2").astype(np.float32) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.list_(pa.float32()))], ["id", "v"])

    ship(rows.sparkSession)
    return rows.select("id", "v").mapInArrow(run, "id long, v array<float>")


def to_half_bytes(rows: DataFrame) -> DataFrame:
    """(id, v) with v from floats to little-endian binary16 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [None if x is None else half_bytes(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.binary())], ["id", "v"])

    ship(rows.sparkSession)
    return rows.select("id", "v").mapInArrow(run, "id long, v binary")
