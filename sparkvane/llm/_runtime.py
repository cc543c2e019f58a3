"""What the operators share about running on a cluster: shared folders, Arrow
batch sizes, and streaming over sorted partitions."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import discard, scratch_path
from ..sources.shipping import ship

#: Rows and bytes that a Python worker takes at a time; whatever a text's length, it
#: holds one of Spark's Arrow batches and what it makes of such a slice.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Make the package importable on executors; the session's options stay as they are."""
    ship(spark)


def small(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded rows and bytes; a row above the bound is a slice."""
    for b in batches:
        if b.num_rows <= rows and b.nbytes <= size:
            yield b
            continue
        weight = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            for wide, kinds in ((np.int32, ("string", "binary", "list")), (np.int64, ("large_string", "large_binary", "large_list"))):
                if any(getattr(pa.types, f"is_{k}")(c.type) for k in kinds):
                    ends = np.frombuffer(c.buffers()[1], wide, len(c) + 1, c.offset * np.dtype(wide).itemsize)
                    weight += np.diff(ends) * (8 if kinds[2] in str(c.type) else 1)
        ends, at = np.cumsum(weight), 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            n = max(1, min(rows, int(np.searchsorted(ends, before + size, side="right")) - at))
            yield b.slice(at, n)
            at += n


_open = threading.local()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized inside, in this thread, go when the block ends."""
    blocks = _open.__dict__.setdefault("blocks", [])
    blocks.append([])
    try:
        yield
    finally:
        for path in blocks.pop():
            discard(spark, path)


def materialize(df: DataFrame, label: str, inside: bool = True) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a
    lost executor costs nothing that was done before.

    The table goes with the enclosing ``passing`` block, or with the one around
    that if inside is false.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    blocks = getattr(_open, "blocks", [])
    if len(blocks) > (not inside):
        blocks[-1 if inside else -2].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sparkvane_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete a materialized table whose successor is written."""
    path = getattr(df, "_sparkvane_path", None)
    if path:
        discard(df.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df does not have, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def texts(column: pa.Array) -> list[str]:
    """Python strings; null is the empty text."""
    return [t or "" for t in column.to_pylist()]


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal (non-null, integer) keys of a sorted partition, one table each."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(int(c[0]) for c in cols)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(int(c[-1]) for c in cols)
    if held:
        yield pa.Table.from_batches(held)
