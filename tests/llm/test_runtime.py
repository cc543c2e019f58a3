from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from sparkvane.llm import _runtime as rt


def batch(rng, rows):
    texts = ["x" * int(n) for n in rng.integers(0, 50, rows)]
    if rows:
        texts[rows // 2] = None
    lists = [list(range(int(n))) for n in rng.integers(0, 9, rows)]
    return pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int64()), pa.array(texts, pa.string()), pa.array(lists, pa.list_(pa.int32())), pa.array(texts, pa.large_string())], ["id", "text", "ids", "wide"])


@pytest.mark.parametrize("rows", [0, 1, 7, 500])
@pytest.mark.parametrize("size", [1, 60, 1 << 20])
def test_slices_are_bounded_and_whole(rows, size):
    rng = np.random.default_rng(rows)
    whole = batch(rng, rows + 3).slice(2, rows)  # with an offset, as a slice of another batch has
    parts = list(rt.small(iter([whole]), rows=16, size=size))
    assert pa.Table.from_batches(parts, whole.schema).to_pylist() == whole.to_pylist()
    for p in parts:
        assert p.num_rows <= 16
        weight = sum(2 * len(r["text"] or "") + 8 * len(r["ids"]) for r in p.to_pylist())
        assert weight <= size or p.num_rows == 1 or p.num_rows == rows


def test_tables_of_a_block_go_with_it(spark):
    with rt.passing(spark):
        inner = rt.materialize(spark.range(5), "inner")
        kept = rt.materialize(spark.range(7), "kept", inside=False)
        with rt.passing(spark):
            nested = rt.materialize(spark.range(3), "nested")
            there = [Path(x._sparkvane_path.removeprefix("file:")).exists() for x in (inner, kept, nested)]
        assert all(there) and inner.count() == 5 and not Path(nested._sparkvane_path.removeprefix("file:")).exists()
    assert kept.count() == 7 and not Path(inner._sparkvane_path.removeprefix("file:")).exists()
    rt.drop(kept)
    rt.drop(spark.range(1))
    rt.drop(None)
    assert not Path(kept._sparkvane_path.removeprefix("file:")).exists()
