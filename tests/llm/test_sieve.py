from __future__ import annotations

from pyspark.sql import functions as F

from sparkvane.llm import _sieve


def test_nothing_of_the_set_is_missed(spark, docs):
    rows = docs([(i, str(i)) for i in range(4000)] + [(None, "x"), (None, "y")])
    ids = spark.range(0, 4000, 7).select(F.col("id").alias("i")).unionByName(spark.range(1).select(F.lit(None).cast("long").alias("i")))
    inside, outside = _sieve.split(rows, F.col("doc_id"), ids, "i", 600)
    a, b = [r.doc_id for r in inside.collect()], [r.doc_id for r in outside.collect()]
    assert len(a) + len(b) == 4002 and {*range(0, 4000, 7), None} <= set(a) and len(a) < 1000
    assert inside.columns == outside.columns == rows.columns


def test_full_filters_let_all_through(spark, docs, monkeypatch):
    monkeypatch.setattr(_sieve, "BITMAP_BITS", 32_768)
    monkeypatch.setattr(_sieve, "MAX_BITS", 32_768)
    rows = docs([(i, "t") for i in range(100)])
    inside, _ = _sieve.split(rows, F.col("doc_id"), spark.range(400_000).select(F.col("id").alias("i")), "i", 400_000)
    assert inside.count() == 100
    inside, outside = _sieve.split(rows, F.col("doc_id"), spark.range(0).select(F.col("id").alias("i")), "i", 0)
    assert inside.count() == 0 and outside.count() == 100
