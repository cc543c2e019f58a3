"""Every query with an oracle returns the oracle's rows."""

from __future__ import annotations

import os

import __spark_entry__ as entry
import duckdb
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["qid", "rk", "id", "similarity"] and df.count() == 40


def test_oracles_belong_to_queries():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    expected = sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == expected
