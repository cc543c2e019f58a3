"""Connected components of a link table, by alternating stars.

Every round hangs each node's neighbours on its smallest one, first the larger
ones, then the smaller ones, until the links are stars around each component's
smallest node.  Minima are aggregated before they are shuffled and no
adjacency list is ever gathered, so a node may have any number of links.  Each
round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _runtime as rt


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("b"), F.col("m").alias("a")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("w"), "m")
    moved = links.join(least, F.col("b") == F.col("w")).where("a <> m").select(F.col("a").alias("b"), F.col("m").alias("a"))
    return moved.unionByName(least.select(F.col("w").alias("b"), F.col("m").alias("a"))).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of links (a, b); the component is its least node.

    Links from a node to itself and repeated links are fine; nulls are not.
    """
    state = rt.materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        last, state = state, rt.materialize(_small_star(_large_star(state)).select("a", "b"), "stars")
        rt.drop(last)
        mark = tuple(state.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.hash("b", "a").cast("long"))).first())
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    roots = state.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return state.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
