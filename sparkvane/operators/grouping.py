"""Scores reduced by a side array: best of each group, greedy collapse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import ranks
from .ranking import top_k


def best_per_group(scores: DataFrame, ordinals: DataFrame, groups: DataFrame, group: str = "album", queries: DataFrame | None = None) -> DataFrame:
    """(qid, group, score): every query's best score in every group.

    scores has (qid, id, score), ordinals (id, group), groups (group).  A group
    without rows scores minus infinity.  Maxima are combined before the shuffle;
    the grid has one row for each query and group that is asked for.
    """
    best = scores.where(ranks(F.col("score"))).join(ordinals, "id").groupBy("qid", group).agg(F.max("score").alias("score"))
    asked = (queries if queries is not None else scores.select("qid").distinct()).select("qid").distinct()
    grid = asked.crossJoin(groups.select(group).distinct())
    return grid.join(best, ["qid", group], "left").select("qid", group, F.coalesce("score", F.lit(float("-inf")).cast("float")).alias("score"))


def top_groups(best: DataFrame, k: int, group: str = "album") -> DataFrame:
    """The k best groups of each query; empty groups are not returned."""
    return top_k(best, k, item=group)


def collapse(neighbors: DataFrame, ordinals: DataFrame, page: int, group: str = "album") -> DataFrame:
    """The best candidate of each group, in rank order, first ``page`` of each query.

    Only the candidates are looked at, so a page can be short.
    """
    w = Window.partitionBy("qid", group).orderBy("rk")
    first = neighbors.join(ordinals, "id").withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")
    slot = F.row_number().over(Window.partitionBy("qid").orderBy("rk")).cast("long")
    return first.withColumn("slot", slot).where(F.col("slot") <= page)
