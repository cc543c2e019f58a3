"""Top-k of any scores, in the one order there is: score descending, then ID."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import ranks
from ..limits import MAX_K, InvalidInput, check_k

_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"


def allow_group_limits(spark, k: int) -> None:
    """Let Spark prune groups of k rows before the shuffle; its own limit is enough for all but the largest k."""
    if int(spark.conf.get(_LIMIT_CONF)) < k:
        spark.conf.set(_LIMIT_CONF, str(MAX_K))


def top_k(scores: DataFrame, k: int, group: str | None = "qid", item: str = "id", score: str = "score", rank: str = "rk") -> DataFrame:
    """The k best items of each group, with their rank from 1.

    NaN and minus infinity are absent, plus infinity ranks first, zeros of either
    sign tie.  With a group Spark keeps k rows of each group on both sides of the
    one shuffle; without one it is a top-k over partitions.
    """
    check_k(k)
    rows = scores.where(ranks(F.col(score)))
    order = [F.col(score).desc(), F.col(item)]
    if group is None:
        best = rows.orderBy(*order).limit(k)
        return best.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias(rank), *best.columns)
    allow_group_limits(scores.sparkSession, k)
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))
    return ranked.where(F.col(rank) <= k)


def score_batch(values: DataFrame, columns: int, qid: str = "qid", scores: str = "scores") -> DataFrame:
    """A score matrix, a row of scores for each query, as long rows (qid, id, score)."""
    if not 1 <= columns <= 1 << 30:
        raise InvalidInput("a score batch has 1..=2^30 columns")
    whole = F.when(F.size(scores) == columns, F.col(scores)).otherwise(F.raise_error(F.lit("a score row has the wrong length")))
    return values.select(qid, F.posexplode(whole).alias("id", "score")).withColumn("id", F.col("id").cast("long"))
