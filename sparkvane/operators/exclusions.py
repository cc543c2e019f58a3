"""Sets of excluded row IDs: immutable frames behind a small mutable handle."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..limits import check_excluded, check_rows

#: IDs (8 bytes each) up to which a set is broadcast; larger ones are joined by shuffle.
BROADCAST_IDS = 1 << 20


def ids_frame(spark: SparkSession, ids: Iterable[int]) -> DataFrame:
    return spark.createDataFrame([(int(i),) for i in ids], "id long")


def without(rows: DataFrame, excluded: DataFrame | None, size: int | None = None) -> DataFrame:
    """rows whose id is not excluded; the set is broadcast only if its size is known to be small."""
    if excluded is None:
        return rows
    return rows.join(F.broadcast(excluded) if size is not None and size <= BROADCAST_IDS else excluded, "id", "left_anti")


class Exclusions:
    """A set over IDs 0..rows-1."""

    def __init__(self, spark: SparkSession, rows: int):
        self.rows = check_rows(rows)
        self._spark = spark
        self.df = ids_frame(spark, [])

    def __len__(self) -> int:
        """Excluded IDs."""
        return self.df.count()

    @property
    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def memory_usage(self) -> int:
        """Bytes of the bitmap that the set stands for: one bit a row in 32-bit words."""
        return -(-self.rows // 32) * 4

    def clear(self) -> None:
        self.df = ids_frame(self._spark, [])

    def insert(self, ids: Iterable[int]) -> None:
        """Add IDs; any outside the range raises before the set changes."""
        self._union(ids_frame(self._spark, check_excluded(ids, self.rows)))

    def remove(self, ids: Iterable[int]) -> None:
        self.df = without(self.df, ids_frame(self._spark, listed := check_excluded(ids, self.rows)), len(listed))

    def insert_frame(self, ids: DataFrame) -> None:
        """Add the IDs of a frame; those outside the range are ignored."""
        self._union(ids.select(F.col("id").cast("long")).where(f"id >= 0 and id < {self.rows}"))

    def remove_frame(self, ids: DataFrame) -> None:
        self.df = without(self.df, ids.select(F.col("id").cast("long")))

    def _union(self, ids: DataFrame) -> None:
        self.df = self.df.unionByName(ids).distinct()
