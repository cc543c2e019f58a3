"""Rows into corpus form: validation, encoding, dense insertion IDs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.half import from_half_bytes
from ..functions.vectors import inverse_norm, is_valid, quantized
from ..limits import InvalidInput, check_dimensions, check_rows, padded
from .scratch import scratch_path

CORPUS = "id long, hv array<float>, inv_norm float"


def with_ids(rows: DataFrame, first: int = 0) -> tuple[DataFrame, int]:
    """rows with a dense ``id`` from ``first`` on, in partition order, and their count.

    Rows are written to the shared folder with their partition and place in it,
    so nothing that is recomputed or lost later can move them.  Then partitions
    are counted, and each one's offset is added to the places.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "rows")
    placed = rows.withColumn("__at", F.monotonically_increasing_id())
    placed.write.parquet(path)
    numbered = spark.read.schema(placed.schema).parquet(path)
    part = F.shiftright("__at", 33)
    counts = numbered.groupBy(part.alias("p")).count().orderBy("p").collect()  # a row for each partition
    bases, at = [], first
    for r in counts:
        bases.append((r.p, at))
        at += r["count"]
    base = spark.createDataFrame(bases, "__p long, __base long")
    place = F.col("__at").bitwiseAND((1 << 33) - 1)
    out = numbered.join(F.broadcast(base), part == F.col("__p")).select((F.col("__base") + place).alias("id"), *rows.columns)
    return out, at - first


def check_ids(rows: DataFrame, first: int = 0) -> int:
    """The number of rows, whose ids must be first, first + 1, ... in any order.

    Sums of 64-bit hashes stand for the two sets of ids, so nothing is shuffled
    but one row from each partition.
    """
    hashes = F.sum(F.xxhash64("id").cast("decimal(20,0)"))
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.count("id").alias("known"), F.min("id").alias("low"), F.max("id").alias("high"), hashes.alias("mark")).first()
    if r.n:
        if (r.known, r.low, r.high) != (r.n, first, first + r.n - 1):
            raise InvalidInput("row IDs must be dense")
        if rows.sparkSession.range(first, first + r.n).agg(hashes.alias("mark")).first().mark != r.mark:
            raise InvalidInput("row IDs must be dense and distinct")
    return check_rows(r.n)


def _checked(valid: Column, value: Column) -> Column:
    return F.when(valid, value).otherwise(F.raise_error(F.lit("a row must have finite components, the right length and a direction")))


def encode(rows: DataFrame, dimensions: int) -> DataFrame:
    """(id, v ARRAY<FLOAT>) normalized and rounded to binary16."""
    check_dimensions(dimensions)
    v = F.col("v")
    return _finish(rows.select("id", _checked(is_valid(v, dimensions), quantized(v)).alias("hv")))


def encode_half(rows: DataFrame, dimensions: int) -> DataFrame:
    """(id, v) of binary16 rows, as bytes or as exact floats; components stay as they are."""
    check_dimensions(dimensions)
    if dict(rows.dtypes)["v"] == "binary":
        rows = from_half_bytes(rows.select("id", F.when(F.length("v") == 2 * dimensions, F.col("v")).alias("v")))
    return _finish(rows.select("id", _checked(is_valid(F.col("v"), dimensions), F.col("v").cast("array<float>")).alias("hv")))


def _finish(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").cast("long").alias("id"), "hv", inverse_norm(F.col("hv")).alias("inv_norm"))


def bad_padded_rows(rows: DataFrame, dimensions: int) -> DataFrame:
    """(bad_rows): rows (id, v) of padded vectors that are not finite, have no direction, or are not zero past dimensions."""
    width, v = padded(dimensions), F.col("v")
    rest = F.exists(F.slice(v, dimensions + 1, width), lambda x: x.isNull() | F.isnan(x) | (x != 0))
    good = F.coalesce((F.size(v) == width) & ~rest & is_valid(F.slice(v, 1, dimensions), dimensions), F.lit(False))
    return rows.agg(F.count_if(~good).alias("bad_rows"))


def adopt(shards: list[DataFrame], dimensions: int, spark) -> tuple[DataFrame, int]:
    """Padded matrices, in list order, as corpus rows and their count.

    Each shard has (pos, v); its positions are 0, 1, ... and it has rows.
    """
    check_dimensions(dimensions)
    at, parts = 0, []
    for s in shards:
        n = check_ids(s.select(F.col("pos").alias("id")))
        if not n:
            raise InvalidInput("a shard has no rows")
        if bad_padded_rows(s, dimensions).first().bad_rows:
            raise InvalidInput("a shard has invalid rows or padding that is not zero")
        parts.append(s.select((F.col("pos") + at).alias("id"), F.slice("v", 1, dimensions).alias("v")))
        at += n
    if not parts:
        return spark.createDataFrame([], CORPUS), 0
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return encode_half(rows, dimensions), check_rows(at)
