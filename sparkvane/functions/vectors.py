"""Vector arithmetic as higher-order functions: row-local, in order, in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .half import round_half


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, wherever body has it.

    Catalyst inlines a column into the lambda that mentions it, where it would
    be computed for every element; a lambda variable stays what it is.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def sum_of_squares(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def l2_norm(v: Column) -> Column:
    return F.sqrt(sum_of_squares(v))


def dot(a: Column, b: Column) -> Column:
    return fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def component_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def is_valid(v: Column, dimensions: int) -> Column:
    """A row of the right length with finite components and a direction."""
    total = sum_of_squares(v)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dimensions) & finite & (total > 0) & (total < float("inf")), F.lit(False))


def quantized(v: Column) -> Column:
    """Unit vector rounded to binary16, as exact floats."""
    return let(l2_norm(v), lambda norm: F.transform(v, lambda x: let(x.cast("double") / norm, round_half).cast("float")))


def inverse_norm(hv: Column) -> Column:
    return (F.lit(1.0) / l2_norm(hv)).cast("float")


def unit_query(v: Column, half: bool) -> Column:
    """A query as the scan takes it: normalized to float, and to binary16 in a batch."""
    one = let(l2_norm(v), lambda norm: F.transform(v, lambda x: (x.cast("double") / norm).cast("float")))
    return F.transform(one, lambda x: let(x.cast("double"), round_half).cast("float")) if half else one


def scaled(v: Column, factor: Column) -> Column:
    """Every component times the factor; a product of two floats is exact in double."""
    return let(factor.cast("double"), lambda f: F.transform(v, lambda x: (x.cast("double") * f).cast("float")))


def cosine(hv: Column, inv_norm: Column, q: Column) -> Column:
    return (dot(hv, q) * inv_norm.cast("double")).cast("float")


def ranks(score: Column) -> Column:
    """Scores that can be returned: neither NaN nor minus infinity."""
    return score.isNotNull() & ~F.isnan(score) & (score > float("-inf"))
