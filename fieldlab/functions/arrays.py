"""Array expressions evaluated once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

DOUBLES = ArrayType(DoubleType())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once.

    The optimizer merges projections, so a computed column that a lambda captures would be computed again for every element.
    As the argument of a one-element transform it is bound instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mean_of(values: Column) -> Column:
    return let(values, lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a))


def moments_of(values: Column) -> Column:
    """struct(mean, std) of an array, population standard deviation."""

    def both(a: Column) -> Column:
        mean = F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
        return let(
            mean,
            lambda m: F.struct(
                m.alias("mean"),
                F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.size(a)).alias("std"),
            ),
        )

    return let(values, both)


def indices(n: Column) -> Column:
    """0 .. n-1; empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
