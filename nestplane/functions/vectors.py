"""Vector arithmetic on ``ARRAY<DOUBLE>`` columns, built from Spark's own higher-order functions.

Everything here stays in the JVM.  Arrays of different length give NULL, never a shortened answer,
because ``zip_with`` pads the shorter side with NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def total(x: Column) -> Column:
    """Sum of the entries."""
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def mean(x: Column) -> Column:
    """Mean of the entries; NULL for an empty array."""
    return F.when(F.size(x) > 0, total(x) / F.size(x))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: p * q))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def norm(x: Column) -> Column:
    return F.sqrt(total(F.transform(x, lambda v: v * v)))


def scale(x: Column, factor: float | Column) -> Column:
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(x, lambda v: v * factor)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p + q)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p - q)


def shift(x: Column, amount: Column) -> Column:
    """Subtract one number from every entry."""
    return F.transform(x, lambda v: v - amount)


def trace_of_product(a: Column, b: Column) -> Column:
    """``tr(A B^T)`` of two matrices given as arrays of rows; rows without a partner count zero."""
    return total(F.zip_with(a, b, lambda p, q: F.coalesce(dot(p, q), F.lit(0.0))))


def to_long(df, key: str = "row", x: str = "x", extra: tuple[str, ...] = ()):
    """Explode ``(key, x)`` to ``(key, dim, value)`` with ``dim`` counted from 1."""
    return df.select(*extra, key, F.posexplode(x).alias("pos", "value")).select(
        *extra, key, (F.col("pos") + 1).cast("int").alias("dim"), "value"
    )
