"""Vector arithmetic as column expressions, in double precision. Null vectors give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-9


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column) -> Column:
    """1 - cos, at least 0; 1 if a norm is below TINY."""
    n = norm(a) * norm(b)
    return F.when((norm(a) < TINY) | (norm(b) < TINY), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - dot(a, b) / n))


def normalized(a: Column) -> Column:
    return F.when(norm(a) > TINY, F.transform(a, lambda x: x / norm(a))).otherwise(a)


def checked(v: Column, dim: int) -> Column:
    """v, or an error if its length isn't dim."""
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"a vector needs {dim} values, not "), F.size(v).cast("string"))))
