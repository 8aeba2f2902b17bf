"""Similarities of two vector columns. Every value is a similarity: distances are negated.

All are plain column expressions. What has no value (a zero norm, an empty sum) is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MINKOWSKI_P = 1.3


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def pairwise(u: Column, v: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(u, v, f)


def _negative(x: Column) -> Column:
    return F.lit(0.0) - x  # never a negative zero


def norm(u: Column) -> Column:
    return F.sqrt(total(F.transform(u, lambda x: x * x)))


def normalise(u: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(u)
    return F.when(n > 0, F.transform(u, lambda x: x / n)).otherwise(u)


def centre(u: Column) -> Column:
    mean = total(u) / F.size(u)
    return F.transform(u, lambda x: x - mean)


def dot(u: Column, v: Column) -> Column:
    return total(pairwise(u, v, lambda x, y: x * y))


def cosine(u: Column, v: Column) -> Column:
    return F.try_divide(dot(u, v), norm(u) * norm(v))


def sqeuclidean(u: Column, v: Column) -> Column:
    return _negative(total(pairwise(u, v, lambda x, y: (x - y) * (x - y))))


def euclidean(u: Column, v: Column) -> Column:
    return _negative(F.sqrt(total(pairwise(u, v, lambda x, y: (x - y) * (x - y)))))


def manhattan(u: Column, v: Column) -> Column:
    return _negative(total(pairwise(u, v, lambda x, y: F.abs(x - y))))


def braycurtis(u: Column, v: Column) -> Column:
    above = total(pairwise(u, v, lambda x, y: F.abs(x - y)))
    return _negative(F.try_divide(above, total(pairwise(u, v, lambda x, y: F.abs(x + y)))))


def canberra(u: Column, v: Column) -> Column:
    part = lambda x, y: F.coalesce(F.try_divide(F.abs(x - y), F.abs(x) + F.abs(y)), F.lit(0.0))
    return _negative(total(pairwise(u, v, part)))


def chebyshev(u: Column, v: Column) -> Column:
    return _negative(F.array_max(pairwise(u, v, lambda x, y: F.abs(x - y))))


def correlation(u: Column, v: Column) -> Column:
    return cosine(centre(u), centre(v))


def minkowski(u: Column, v: Column) -> Column:
    powers = pairwise(u, v, lambda x, y: F.pow(F.abs(x - y), F.lit(MINKOWSKI_P)))
    return _negative(F.pow(total(powers), F.lit(1 / MINKOWSKI_P)))


#: Metrics of the vectors alone.
METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "cosine": cosine,
    "euclidean": euclidean,
    "dot": dot,
    "manhattan": manhattan,
    "braycurtis": braycurtis,
    "canberra": canberra,
    "chebyshev": chebyshev,
    "correlation": correlation,
    "minkowski": minkowski,
    "sqeuclidean": sqeuclidean,
}
#: Euclidean after a change of the vectors that depends on all of them.
RESCALED = ("seuclidean", "mahalanobis")
