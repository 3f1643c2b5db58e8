"""Column expressions over ARRAY<DOUBLE> vectors, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: str | Column) -> Column:
    """The vector with every element as DOUBLE, so that sums accumulate in double precision."""
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two vectors; null if one has length zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def minus(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def logsumexp(v: str | Column) -> Column:
    """``ln(sum(exp(v)))`` with the greatest element taken out first."""
    top = F.array_max(v)
    return top + F.log(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def softmax(v: str | Column) -> Column:
    """Exponentials of the vector scaled to sum to one."""
    top = F.array_max(v)
    weight = F.transform(v, lambda x: F.exp(x - top))
    total = F.aggregate(weight, F.lit(0.0), lambda s, x: s + x)
    return F.transform(weight, lambda x: x / total)


def project_out(h: str | Column, v: str | Column) -> Column:
    """``h`` without its component along the unit vector ``v``."""
    c = dot(h, v)
    return F.zip_with(h, v, lambda x, u: x - c * u)
