"""Isometric log-ratio coordinates in the Helmert basis, as running sums.

The basis vector ``i`` (from 1) has ``sqrt(1 / (i (i + 1)))`` at the first
``i`` places and ``-sqrt(i / (i + 1))`` at place ``i + 1``; with running sums
the dense basis is never formed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Floor of a probability inside a logarithm.
EPS = 1e-30


def _scale(i: Column) -> tuple[Column, Column]:
    i = i.cast("double")
    return F.sqrt(1.0 / (i * (i + 1.0))), F.sqrt(i / (i + 1.0))


def ilr_apply(rows: DataFrame, by: Sequence[str], order: str, value: str, out: str = "y") -> DataFrame:
    """``(*by, i, y)``: the coordinates of every vector given in long form ``(*by, order, value)``.

    Works within the groups ``by``; a vector of V places gives V - 1
    coordinates, numbered from 1 in order of ``order``.
    """
    w = Window.partitionBy(*by).orderBy(order)
    running = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    seen = rows.select(*by, F.row_number().over(w).alias("i"), running.alias("__s"), F.lead(value).over(w).alias("__n"))
    a, b = _scale(F.col("i"))
    return seen.where("__n IS NOT NULL").select(*by, "i", (a * F.col("__s") - b * F.col("__n")).alias(out))


def ilr_adjoint(rows: DataFrame, by: Sequence[str], value: str = "y", out: str = "x") -> DataFrame:
    """``(*by, i, x)``: the vector of V places (numbered from 1) that the V - 1 coordinates ``(*by, i, value)`` stand for."""
    a, b = _scale(F.col("i"))
    w = Window.partitionBy(*by).orderBy("i")
    terms = rows.select(*by, "i", (a * F.col(value)).alias("__up"), (b * F.col(value)).alias("__down"))
    last = terms.groupBy(*by).agg((F.max("i") + 1).alias("i")).select(*by, "i", F.lit(0.0).alias("__up"), F.lit(0.0).alias("__down"))
    whole = terms.unionByName(last)
    suffix = F.sum("__up").over(w.rowsBetween(0, Window.unboundedFollowing))
    return whole.select(*by, "i", (suffix - F.coalesce(F.lag("__down").over(w), F.lit(0.0))).alias(out))


def log_composition(p: str | Column, eps: float = EPS) -> Column:
    """Logarithm of a part with a floor, to which the coordinates of a composition apply."""
    return F.log(F.greatest(F.col(p) if isinstance(p, str) else p, F.lit(eps)))


def basis_table(spark: SparkSession, v: int) -> DataFrame:
    """``(i, j, x)``: the dense basis of ``v`` places, for checks on small sizes."""
    i, j = F.col("i"), F.col("j")
    a, b = _scale(i)
    pairs = spark.range(1, v).select(F.col("id").cast("int").alias("i")).select("i", F.explode(F.sequence(F.lit(1), F.lit(v))).alias("j"))
    return pairs.select("i", "j", F.when(j <= i, a).when(j == i + 1, -b).otherwise(0.0).alias("x"))


def ilr_matrix(rows: np.ndarray) -> np.ndarray:
    """Coordinates of the columns of ``rows`` (places down, V to V - 1), for results that fit a driver."""
    i = np.arange(1, len(rows))[:, None].astype(float)
    return np.sqrt(1 / (i * (i + 1))) * np.cumsum(rows, 0)[:-1] - np.sqrt(i / (i + 1)) * rows[1:]


def three_parts(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """The two coordinates of a composition of three parts."""
    la, lb, lc = (log_composition(x) for x in (a, b, c))
    return (la - lb) / F.sqrt(F.lit(2.0)), (la + lb - 2.0 * lc) / F.sqrt(F.lit(6.0))


def three_parts_inverse(y1: Column, y2: Column) -> tuple[Column, Column, Column]:
    """The three parts of two coordinates, scaled to sum to one."""
    base = y2 / F.sqrt(F.lit(6.0))
    logs = [y1 / F.sqrt(F.lit(2.0)) + base, -y1 / F.sqrt(F.lit(2.0)) + base, -2.0 * base]
    total = F.exp(logs[0]) + F.exp(logs[1]) + F.exp(logs[2])
    return tuple(F.exp(x) / total for x in logs)


def barycentric(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """A composition of three parts as a point of the triangle (0, 0), (1, 0), (1/2, sqrt(3)/2)."""
    total = a + b + c
    return (b + c / 2.0) / total, c * float(np.sqrt(3) / 2) / total


def gridlines(spark: SparkSession, steps: int, points: int, margin: float = 0.02) -> DataFrame:
    """``(part, level, k, y1, y2)``: lines of constant part ``part`` (1 to 3) in the plane of the coordinates."""
    part, level, k = F.col("part"), F.col("level"), F.col("k")
    base = spark.range(1, 4).select(F.col("id").cast("int").alias("part"))
    base = base.select("part", F.explode(F.sequence(F.lit(1), F.lit(steps - 1))).alias("n")).select("part", (F.col("n") / F.lit(float(steps))).alias("level"))
    base = base.select("part", "level", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    share = (1.0 - level) * (margin + (1.0 - 2.0 * margin) * k / F.lit(float(points - 1)))
    rest = 1.0 - level - share
    a = F.when(part == 1, level).when(part == 2, rest).otherwise(share)
    b = F.when(part == 2, level).when(part == 3, rest).otherwise(share)
    c = F.when(part == 3, level).when(part == 1, rest).otherwise(share)
    y1, y2 = three_parts(a, b, c)
    return base.select("part", "level", "k", y1.alias("y1"), y2.alias("y2"))
