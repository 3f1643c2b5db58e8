"""Functions of the library by name in SQL: scalar functions, aggregates and table functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# SQL bodies of the scalar functions.
SCALARS = {
    "vector_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0.0D, (s, x) -> s + x)"),
    "vector_norm": ("a ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(a, 0.0D, (s, x) -> s + x * x))"),
    "vector_cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0.0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0.0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0.0D, (s, x) -> s + x * x)), 0.0D)"),
    "vector_logsumexp": ("v ARRAY<DOUBLE>", "DOUBLE", "array_max(v) + ln(aggregate(v, 0.0D, (s, x) -> s + exp(x - array_max(v))))"),
    "vector_ilr": ("v ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "CASE WHEN size(v) < 2 THEN CAST(array() AS ARRAY<DOUBLE>) ELSE transform(sequence(1, size(v) - 1), i -> sqrt(i / (i + 1.0D)) * (aggregate(slice(v, 1, i), 0.0D, (s, x) -> s + x) / i - v[i])) END"),
    "vector_matvec": ("m ARRAY<ARRAY<DOUBLE>>, v ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "transform(m, r -> aggregate(zip_with(r, v, (x, y) -> x * y), 0.0D, (s, x) -> s + x))"),
    "decay_weight": ("d DOUBLE, w DOUBLE, kind STRING, alpha DOUBLE", "DOUBLE", "CASE WHEN d = 0 THEN 1.0D WHEN abs(d) > w THEN 0.0D WHEN kind = 'linear' THEN (w - abs(d)) / w WHEN kind = 'harmonic' THEN 1 / abs(d) WHEN kind = 'exponential' THEN exp(-alpha * abs(d)) WHEN kind = 'power' THEN pow(1 + abs(d), -alpha) ELSE 1.0D END"),
}


@F.pandas_udf(T.DoubleType())
def kish_ess(w: pd.Series) -> float:
    """Effective sample size of a group's weights."""
    total = w.sum()
    return float(total * total / (w * w).sum()) if total > 0 else 0.0


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def half_precision(v: pd.Series) -> pd.Series:
    """Numbers rounded to half precision, as stored distributions are; a batch is rounded at once."""
    kept = v.dropna()
    if not len(kept):
        return pd.Series([None] * len(v), index=v.index, dtype=object)
    flat = np.concatenate(kept.to_numpy()).astype(np.float16).astype(np.float64)
    parts = np.split(flat, np.cumsum([len(x) for x in kept])[:-1])
    return pd.Series(parts, index=kept.index, dtype=object).reindex(v.index).map(lambda x: x if isinstance(x, np.ndarray) else None)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def weighted_gram(v: pd.Series, w: pd.Series) -> list:
    """Weighted sum of outer products of a group's vectors, row by row; rows with a null count for nothing."""
    good = v.notna() & w.notna()
    if not good.any():
        return []
    x, weight = np.stack(v[good].to_numpy()), w[good].to_numpy(float)
    return ((x * weight[:, None]).T @ x).ravel().tolist()


@F.pandas_udf(T.DoubleType())
def gaussian_logpdf(x: pd.Series, mean: pd.Series, std: pd.Series) -> pd.Series:
    """Logarithm of a Gaussian density with independent components."""
    if not len(x):
        return pd.Series([], dtype="float64")
    a, m, s = (np.stack(c.to_numpy()) for c in (x, mean, std))
    return pd.Series(-0.5 * (((a - m) / s) ** 2).sum(1) - np.log(s).sum(1) - 0.5 * a.shape[1] * np.log(2 * np.pi))


@F.udtf(returnType=T.StructType().add("o", T.IntegerType()).add("wt", T.DoubleType()))
class ContextWindow:
    """``context_window(size, decay, alpha, direction, include_target)``: offsets of a window with their weights."""

    def eval(self, size: int, decay: str, alpha: float, direction: str, include_target: bool):
        low = 0 if direction == "forward" else -size
        high = 0 if direction == "backward" else size
        for o in range(low, high + 1):
            d = abs(o)
            if d == 0:
                wt = 1.0 if include_target else 0.0
            else:
                wt = {"linear": (size - d) / size, "harmonic": 1 / d, "exponential": float(np.exp(-alpha * d)), "power": float((1 + d) ** -alpha)}.get(decay, 1.0)
            if wt > 0:
                yield o, wt


@F.udtf(returnType=T.StructType().add("gi", T.IntegerType()).add("gj", T.IntegerType()).add("gx", T.DoubleType()).add("gy", T.DoubleType()))
class KdeGrid:
    """``kde_grid(min_x, max_x, min_y, max_y, n)``: places of an n x n grid, padded by a twentieth of each range."""

    def eval(self, min_x: float, max_x: float, min_y: float, max_y: float, n: int):
        axes = []
        for low, high in ((min_x, max_x), (min_y, max_y)):
            pad = 0.05 * ((high - low) or 1.0)
            axes.append(np.linspace(low - pad, high + pad, n))
        for i in range(n):
            for j in range(n):
                yield i, j, float(axes[0][i]), float(axes[1][j])


def register(spark: SparkSession) -> None:
    """Make all of them known to ``spark.sql``; names start with nothing and replace earlier ones."""
    from ..session import ship

    ship(spark)
    for name, (args, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    for name, f in (("kish_ess", kish_ess), ("weighted_gram", weighted_gram), ("half_precision", half_precision), ("gaussian_logpdf", gaussian_logpdf)):
        spark.udf.register(name, f)
    spark.udtf.register("context_window", ContextWindow)
    spark.udtf.register("kde_grid", KdeGrid)
