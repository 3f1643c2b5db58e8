"""Importance weights, effective sample sizes and distinctiveness of tokens."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot
from .folds import fold, stat
from .moments import Model, marginal_vector
from .providers import matrix


def with_log_partition(states: DataFrame, unembedding: DataFrame) -> DataFrame:
    """``states`` with ``log_z``, the logarithm of the sum of exponentials of a state's products with the vocabulary.

    Kept with the sample, it makes every later question about one token a
    single product per state. Computed in Arrow batches; other columns stay.
    """
    _, weights = matrix(unembedding)

    @F.pandas_udf("double")
    def log_z(h):
        x = np.stack(h.to_numpy()) @ weights.T if len(h) else np.zeros((0, 1))
        top = x.max(1)
        return pd.Series(top + np.log(np.exp(x - top[:, None]).sum(1)))

    return states.withColumn("log_z", log_z("h"))


def token_vector(unembedding: DataFrame, token: int) -> list[float]:
    found = unembedding.where(F.col("token") == token).select("w").first()
    if found is None:
        raise ValueError(f"token {token} is not in the vocabulary")
    return found["w"]


def log_probability(w: Sequence[float]) -> Column:
    """Logarithm of a token's probability at a state with ``h`` and ``log_z``."""
    return dot("h", F.array(*map(F.lit, w))) - F.col("log_z")


def distinctiveness_field(sample: DataFrame, unembedding: DataFrame, token: int, z_t: float) -> DataFrame:
    """``(row, d)``: how much more probable the token is at a state than overall, in nats."""
    if not z_t > 0:
        raise ValueError("the marginal of the token must be positive")
    return sample.select("row", (log_probability(token_vector(unembedding, token)) - F.lit(float(np.log(z_t)))).alias("d"))


def token_weights(sample: DataFrame, unembedding: DataFrame, token: int, z_t: float, stabilise: bool = False) -> DataFrame:
    """``(row, omega)``: importance weights of states for a token; with ``stabilise`` the greatest is one."""
    field = distinctiveness_field(sample, unembedding, token, z_t)
    if not stabilise:
        return field.select("row", F.exp("d").alias("omega"))
    top = field.agg(F.max("d").alias("top"))
    return field.join(F.broadcast(top)).select("row", F.exp(F.col("d") - F.col("top")).alias("omega"))


def effective_size(weight: str = "omega") -> Column:
    """Kish's effective sample size of a weight column, 0 if the weights sum to nothing."""
    total, squares = F.sum(weight), F.sum(F.col(weight) * F.col(weight))
    return F.when(total > 0, total * total / squares).otherwise(0.0)


def expected_distinctiveness(field: DataFrame) -> DataFrame:
    """One row ``(kl, ess, mean_omega)`` from ``(d)``: the mean of D under a token's weights."""
    peak = field.agg(F.max("d").alias("peak"))
    w = F.exp(F.col("d") - F.col("peak"))
    shifted = field.join(F.broadcast(peak)).select("d", "peak", w.alias("omega"))
    sums = shifted.agg(F.sum(F.col("omega") * F.col("d")).alias("a"), F.sum("omega").alias("b"), effective_size().alias("ess"), F.max("peak").alias("peak"), F.count(F.lit(1)).alias("n"))
    return sums.select((F.col("a") / F.col("b")).alias("kl"), "ess", (F.col("b") * F.exp("peak") / F.col("n")).alias("mean_omega"))


def expected_distinctiveness_all(states: DataFrame, unembedding: DataFrame, z: np.ndarray | None = None, targets: Sequence[int] | None = None) -> DataFrame:
    """``(token, kl, ess, mean_omega)`` for the vocabulary in one pass.

    ``z`` are marginals in token order, by default the sample's own. Tokens
    without a positive marginal have null ``kl`` and ``ess`` 0.
    """
    model = Model.of(unembedding)
    rows = model.rows(targets)
    z = marginal_vector(states, unembedding) if z is None else np.asarray(z, float)
    positive = z[rows] > 0
    log_z = np.log(np.where(positive, z[rows], 1.0))

    def kernel(h, log_p):
        d = log_p[:, rows] - log_z
        w = np.exp(d)
        return {"a": (w * d).sum(0), "b": w.sum(0), "q": (w * w).sum(0), "n": np.full(1, len(h))}

    folded = fold(states, model.weights, kernel)
    n = stat(folded, "n", "one", value="n").select("n")
    a, b, q = (stat(folded, s, "token", value=s) for s in "abq")
    usable = F.array(*[F.lit(bool(x)) for x in positive]) if len(positive) else F.array().cast("array<boolean>")
    good = F.get(usable, F.col("token"))
    joined = a.join(b, "token").join(q, "token").join(F.broadcast(n))
    result = joined.select("token", F.when(good, F.col("a") / F.col("b")).alias("kl"), F.when(good, F.col("b") * F.col("b") / F.col("q")).otherwise(0.0).alias("ess"), F.when(good, F.col("b") / F.col("n")).alias("mean_omega"))
    return model.named(result, "token", rows=rows)
