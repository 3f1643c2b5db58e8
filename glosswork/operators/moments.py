"""Marginals, moment matrices, association values and centroids of a model over states."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import EPS, ilr_apply, ilr_matrix
from .blocks import target_moments
from .folds import dense, fold, fold_probabilities, stat, target_blocks
from .providers import MODEL_BYTES, matrix
from .vectorspace import gathered, gram

#: Bytes of an unembedding up to which moments of targets hold it in the driver and in tasks; beyond, blocks of it meet blocks of states.
WHOLE_BYTES = 4 << 20


@dataclass(frozen=True)
class Model:
    """Token ids in order with their unembedding vectors, held by tasks."""

    tokens: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, unembedding: DataFrame) -> Model:
        return cls(*matrix(unembedding))

    def rows(self, tokens: Sequence[int] | None) -> np.ndarray:
        """Places of the tokens asked for, all of them by default."""
        if tokens is None:
            return np.arange(len(self.tokens))
        at = np.searchsorted(self.tokens, tokens)
        if len(self.tokens) == 0 or (at == len(self.tokens)).any() or (self.tokens[at] != tokens).any():
            raise ValueError("a token is not in the vocabulary")
        return at

    def named(self, df: DataFrame, *columns: str, rows: np.ndarray | None = None) -> DataFrame:
        """Places replaced by token ids; the first column may count within ``rows``."""
        for n, c in enumerate(columns):
            ids = self.tokens[rows] if n == 0 and rows is not None else self.tokens
            if len(ids) and (ids == np.arange(len(ids))).all():
                continue
            names = df.sparkSession.createDataFrame([(k, int(t)) for k, t in enumerate(ids)], f"{c} int, __t int")
            order = df.columns
            df = df.join(names, c).drop(c).withColumnRenamed("__t", c).select(*order)
        return df


def _floor(x: str | Column, eps: float) -> Column:
    return F.log(F.greatest(F.col(x) if isinstance(x, str) else x, F.lit(eps)))


def marginals(states: DataFrame, unembedding: DataFrame) -> DataFrame:
    """``(token, z, z_sum, n)``: mean and sum of each token's probability over all states."""
    model = Model.of(unembedding)
    folded = fold(states, model.weights, lambda h, lp: {"z": np.exp(lp).sum(0), "n": np.full(1, len(h))})
    n = stat(folded, "n", "one", value="n").select("n")
    z = stat(folded, "z", "token", value="z_sum").join(F.broadcast(n))
    return model.named(z.select("token", (F.col("z_sum") / F.col("n")).alias("z"), "z_sum", F.col("n").cast("bigint").alias("n")), "token")


def marginals_of(rows: DataFrame) -> DataFrame:
    """``(token, z, z_sum)`` from stored distributions in long form ``(token, p)``."""
    return rows.groupBy("token").agg(F.avg("p").alias("z"), F.sum("p").alias("z_sum"))


def blockwise(targets: int, width: int, folded_of) -> DataFrame:
    """The union of folds ``folded_of(block)`` over blocks of targets, with ``i`` of their stat ``m`` counted over all."""
    parts = []
    for block in target_blocks(targets, width) or [slice(0, 0)]:
        place = F.when(F.col("stat") == "m", F.col("i") + block.start).otherwise(F.col("i")).cast("int")
        parts.append(folded_of(block).withColumn("i", place))
    return reduce(DataFrame.unionByName, parts)


def moments(states: DataFrame, unembedding: DataFrame, targets: Sequence[int] | None = None, z: DataFrame | None = None) -> DataFrame:
    """``(t, w, m, z_t, z_w)``: mean product of the probabilities of two tokens, with both marginals.

    ``targets`` restricts ``t`` before the product is formed; ``w`` always
    covers the vocabulary. ``z(token, z)`` replaces the sample's own
    marginals. Each task adds up a block of targets by vocabulary; more
    targets than fit one take more passes over the states. With ``targets``,
    a vocabulary above :data:`WHOLE_BYTES` stays distributed.
    """
    if targets is not None:
        size, width = unembedding.agg(F.count(F.lit(1)), F.max(F.size("w"))).first()
        if (size or 0) * (width or 0) * 8 > WHOLE_BYTES:
            return _wide_moments(states, unembedding, width, targets, z)
    model = Model.of(unembedding)
    rows = model.rows(targets)

    def kernel(block: slice):
        def run(h, log_p):
            p = np.exp(log_p)
            out = {"m": p[:, rows[block]].T @ p}
            return out if block.start else out | {"z": p.sum(0), "n": np.full(1, len(h))}

        return run

    folded = blockwise(len(rows), len(model.weights), lambda block: fold(states, model.weights, kernel(block)))
    n = stat(folded, "n", "one", value="n").select("n")
    m = model.named(stat(folded, "m", "t", "w", "m_sum"), "t", "w", rows=rows)
    if z is None:
        z = model.named(stat(folded, "z", "token", value="z_sum"), "token").join(F.broadcast(n)).select("token", (F.col("z_sum") / F.col("n")).alias("z"))
    z = z.select("token", "z")
    joined = m.join(F.broadcast(n)).join(z.select(F.col("token").alias("t"), F.col("z").alias("z_t")), "t").join(z.select(F.col("token").alias("w"), F.col("z").alias("z_w")), "w")
    return joined.select("t", "w", (F.col("m_sum") / F.col("n")).alias("m"), "z_t", "z_w")


def _wide_moments(states: DataFrame, unembedding: DataFrame, width: int, targets: Sequence[int], z: DataFrame | None) -> DataFrame:
    if len(targets) * width * 8 > MODEL_BYTES:
        raise ValueError(f"{len(targets)} targets of {width} numbers do not fit {MODEL_BYTES} bytes; ask for fewer")
    found = unembedding.where(F.col("token").isin([int(t) for t in targets])).select("token", "w").toArrow().sort_by("token")
    own = Model(found.column("token").to_numpy(), dense(found.column("w")))
    at = own.rows(targets) if len(targets) else np.zeros(0, int)
    m = target_moments(states, unembedding, width, own.tokens[at].astype(np.int64), own.weights[at])
    if z is None:
        return m
    z = z.select("token", "z")
    joined = m.select("t", "w", "m").join(z.select(F.col("token").alias("t"), F.col("z").alias("z_t")), "t").join(z.select(F.col("token").alias("w"), F.col("z").alias("z_w")), "w")
    return joined.select("t", "w", "m", "z_t", "z_w")


def pmi(moment: DataFrame, eps: float = EPS) -> DataFrame:
    """``(t, w, pmi)``: logarithm of the moment over both marginals, each with the floor ``eps``; neither clipped nor shifted."""
    return moment.select("t", "w", (_floor("m", eps) - _floor("z_t", eps) - _floor("z_w", eps)).alias("pmi"))


def moments_of(rows: DataFrame) -> DataFrame:
    """``(t, w, m_sum)`` of stored distributions ``rows(p)`` as arrays; divide by the number of rows for means."""
    width = rows.agg(F.max(F.size("p"))).first()[0] or 0
    return stat(blockwise(width, width, lambda block: fold_probabilities(rows, lambda p: {"m": p[:, block].T @ p})), "m", "t", "w", "m_sum")


def excess_moments(states: DataFrame, unembedding: DataFrame, z: np.ndarray, targets: Sequence[int] | None = None) -> DataFrame:
    """``(t, w, m, z_d)``: mean of ``max(0, D_t) p_w`` and of ``max(0, D_t)``.

    ``D_t = log p_t - log z_t`` is the distinctiveness of a token at a state,
    ``z`` the marginals in token order. Tokens with ``z`` of zero give null.
    """
    model = Model.of(unembedding)
    rows = model.rows(targets)
    log_z = np.log(np.where(z > 0, z, np.nan))[rows]

    def kernel(block: slice):
        def run(h, log_p):
            out = {"m": np.maximum(0, log_p[:, rows[block]] - log_z[block]).T @ np.exp(log_p)}
            return out if block.start else out | {"d": np.maximum(0, log_p[:, rows] - log_z).sum(0), "n": np.full(1, len(h))}

        return run

    folded = blockwise(len(rows), len(model.weights), lambda block: fold(states, model.weights, kernel(block)))
    n = stat(folded, "n", "one", value="n").select("n")
    d = stat(folded, "d", "t", value="d_sum")
    joined = stat(folded, "m", "t", "w", "m_sum").join(d, "t").join(F.broadcast(n))
    named = joined.select("t", "w", F.nanvl(F.col("m_sum") / F.col("n"), F.lit(None)).alias("m"), F.nanvl(F.col("d_sum") / F.col("n"), F.lit(None)).alias("z_d"))
    return model.named(named, "t", "w", rows=rows)


def marginal_vector(states: DataFrame, unembedding: DataFrame) -> np.ndarray:
    """The marginals in token order, as many numbers as the vocabulary has tokens."""
    rows = marginals(states, unembedding).select("token", "z").orderBy("token").toArrow()
    return rows.column("z").to_numpy()


def centroids(states: DataFrame, unembedding: DataFrame, origin: str = "raw", z: np.ndarray | None = None, targets: Sequence[int] | None = None) -> DataFrame:
    """``(t, j, x)``: mean state of every token, weighted by its probability, or with ``z`` by its positive distinctiveness.

    ``origin`` 'raw' leaves the means, 'aitchison' takes the mean of all
    states off.
    """
    if origin not in ("raw", "aitchison"):
        raise ValueError("origin is 'raw' or 'aitchison'")
    model = Model.of(unembedding)
    rows = model.rows(targets)
    log_z = None if z is None else np.log(np.where(z > 0, z, np.nan))[rows]

    def kernel(h, log_p):
        weight = np.exp(log_p[:, rows]) if log_z is None else np.maximum(0, log_p[:, rows] - log_z)
        return {"c": weight.T @ h, "s": weight.sum(0), "h": h.sum(0), "n": np.full(1, len(h))}

    folded = fold(states, model.weights, kernel)
    mass = stat(folded, "s", "t", value="s")
    mean = stat(folded, "c", "t", "j", "c").join(mass, "t").select("t", "j", (F.col("c") / F.greatest("s", F.lit(EPS))).alias("x"))
    if origin == "aitchison":
        n = stat(folded, "n", "one", value="n").select("n")
        overall = stat(folded, "h", "j", value="h_sum").join(F.broadcast(n)).select("j", (F.col("h_sum") / F.col("n")).alias("mean"))
        mean = mean.join(overall, "j").select("t", "j", (F.col("x") - F.col("mean")).alias("x"))
    return model.named(mean.select("t", "j", "x"), "t", rows=rows)


def ilr_of_unembedding(unembedding: DataFrame) -> DataFrame:
    """``(i, j, y)``: the unembedding in log-ratio coordinates, column by column down the vocabulary.

    Products with states are then the log-ratio coordinates of the
    predictions, without a softmax.
    """
    long = unembedding.select("token", F.posexplode("w").alias("j", "x"))
    return ilr_apply(long, ["j"], "token", "x").select("i", "j", "y")


def in_ilr_space(unembedding: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(t, i, y)``: token vectors ``(t, j, x)`` moved into log-ratio coordinates."""
    a = ilr_of_unembedding(unembedding)
    return vectors.join(a, "j").groupBy("t", "i").agg(F.sum(F.col("x") * F.col("y")).alias("y"))


def ilr_embedding(associations: DataFrame) -> DataFrame:
    """``(t, i, y)``: every row of an association matrix ``(t, w, pmi)`` in log-ratio coordinates."""
    return ilr_apply(associations, ["t"], "w", "pmi")


def degenerate_direction(unembedding: DataFrame) -> np.ndarray:
    """The unit vector whose products with all unembedding vectors are nearest to one.

    Least squares by normal equations: the d x d matrix and the d sums are
    aggregated in Spark, the solution is found on the driver. A zero
    solution raises.
    """
    sums = gathered(gram(unembedding, "w"))
    v = np.linalg.lstsq(sums["g"], sums["s"], rcond=None)[0]
    length = np.linalg.norm(v)
    if not length > 1e-12:
        raise RuntimeError("no direction moves all products alike")
    return v / length


def unembedding_coordinates(model: Model) -> np.ndarray:
    return ilr_matrix(model.weights)
