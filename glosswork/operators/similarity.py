"""Directed similarity and divergence of token pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import EPS
from ..session import materialise
from .folds import BATCH_BYTES, batch_rows, fold
from .moments import Model

# The quantities that can be asked for.
QUANTITIES = ("expected_probability", "expected_surprisal", "kl")

#: Distinct pairs that one pass over the states serves; their tokens and sums are held by tasks and the driver.
SLAB_PAIRS = 1 << 20


def pair_similarities(pairs: DataFrame, states: DataFrame, unembedding: DataFrame, quantities: Sequence[str] = QUANTITIES) -> DataFrame:
    """``pairs(t1, t2, ...)`` with the quantities asked for; weights come from ``t1``.

    ``expected_probability`` is the mean probability of ``t2``,
    ``expected_surprisal`` of its negative logarithm, ``kl`` the divergence
    of the state distributions of ``t1`` and ``t2``, corrected by both
    marginals over the whole vocabulary, so that no pair depends on another.
    Repeated pairs are computed once and joined back; pairs with an unknown
    or null token keep null, and so do all if there are no states. Other
    columns stay. Only the pairs named are added up, so work grows with
    their number, not with the squared vocabulary.
    """
    unknown = set(quantities) - set(QUANTITIES)
    if unknown:
        raise ValueError(f"unknown quantities {sorted(unknown)}; of {QUANTITIES}")
    model = Model.of(unembedding)
    spark = pairs.sparkSession
    known = spark.createDataFrame([(k, int(t)) for k, t in enumerate(model.tokens)], "place int, token int")
    first, second = (known.select(F.col("token").alias(f"t{k}"), F.col("place").alias(f"p{k}")) for k in (1, 2))
    wanted = pairs.select("t1", "t2").na.drop().distinct().join(first, "t1").join(second, "t2")
    wanted = materialise(wanted.withColumn("slab", F.pmod(F.xxhash64("t1", "t2"), F.lit(max(1, -(-wanted.count() // SLAB_PAIRS))))), "pairs")
    slabs = [r["slab"] for r in wanted.select("slab").distinct().orderBy("slab").collect()]
    parts = [_of_slab(wanted.where(F.col("slab") == slab), states, model, quantities) for slab in slabs]
    made = reduce(DataFrame.unionByName, parts) if parts else wanted.select("t1", "t2", *(F.lit(None).cast("double").alias(q) for q in quantities))
    return pairs.join(made, ["t1", "t2"], "left")


def _of_slab(wanted: DataFrame, states: DataFrame, model: Model, quantities: Sequence[str]) -> DataFrame:
    """The quantities of a bounded number of pairs ``(t1, t2, p1, p2)``; only the tokens they name are brought together."""
    held = wanted.select("t1", "t2", "p1", "p2").toArrow()
    a, b = held.column("p1").to_numpy(), held.column("p2").to_numpy()
    floor = np.log(EPS)
    asked = {"expected_probability"} & set(quantities), {"expected_surprisal", "kl"} & set(quantities)
    step = max(1, BATCH_BYTES // (8 * batch_rows(len(model.weights))))

    def kernel(h, log_p):
        p, clamped = np.exp(log_p), np.maximum(log_p, floor)
        out = {"z": p.sum(0), "n": np.full(1, len(h))}
        blocks = [slice(i, i + step) for i in range(0, len(a), step)]
        if asked[0]:
            out["m"] = np.concatenate([np.einsum("np,np->p", p[:, a[s]], p[:, b[s]]) for s in blocks])
        if asked[1]:
            out["c"] = np.concatenate([np.einsum("np,np->p", p[:, a[s]], clamped[:, b[s]]) for s in blocks])
            out["own"] = np.einsum("nv,nv->v", p, clamped)
        return out

    sums = gathered_sums(fold(states, model.weights, kernel), {"z": len(model.tokens), "n": 1, "m": len(a), "c": len(a), "own": len(model.tokens)})
    z, n = sums["z"], sums["n"][0]
    weight = np.maximum(z[a], EPS)
    found = {"t1": held.column("t1"), "t2": held.column("t2")}
    for q in quantities:
        if q == "expected_probability":
            value = sums["m"] / weight
        elif q == "expected_surprisal":
            value = -sums["c"] / weight
        else:
            value = (sums["own"][a] - sums["c"]) / weight + np.log(np.maximum(z[b] / max(n, 1), EPS)) - np.log(np.maximum(z[a] / max(n, 1), EPS))
        found[q] = pa.array(value, pa.float64(), mask=np.full(len(a), n == 0))
    return wanted.sparkSession.createDataFrame(pa.table(found))


def gathered_sums(folded: DataFrame, sizes: dict[str, int]) -> dict[str, np.ndarray]:
    """One-dimensional sums of a fold as arrays of the sizes given, zeros where there is none."""
    rows = folded.select("stat", "j", "value").toArrow()
    names, j, value = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("stat", "j", "value"))
    out = {}
    for name, size in sizes.items():
        out[name] = np.zeros(size)
        at = names == name
        out[name][j[at]] = value[at]
    return out
