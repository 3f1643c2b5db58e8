"""Densities of states: kernel estimates on grids and a fitted model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import doubles
from ..session import ship
from .mixtures import Mixture, fit_mixture
from .vectorspace import gathered, gram, standardisation

#: Facets of one view at most, and points whose kernels are formed at a time.
FACETS, POINTS = 10_000, 128


def kernel_shape(points: DataFrame, by: list[str], weight: str = "w") -> DataFrame:
    """``(*by, bounds, covariance of the kernel)`` of weighted points ``(*by, x, y, w)``.

    Scott's factor in two dimensions is the effective sample size to the
    power -1/6; the covariance is the unbiased weighted one times its square.
    A single point, or weights that sum to nothing, give a null covariance,
    and so do points on a line a null density.
    """
    w, x, y = F.col(weight), F.col("x"), F.col("y")
    s = points.groupBy(*by).agg(
        *(F.expr(f"{f}({c})").alias(f"{f}_{c}") for c in ("x", "y") for f in ("min", "max")),
        F.sum(w).alias("sw"), F.sum(w * w).alias("sww"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"),
        F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"), F.sum(w * y * y).alias("syy"),
    )
    sw = F.nullif("sw", F.lit(0.0))
    n_eff = F.col("sw") * F.col("sw") / F.nullif("sww", F.lit(0.0))
    correct = 1.0 / F.nullif(1.0 - F.col("sww") / (sw * sw), F.lit(0.0))
    mx, my = F.col("sx") / sw, F.col("sy") / sw
    factor = F.pow(n_eff, F.lit(-1.0 / 6.0))
    square = factor * factor * correct
    return s.select(
        *by, "min_x", "max_x", "min_y", "max_y", "sw", n_eff.alias("n_eff"), factor.alias("factor"),
        (square * (F.col("sxx") / sw - mx * mx)).alias("cxx"),
        (square * (F.col("sxy") / sw - mx * my)).alias("cxy"),
        (square * (F.col("syy") / sw - my * my)).alias("cyy"),
    )


def grid(shape: DataFrame, by: list[str], n: int) -> DataFrame:
    """``(*by, gi, gj, gx, gy)``: n x n places that span each facet's points, padded by a twentieth of their range."""
    def axis(c: str, k: str) -> Column:
        extent = F.col(f"max_{c}") - F.col(f"min_{c}")
        pad = 0.05 * F.when(extent == 0, 1.0).otherwise(extent)
        low, high = F.col(f"min_{c}") - pad, F.col(f"max_{c}") + pad
        return low + (high - low) * F.col(k) / F.lit(float(max(1, n - 1)))

    steps = F.sequence(F.lit(0), F.lit(n - 1))
    cells = shape.select("*", F.explode(steps).alias("gi")).select("*", F.explode(steps).alias("gj"))
    return cells.select(*by, "gi", "gj", axis("x", "gi").alias("gx"), axis("y", "gj").alias("gy"))


def _grid_sums(points: DataFrame, shape: DataFrame, by: list[str], n: int, kernels: list[tuple[str, str, bool]]) -> DataFrame:
    """``(*by, gi, gj, x, y, s0, s1, ...)``: sums of kernels at the places of each facet's grid.

    A kernel is a prefix of its covariance columns in ``shape``, the column
    it is divided by, and whether points count by weight. Facets are few
    (their number is checked) and held by tasks; a task adds up its points
    on each facet's grid and passes on the grids.
    """
    ship(points.sparkSession)
    places = grid(shape, by, n)
    facets = shape.limit(FACETS + 1).collect()
    if len(facets) > FACETS:
        raise ValueError(f"more than {FACETS} facets")
    numbers = points.sparkSession.createDataFrame([(i, *(f[c] for c in by)) for i, f in enumerate(facets)], T.StructType([T.StructField("facet_no", T.IntegerType()), *(shape.schema[c] for c in by)]))
    axes = []
    for f in facets:
        ends = []
        for c in ("x", "y"):
            low, high = f[f"min_{c}"], f[f"max_{c}"]
            padding = 0.05 * ((high - low) or 1.0)
            ends.append(low - padding + (high - low + 2 * padding) * np.arange(n) / max(1, n - 1))
        axes.append(ends)
    nan = float("nan")
    forms = [[tuple(nan if f[c] is None else f[c] for c in (f"{k}cxx", f"{k}cxy", f"{k}cyy", over)) for k, over, _ in kernels] for f in facets]
    weighted = [w for *_, w in kernels]
    names = [f"s{k}" for k in range(len(kernels))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            no, x, y, w = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for f in np.unique(no):
                at = np.flatnonzero(no == f)
                total = sums.setdefault(int(f), np.zeros((len(forms[f]), n, n)))
                for i in range(0, len(at), POINTS):
                    part = at[i : i + POINTS]
                    dx, dy = x[part, None] - axes[f][0], y[part, None] - axes[f][1]
                    for k, (cxx, cxy, cyy, over) in enumerate(forms[f]):
                        det = cxx * cyy - cxy * cxy
                        if not det > 0 or not over > 0:
                            total[k] = nan
                            continue
                        q = (cyy * dx * dx)[:, :, None] - 2 * cxy * dx[:, :, None] * dy[:, None, :] + (cxx * dy * dy)[:, None, :]
                        each = w[part] if weighted[k] else np.ones(len(part))
                        total[k] += np.tensordot(each, np.exp(-0.5 / det * q), 1) / (2 * np.pi * np.sqrt(det) * over)
        gi, gj = (v.ravel().astype(np.int32) for v in np.indices((n, n)))
        for f, total in sums.items():
            columns = [pa.array(np.full(n * n, f, np.int32)), pa.array(gi), pa.array(gj), *(pa.array(t.ravel()) for t in total)]
            yield pa.RecordBatch.from_arrays(columns, names=["facet_no", "gi", "gj", *names])

    numbered = points.join(F.broadcast(numbers), by).where("x IS NOT NULL AND y IS NOT NULL").select("facet_no", F.col("x").cast("double"), F.col("y").cast("double"), F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w"))
    schema = "facet_no int, gi int, gj int, " + ", ".join(f"{s} double" for s in names)
    added = numbered.mapInArrow(run, schema).groupBy("facet_no", "gi", "gj").agg(*(F.nanvl(F.sum(s), F.lit(None).cast("double")).alias(s) for s in names))
    placed = added.join(F.broadcast(numbers), "facet_no").join(places, [*by, "gi", "gj"])
    return placed.select(*by, "gi", "gj", F.col("gx").alias("x"), F.col("gy").alias("y"), *names)


def kernel_density(points: DataFrame, by: list[str], n: int = 64) -> DataFrame:
    """``(*by, gi, gj, x, y, density)``: weighted Gaussian kernel estimate of points ``(*by, x, y, w)`` on an n x n grid."""
    sums = _grid_sums(points, kernel_shape(points, by), by, n, [("", "sw", True)])
    return sums.withColumnRenamed("s0", "density")


def log_ratio_density(points: DataFrame, by: list[str], n: int = 64, floor: float = 1e-12, clip: float | None = None) -> DataFrame:
    """``(*by, gi, gj, x, y, log_ratio)``: logarithm of the weighted over the unweighted kernel estimate.

    Both use the bandwidth factor of the unweighted one, each with its own
    covariance; both are floored, and the ratio may be clipped to both sides.
    """
    flat = kernel_shape(points.withColumn("w", F.lit(1.0)), by)
    own = kernel_shape(points, by)
    ratio = (F.col("f.factor") / F.col("o.factor")) ** 2
    bounds = ("min_x", "max_x", "min_y", "max_y")
    form = ("cxx", "cxy", "cyy")
    shape = flat.alias("f").join(own.alias("o"), by).select(
        *by, *(F.col(f"f.{c}").alias(c) for c in bounds), F.col("f.sw").alias("n"), F.col("o.sw").alias("sw"),
        *(F.col(f"f.{c}").alias(f"p{c}") for c in form), *((F.col(f"o.{c}") * ratio).alias(f"w{c}") for c in form),
    )
    sums = _grid_sums(points, shape, by, n, [("w", "sw", True), ("p", "n", False)])
    value = F.log(F.greatest("s0", F.lit(floor))) - F.log(F.greatest("s1", F.lit(floor)))
    if clip is not None:
        value = F.least(F.greatest(value, F.lit(-clip)), F.lit(clip))
    return sums.select(*by, "gi", "gj", "x", "y", value.alias("log_ratio"))


def scaled_density(points: DataFrame, by: list[str], token: str = "token", n: int = 64) -> DataFrame:
    """Kernel estimates of several tokens, each scaled so that its greatest place in a facet is one."""
    found = kernel_density(points, [*by, token], n)
    top = F.max("density").over(Window.partitionBy(*by, token))
    return found.withColumn("density", F.col("density") / top)


def bands(density: DataFrame, levels: list[float], value: str = "density") -> DataFrame:
    """``band``: how many of the levels a place exceeds."""
    return density.withColumn("band", sum((F.col(value) > level).cast("int") for level in levels) if levels else F.lit(0))


@dataclass
class DensityModel:
    """Density of states: standardised components under a Gaussian mixture.

    Another family than a normalising flow, with the same contract: fit,
    logarithm of the density with the change of scale taken off, and draws.
    """

    mean: np.ndarray
    std: np.ndarray
    mixture: Mixture

    @classmethod
    def fit(cls, states: DataFrame, k: int | None = None, **options) -> DensityModel:
        """Fit ``states(row, h)``; components are standardised by all rows."""
        scale = standardisation(states).orderBy("j").toArrow()
        mean, std = (scale.column(c).to_numpy() for c in ("mean", "std"))
        centre, spread = (F.array(*[F.lit(float(x)) for x in v]) for v in (mean, std))
        moved = F.zip_with(F.zip_with(doubles("h"), centre, lambda x, m: x - m), spread, lambda x, s: x / s)
        return cls(mean, std, fit_mixture(states.select("row", moved.alias("x"), F.lit(1.0).alias("w")), k, **options))

    def log_density(self, h: str | Column) -> Column:
        """Logarithm of the density at a state, less the sum of the logarithms of the spreads."""
        mean, std, mixture = self.mean, self.std, self.mixture
        jacobian = float(np.log(std).sum())

        @F.pandas_udf("double")
        def value(x):
            if not len(x):
                return pd.Series([], dtype="float64")
            return pd.Series(mixture.log_density((np.stack(x.to_numpy()) - mean) / std) - jacobian)

        return value(h)

    def sample(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        """``(row, h)``: ``n`` draws, made where the rows lie."""
        ship(spark)
        mean, std, mixture = self.mean, self.std, self.mixture
        lower = [np.linalg.cholesky(c) for c in mixture.covariances]

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                if not len(ids):
                    continue
                rng = np.random.default_rng([seed, int(ids[0])])
                k = rng.choice(len(mixture.pi), len(ids), p=mixture.pi / mixture.pi.sum())
                z = rng.normal(size=(len(ids), len(mean)))
                x = mixture.means[k] + np.stack([lower[c] @ v for c, v in zip(k, z)])
                flat = (x * std + mean).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * len(mean)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["row", "h"])

        return spark.range(n).mapInArrow(draw, "row bigint, h array<double>")

    def table(self, spark: SparkSession) -> DataFrame:
        """The model as one row, to be saved and read back with :meth:`of`."""
        m = self.mixture
        row = (self.mean.tolist(), self.std.tolist(), m.pi.tolist(), m.means.tolist(), m.covariances.tolist(), m.ridge)
        return spark.createDataFrame([row], "mean array<double>, std array<double>, pi array<double>, means array<array<double>>, covariances array<array<array<double>>>, ridge double")

    @classmethod
    def of(cls, table: DataFrame) -> DensityModel:
        r = table.first()
        return cls(np.array(r["mean"]), np.array(r["std"]), Mixture(np.array(r["pi"]), np.array(r["means"]), np.array(r["covariances"]), r["ridge"]))


def effective_rows(vectors: DataFrame, weight: str) -> float:
    """Effective sample size of a weight column, 0 without weight."""
    w = gathered(gram(vectors, "h", weight)).get("w")
    return float(w[0] ** 2 / w[1]) if w is not None and w[0] > 0 else 0.0
