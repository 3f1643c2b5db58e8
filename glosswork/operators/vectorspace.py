"""Embeddings: singular vectors, principal axes, projections, neighbours and contrast axes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import cosine, dot, doubles, minus
from ..session import ship
from .folds import PACKED, added, dense, pack

#: Columns up to which a Gram matrix is solved; beyond, extra directions and passes of the randomised range finder.
GRAM_WIDTH, OVERSAMPLE, PASSES = 2048, 16, 4

#: Bytes of the queries of a search, and of their best so far, that a task holds at a time.
QUERY_BYTES = 64 << 20


def gram(vectors: DataFrame, column: str, weight: str | None = None, centre: np.ndarray | None = None) -> DataFrame:
    """``(stat, i, j, value)``: sums of weights ``w``, weighted vectors ``s`` and outer products ``g``, added up in tasks first."""
    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            x = dense(batch.column(0))
            if not len(x):
                continue
            x = x if centre is None else x - centre
            w = batch.column(1).to_numpy(zero_copy_only=False)
            part = {"w": np.array([w.sum(), (w * w).sum(), len(w)]), "s": w @ x, "g": (x * w[:, None]).T @ x}
            sums = {k: sums[k] + v if k in sums else v for k, v in part.items()}
        yield from pack(sums)

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = vectors.where(F.col(column).isNotNull()).select(doubles(column).alias("x"), w.alias("w"))
    return added(rows.mapInArrow(run, PACKED))


def gathered(folded: DataFrame) -> dict[str, np.ndarray]:
    """The sums as arrays; their size depends on the dimension only."""
    rows = folded.toArrow()
    names, i, j, value = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("stat", "i", "j", "value"))
    out = {}
    for name in set(names):
        at = names == name
        whole = np.zeros((i[at].max() + 1, j[at].max() + 1))
        whole[i[at], j[at]] = value[at]
        out[name] = whole[0] if name in ("w", "s") else whole
    return out


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that their greatest component by size is positive."""
    at = np.abs(vectors).argmax(0)
    return vectors * np.where(vectors[at, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def principal_axes(vectors: DataFrame, column: str = "h", weight: str | None = None, centred: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean (zero if not centred), axes as columns and their variances, greatest first.

    Weighted and centred this is the basis of one token, unweighted and not
    centred the singular basis of a sample (variances times rows are the
    squared singular values). d x d sums come from Spark; the driver solves
    the symmetric eigenproblem. Signs are fixed by the greatest component.
    """
    sums = gathered(gram(vectors, column, weight))
    if not sums or not sums["w"][0] > 0:
        raise ValueError("no vectors of positive weight")
    total = sums["w"][0]
    mean = sums["s"] / total if centred else np.zeros(len(sums["s"]))
    covariance = sums["g"] / total - np.outer(mean, mean)
    value, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-value, kind="stable")
    return mean, _signed(axes[:, order]), np.maximum(value[order], 0)


def project(vectors: DataFrame, axes: np.ndarray, mean: np.ndarray | None = None, column: str = "h", out: str = "proj") -> DataFrame:
    """``vectors`` with their products with the columns of ``axes``, after taking ``mean`` off; other columns stay.

    The axes go to the tasks as one matrix and meet a batch in one product;
    a null vector has null products.
    """
    ship(vectors.sparkSession)
    shift = np.zeros(axes.shape[1]) if mean is None else mean @ axes
    k = axes.shape[1]
    kept = vectors.drop(out)
    place = kept.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(place)
            good = np.asarray(lists.is_valid())
            x = dense(lists.filter(pa.array(good)))
            y = (x @ axes - shift) if len(x) else np.zeros((0, k))
            ends = np.r_[0, np.cumsum(np.where(good, k, 0))].astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(ends), pa.array(y.ravel()), mask=pa.array(~good))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    return kept.mapInArrow(run, schema)


def axes_table(spark: SparkSession, axes: np.ndarray, values: np.ndarray) -> DataFrame:
    """``(pc, v, s)``: axes and singular values or variances as a table."""
    return spark.createDataFrame([(k, [float(x) for x in axes[:, k]], float(values[k])) for k in range(axes.shape[1])], "pc int, v array<double>, s double")


def _moved(rows: DataFrame, column: str, basis: np.ndarray, mean: np.ndarray) -> dict[str, np.ndarray]:
    """Sums ``b = X' (X Q)`` and ``c = (X Q)' (X Q)`` over all rows, less ``mean``, for a tall basis ``Q``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                x = dense(batch.column(0).slice(at, 1024)) - mean
                y = x @ basis
                for name, value in (("b", x.T @ y), ("c", y.T @ y)):
                    sums[name] = sums[name] + value if name in sums else value
        yield from pack(sums)

    return gathered(added(rows.where(F.col(column).isNotNull()).select(doubles(column).alias("x")).mapInArrow(run, PACKED)))


def right_vectors(rows: DataFrame, column: str, k: int, centre: bool, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
    """The ``k`` greatest right singular vectors and squared values, the mean, the squared norm of all and the number of rows.

    Up to :data:`GRAM_WIDTH` columns the Gram matrix is solved. Wider rows
    take a randomised range finder: columns x ``k + OVERSAMPLE`` sums are
    added up a few times, each time from a better basis, so that neither a
    task nor the driver holds a matrix of the squared width.
    """
    held = rows.where(F.col(column).isNotNull()).select(doubles(column).alias("x"))
    width = held.agg(F.max(F.size("x"))).first()[0] or 0

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            x = dense(batch.column(0))
            if len(x):
                part = {"w": np.array([(x * x).sum(), len(x)]), "s": x.sum(0)}
                sums = {name: sums[name] + v if name in sums else v for name, v in part.items()}
        yield from pack(sums)

    ship(rows.sparkSession)
    if width <= GRAM_WIDTH:
        sums = gathered(gram(rows, column))
        n, mean = sums["w"][2], sums["s"] / sums["w"][2] if centre else np.zeros(width)
        g = sums["g"] - n * np.outer(mean, mean)
        value, axes = np.linalg.eigh((g + g.T) / 2)
        norm = float(np.trace(g))
    else:
        first = gathered(added(held.mapInArrow(sums_of, PACKED)))
        n, mean = first["w"][1], first["s"] / first["w"][1] if centre else np.zeros(width)
        norm = float(first["w"][0] - n * (mean @ mean))
        basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(width, k + OVERSAMPLE))))[0]
        for _ in range(PASSES):
            basis = np.linalg.qr(_moved(rows, column, basis, mean)["b"])[0]
        c = _moved(rows, column, basis, mean)["c"]
        value, turn = np.linalg.eigh((c + c.T) / 2)
        axes = basis @ turn
    order = np.argsort(-value, kind="stable")[:k]
    return np.maximum(value[order], 0), _signed(axes[:, order]), mean, norm, int(n)


def svd_embedding(rows: DataFrame, k: int, alpha: float = 0.5, centre: bool = False, key: str = "t", column: str = "v") -> tuple[DataFrame, np.ndarray, float]:
    """``(key, e)`` of ``k`` dimensions, the singular values, and the share of the squared norm they explain.

    ``e`` is the left singular vectors times the values to the power
    ``alpha``. Sums over the columns are added up in Spark and solved on the
    driver (:func:`right_vectors`); rows are projected where they lie, so
    there may be any number of them. ``k`` above the rank raises.
    """
    value, axes, mean, norm, n = right_vectors(rows, column, k, centre)
    if k > min(n, len(axes)) or not value[k - 1] > 1e-12 * max(value[0], 1e-300):
        raise ValueError(f"{k} dimensions exceed the rank")
    s = np.sqrt(value)
    scaled = axes * s ** (alpha - 1)  # U S^alpha = X V S^(alpha - 1)
    embedded = project(rows.where(F.col(column).isNotNull()).select(key, doubles(column).alias(column)), scaled, mean if centre else None, column, "e")
    return embedded.select(key, "e"), s, float(value.sum() / max(norm, 1e-300))


def lists_of(long: DataFrame, key: str, index: str, value: str, out: str = "v") -> DataFrame:
    """Rows of a matrix in long form as arrays in order of the index."""
    return long.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(index, value))).alias("l")).select(key, F.col(f"l.{value}").alias(out))


def nearest_tokens(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", block: int = 4096) -> DataFrame:
    """``(id, other, score, rank)``: the ``k`` best vectors for every query vector, itself left out.

    Exact search of a stated query set ``queries(id, e)`` against all of
    ``vectors(id, e)``: queries are held by tasks in blocks of ``block``,
    every task keeps its best ``k`` for each query, and only those are
    shuffled. More queries than :data:`QUERY_BYTES` hold take several passes
    over the vectors. Scores are cosines or negative squared distances; equal
    scores rank by the lesser id.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError("the metric is 'cosine' or 'euclidean'")
    ship(vectors.sparkSession)
    number, width = queries.agg(F.count(F.lit(1)), F.max(F.size("e"))).first()
    passes = max(1, -(-number * 8 * ((width or 0) + 2 * k + 1) // QUERY_BYTES))
    slab = F.pmod(F.xxhash64("id"), F.lit(passes))
    parts = [_best_of(queries.where(slab == s) if passes > 1 else queries, vectors, k, metric, block) for s in range(passes)]
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("score", 9)), "other"))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", rank).where(F.col("rank") <= k)


def _best_of(queries: DataFrame, vectors: DataFrame, k: int, metric: str, block: int) -> DataFrame:
    """``(id, other, score)``: the best of every task for queries that tasks can hold."""
    held = queries.select(F.col("id").cast("bigint").alias("id"), doubles("e").alias("e")).where("e IS NOT NULL").orderBy("id").toArrow()
    ids = held.column("id").to_numpy()
    q = dense(held.column("e").combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_id = np.full((len(ids), k), np.iinfo(np.int64).max)
        best = np.full((len(ids), k), -np.inf)
        for batch in batches:
            own, x = batch.column(0).to_numpy(), dense(batch.column(1))
            if not len(x) or not len(ids):
                continue
            lengths = np.linalg.norm(x, axis=1)
            for a in range(0, len(ids), block):
                part = q[a : a + block]
                product = part @ x.T
                if metric == "cosine":
                    scale = np.linalg.norm(part, axis=1)[:, None] * lengths
                    score = np.divide(product, scale, out=np.full_like(product, -np.inf), where=scale > 0)
                else:
                    score = 2 * product - (part * part).sum(1)[:, None] - (x * x).sum(1)
                score[ids[a : a + block, None] == own] = -np.inf
                both = np.concatenate([best[a : a + block], score], 1)
                names = np.concatenate([best_id[a : a + block], np.broadcast_to(own, score.shape)], 1)
                order = np.lexsort((names, -np.round(both, 9)), axis=1)[:, :k]
                best[a : a + block], best_id[a : a + block] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
        row, rank = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(best_id[row, rank]), pa.array(best[row, rank])], names=["id", "other", "score"])

    return vectors.where("e IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), doubles("e").alias("e")).mapInArrow(run, "id bigint, other bigint, score double")


def contrast(unembedding: DataFrame, positive: int, negative: int) -> list[float]:
    """The axis on which a state's coordinate is the log-odds of two tokens."""
    if positive == negative:
        raise ValueError("a contrast needs two tokens")
    found = {r["token"]: r["w"] for r in unembedding.where(F.col("token").isin(positive, negative)).collect()}
    if len(found) < 2:
        raise ValueError("a token of the contrast is not in the vocabulary")
    return [a - b for a, b in zip(found[positive], found[negative])]


def contrast_axes(unembedding: DataFrame, axes: Sequence[tuple[int, int]]) -> dict[tuple[int, int], list[float]]:
    """Axes of several contrasts, each computed once."""
    return {pair: contrast(unembedding, *pair) for pair in dict.fromkeys(axes)}


def on_axes(states: DataFrame, axes: dict[tuple[int, int], list[float]]) -> DataFrame:
    """``(row, axis, x)``: coordinates of states on contrast axes, in long form."""
    parts = [F.struct(F.lit(f"{p}-{n}").alias("axis"), dot("h", F.array(*map(F.lit, v))).alias("x")) for (p, n), v in axes.items()]
    return states.select("row", F.explode(F.array(*parts)).alias("c")).select("row", "c.axis", "c.x")


def suggest_contrasts(unembedding: DataFrame, axes: np.ndarray, values: np.ndarray, n: int = 3, pool: int = 50, by: str = "cosine", only: Sequence[int] | None = None) -> DataFrame:
    """``(pc, rank, positive, negative, score, share)``: token pairs whose contrast is nearest to each principal axis.

    ``by='projection'`` pairs the token of n-th greatest with that of n-th
    least projection; ``by='cosine'`` compares the contrasts of the ``pool``
    greatest with the ``pool`` least (at most half the tokens) with the axis.
    ``share`` is the axis' part of the variance. Ties rank by token.
    """
    if by not in ("cosine", "projection"):
        raise ValueError("pairs are ranked by 'cosine' or 'projection'")
    if only is not None:
        if len(set(only)) < 2:
            raise ValueError("at least two tokens are needed")
        unembedding = unembedding.where(F.col("token").isin(list(only)))
    spark = unembedding.sparkSession
    total = float(values.sum()) or 1.0
    basis = spark.createDataFrame([(k, [float(x) for x in axes[:, k]], float(values[k]) / total) for k in range(axes.shape[1])], "pc int, v array<double>, share double")
    scored = unembedding.join(F.broadcast(basis)).select("pc", "token", "w", "v", "share", dot("w", "v").alias("x"))
    up = F.row_number().over(Window.partitionBy("pc").orderBy(F.desc("x"), "token"))
    down = F.row_number().over(Window.partitionBy("pc").orderBy("x", "token"))
    most = max(1, min(pool, unembedding.count() // 2)) if by == "cosine" else n
    top = scored.withColumn("r", up).where(F.col("r") <= most).select("pc", "share", "v", F.col("token").alias("positive"), F.col("w").alias("wp"), F.col("x").alias("xp"), F.col("r").alias("rp"))
    bottom = scored.withColumn("r", down).where(F.col("r") <= most).select("pc", F.col("token").alias("negative"), F.col("w").alias("wn"), F.col("x").alias("xn"), F.col("r").alias("rn"))
    if by == "projection":
        pairs = top.join(bottom, "pc").where("rp = rn AND positive <> negative").withColumn("score", F.col("xp") - F.col("xn"))
        return pairs.select("pc", F.col("rp").alias("rank"), "positive", "negative", "score", "share")
    difference = minus("wp", "wn")
    pairs = top.join(bottom, "pc").where("positive <> negative").withColumn("score", cosine(difference, F.col("v")))
    rank = F.row_number().over(Window.partitionBy("pc").orderBy(F.desc("score"), "positive", "negative"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= n).select("pc", "rank", "positive", "negative", "score", "share")


def axes_of(suggestions: DataFrame, rank: int = 1) -> list[tuple[int, int]]:
    """The contrasts of a rank, one for each principal axis, in order."""
    return [(r["positive"], r["negative"]) for r in suggestions.where(F.col("rank") == rank).orderBy("pc").collect()]


def facets(coordinates: DataFrame) -> DataFrame:
    """``(row, x_label, y_label, x, y)``: all ordered pairs of different coordinates ``(row, axis, x)`` of a row."""
    a = coordinates.select("row", F.col("axis").alias("x_label"), "x")
    b = coordinates.select("row", F.col("axis").alias("y_label"), F.col("x").alias("y"))
    return a.join(b, "row").where("x_label <> y_label").select("row", "x_label", "y_label", "x", "y")


def standardisation(vectors: DataFrame, column: str = "h", least: float = 1e-6) -> DataFrame:
    """``(j, mean, std)`` of every component; a spread below ``least`` counts as one.

    Sums are added up in tasks, about the first vector of each, so that
    large means lose no digits.
    """
    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, spread = 0, None, None
        for batch in batches:
            x = dense(batch.column(0))
            if not len(x):
                continue
            m, own = x.mean(0), ((x - x.mean(0)) ** 2).sum(0)
            if mean is None:
                n, mean, spread = len(x), m, own
            else:
                spread = spread + own + (m - mean) ** 2 * (n * len(x) / (n + len(x)))
                mean, n = mean + (m - mean) * (len(x) / (n + len(x))), n + len(x)
        if mean is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(mean), dtype=np.int32)), pa.array(np.full(len(mean), float(n))), pa.array(mean), pa.array(spread)], names=["j", "n", "m", "s"])

    parts = vectors.where(F.col(column).isNotNull()).select(doubles(column).alias("x")).mapInArrow(run, "j int, n double, m double, s double")
    # what tasks found is put together by the same rule
    gathered_parts = parts.groupBy("j").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum("s").alias("s"), F.collect_list(F.struct("n", "m")).alias("parts"))
    mean = F.col("nm") / F.col("n")
    between = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["n"] * (p["m"] - mean) * (p["m"] - mean))
    std = F.sqrt((F.col("s") + between) / F.col("n"))
    return gathered_parts.select("j", mean.alias("mean"), F.when(std < least, 1.0).otherwise(std).alias("std"))
