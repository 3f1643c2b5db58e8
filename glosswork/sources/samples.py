"""Samples of states: extraction with its metadata, opening, checking, and the working sample."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import doubles, project_out
from ..functions.windowing import resolve
from ..operators.corpus import sampled, window_average
from ..operators.distinctiveness import with_log_partition
from ..operators.folds import fold, fold_probabilities, log_softmax, stat
from ..operators.providers import matrix
from ..operators.similarity import QUANTITIES, pair_similarities
from ..operators.vectorspace import principal_axes, project
from ..session import discard, materialise, small

# Names under which a sample may lie, in the order they are tried.
SUFFIXES = ("_h", "_probs", "_h_eff")


@dataclass
class ExtractMeta:
    """What an extraction was made of, kept as JSON beside its tables."""

    corpus_length: int
    window: int
    forward_window: int
    backward_window: int
    min_context: int
    n_valid: int
    d: int
    v: int
    averaging: str
    kind: str
    offsets: list


def write_meta(spark: SparkSession, path: str, meta: ExtractMeta) -> None:
    spark.createDataFrame([(json.dumps(asdict(meta)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_meta(spark: SparkSession, path: str) -> ExtractMeta:
    """The metadata of an extraction; older ones without extents take the window for them."""
    facts = json.loads(spark.read.text(path, wholetext=True).first()[0])
    window = facts.get("window", 0)
    facts = {"forward_window": window, "backward_window": window, "offsets": [], "kind": "h", "averaging": "aitchison"} | facts
    return ExtractMeta(**{k: facts[k] for k in ExtractMeta.__dataclass_fields__})


def sample_kind(rows: DataFrame, d: int, v: int, column: str = "h") -> str:
    """'h' for states of ``d`` numbers, 'probs' for distributions over ``v`` tokens; 'h' where both agree."""
    sizes = {r[0] for r in rows.select(F.size(column)).distinct().limit(3).collect()}
    if sizes == {d}:
        return "h"
    if sizes == {v}:
        return "probs"
    raise ValueError(f"rows have {sorted(sizes)} numbers, not {d} or {v}")


def checked_distributions(rows: DataFrame, column: str = "p", tolerance: float = 1e-2) -> DataFrame:
    """``rows``; reading one whose numbers are negative or do not sum to one fails."""
    total = F.aggregate(doubles(column), F.lit(0.0), lambda s, x: s + x)
    good = (F.abs(total - 1.0) <= tolerance) & (F.array_min(column) >= 0)
    return rows.where(F.coalesce(F.assert_true(good, F.lit("a row is no distribution")).isNull(), F.lit(True)))


def locate(spark: SparkSession, folder: str, name: str) -> str:
    """The path of a sample in a folder, states before distributions."""
    jvm = spark.sparkContext._jvm
    for suffix in SUFFIXES:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}{suffix}.parquet")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return path.toString()
    raise FileNotFoundError(f"no sample {name} in {folder}")


def probability_scan(sample: DataFrame, unembedding: DataFrame, kind: str = "h") -> DataFrame:
    """``(row, p)`` of either kind of sample: the softmax of states, or the stored distributions."""
    if kind == "probs":
        return sample.select("row", doubles("p").alias("p"))
    _, weights = matrix(unembedding)

    @F.pandas_udf("array<double>")
    def predicted(h):
        if not len(h):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.exp(log_softmax(np.stack(h.to_numpy()) @ weights.T))))

    return sample.select("row", predicted(doubles("h")).alias("p"))


def window_states(states: DataFrame, offsets: DataFrame, averaging: str = "aitchison", least: int = 0) -> DataFrame:
    """``(doc_id, pos, v)``: states ``(doc_id, pos, v)`` averaged over the window of every whole position.

    'aitchison' averages states (the softmax of the mean is then a geometric
    mean), 'probability' distributions; either way ``v`` is the array to
    average. A window of the position itself passes rows through.
    """
    if averaging not in ("aitchison", "probability"):
        raise ValueError("averaging is 'aitchison' or 'probability'")
    window = resolve(offsets)
    kept = states.where(F.col("pos") >= 0)
    if window.trivial:
        return kept.where(F.col("pos") >= least).select("doc_id", "pos", "v")
    mean = window_average(kept.select("doc_id", "pos", doubles("v").alias("v")), offsets)
    return mean.where(F.col("pos") >= window.context(least))


def extract(states: DataFrame, unembedding: DataFrame, offsets: DataFrame, folder: str, name: str, averaging: str = "aitchison", least: int = 0, direction: Sequence[float] | None = None, subsample: int | None = None, save_states: bool = True) -> ExtractMeta:
    """Write states, marginals and metadata of a corpus pass to ``folder``.

    ``states(doc_id, pos, v)`` are the model's states. They are averaged over
    the window, with ``direction`` projected off it, optionally cut to a
    uniform ``subsample``, and written once; marginals are sums over what
    was written. Without ``save_states`` the averaged states are written for
    the pass only, and marginals, ``subsample`` and metadata stay.
    """
    spark = states.sparkSession
    window = resolve(offsets)
    tokens, weights = matrix(unembedding)
    kind = "h" if averaging == "aitchison" or window.trivial else "probs"
    rows = window_states(states, offsets, averaging if kind == "probs" else "aitchison", least)
    if direction is not None:
        rows = rows.withColumn("v", project_out(doubles("v"), F.array(*[F.lit(float(x)) for x in direction])))
    if save_states:
        path = f"{folder}/{name}_{kind}.parquet"
        rows.write.mode("overwrite").parquet(path)
        written = spark.read.schema(rows.schema).parquet(path)
    else:
        written = materialise(rows, "averaged")
    n = written.count()
    if kind == "probs":
        folded = fold_probabilities(written.select(doubles("v").alias("p")), lambda p: {"z": p.sum(0)} if p.size else {})
    else:
        folded = fold(written.select(doubles("v").alias("h")), weights, lambda h, log_p: {"z": np.exp(log_p).sum(0)})
    sums = stat(folded, "z", "place", value="z_sum")
    names = spark.createDataFrame([(k, int(t)) for k, t in enumerate(tokens)], "place int, token int")
    z = sums.join(small(names, 16), "place").select("token", (F.col("z_sum") / F.lit(float(max(1, n)))).alias("z"), "z_sum")
    z.write.mode("overwrite").parquet(f"{folder}/{name}_Z.parquet")
    if subsample:
        sampled(written, ["doc_id", "pos"], subsample).write.mode("overwrite").parquet(f"{folder}/{name}_sub.parquet")
    if not save_states:
        discard(written)
    meta = ExtractMeta(states.count(), max(window.forward, window.backward), window.forward, window.backward, window.context(least), n, weights.shape[1], len(tokens), averaging, kind, [list(o) for o in window.offsets])
    write_meta(spark, f"{folder}/{name}_meta", meta)
    return meta


def window_pair_similarities(pairs: DataFrame, states: DataFrame, unembedding: DataFrame, offsets: DataFrame, quantities: Sequence[str] = QUANTITIES, least: int = 0) -> DataFrame:
    """The quantities of :func:`~..operators.similarity.pair_similarities` over states averaged in a window, without a stored sample.

    ``states(doc_id, pos, v)`` are those of a corpus pass; the averages are
    the states that an extraction with the same window would have stored.
    """
    averaged = window_states(states, offsets, "aitchison", least)
    return pair_similarities(pairs, averaged.select(doubles("v").alias("h")), unembedding, quantities)


def working_sample(states: DataFrame, unembedding: DataFrame, n: int = 200_000, axes: int = 0, path: str | None = None) -> DataFrame:
    """``(row_index, h, log_z[, proj])``: a uniform subsample with what later questions need.

    ``log_z`` is the logarithm of each state's partition sum; with ``axes``
    the projections on the first uncentred singular axes are kept too. With
    ``path`` the sample is written and read back.
    """
    few = sampled(states.select(F.col("row").alias("row_index"), "h"), ["row_index"], n)
    sample = with_log_partition(few, unembedding)
    if axes:
        _, basis, _ = principal_axes(few, "h", centred=False)
        sample = project(sample, basis[:, :axes])
    if path:
        sample.write.mode("overwrite").parquet(path)
        sample = states.sparkSession.read.schema(sample.schema).parquet(path)
    return sample


def load_working_sample(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def pairs_in(spark: SparkSession, path: str, word1: str = "word1", word2: str = "word2") -> DataFrame:
    """Word pairs with any other columns from CSV, plain or compressed; the columns named become ``word1`` and ``word2``."""
    df = spark.read.csv(path, header=True)
    missing = {word1, word2} - set(df.columns)
    if missing:
        raise ValueError(f"columns {sorted(missing)} are missing")
    return df.withColumnsRenamed({word1: "word1", word2: "word2"})


def pairs_out(pairs: DataFrame, path: str, compression: str | None = None) -> None:
    pairs.write.mode("overwrite").csv(path, header=True, compression=compression or "none")
