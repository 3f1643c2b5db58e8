"""State providers: hidden states, unembedding vectors and probabilities from tables.

All providers give the same shapes: ``states(row, h)``, ``unembedding(token,
w)`` and ``probs(row, token, p)``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, doubles, softmax
from ..session import BROADCAST_BYTES, materialise, ship, small
from .corpus import next_token
from .folds import dense

#: Bytes of an unembedding matrix that tasks may hold; it is a model parameter and does not grow with the corpus.
MODEL_BYTES = 512 << 20


def states(vectors: DataFrame, row: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> DataFrame:
    """``(row, h[, label])`` in double precision from a table of vectors; rows without a vector are left out."""
    keep = [F.col(label).alias("label")] if label else []
    return vectors.where(F.col(vector).isNotNull()).select(F.col(row).alias("row"), doubles(vector).alias("h"), *keep)


def centroid_unembedding(labelled: DataFrame, sharpness: float = 8.0) -> DataFrame:
    """``(token, w)``: a token for each label, its vector ``sharpness`` times the mean state."""
    long = labelled.select("label", F.posexplode("h").alias("j", "x"))
    mean = long.groupBy("label", "j").agg((F.avg("x") * sharpness).alias("x"))
    lists = mean.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("j", "x"))).alias("l"))
    return lists.select(F.col("label").alias("token"), F.col("l.x").alias("w"))


def usable_unembedding(sample: DataFrame, dim: int = 64, sharpness: float = 8.0) -> DataFrame:
    """``(token, w)``: every usable state of a working sample as a token, scaled to length ``sharpness``; a wide vocabulary."""
    ship(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            token, h = batch.column(0).to_numpy(), dense(batch.column(1))
            if not len(token):
                continue
            fine = (np.abs(h) <= 1e30).all(1) & (h != 0).any(1)  # neither null nor NaN
            token, h = token[fine], h[fine]
            new = np.concatenate([token[:1] != last, token[1:] != token[:-1]])
            last = token[-1] if len(token) else last
            token, h = token[new], h[new]
            w = h * sharpness / np.sqrt((h * h).sum(1))[:, None]
            lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, dim, dtype=np.int32), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(token), lists], names=["token", "w"])

    sized = sample.where(F.col("row_index").isNotNull() & (F.size("h") == dim)).select(F.col("row_index").cast("int").alias("token"), "h")
    return sized.repartition("token").sortWithinPartitions("token").mapInArrow(run, "token int, w array<double>")


def sharp_unembedding(labelled: DataFrame, tokens: int = 32, sharpness: float = 8.0) -> DataFrame:
    """``(token, w)``: the first ``tokens`` states themselves, scaled; a model with peaked predictions."""
    return labelled.where(F.col("row") < tokens).select(F.col("row").cast("int").alias("token"), F.transform("h", lambda x: x * sharpness).alias("w"))


def matrix(unembedding: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Token ids in order and the unembedding matrix, for tasks to hold; its size is checked."""
    size, width = unembedding.agg(F.count(F.lit(1)), F.max(F.size("w"))).first()
    if (size or 0) * (width or 0) * 8 > MODEL_BYTES:
        raise ValueError(f"an unembedding of {size} x {width} does not fit {MODEL_BYTES} bytes; restrict its tokens")
    rows = unembedding.orderBy("token").toArrow()
    weights = rows.column("w").combine_chunks()
    return rows.column("token").to_numpy(), weights.flatten().to_numpy().reshape(rows.num_rows, -1)


def as_row(unembedding: DataFrame) -> DataFrame:
    """The unembedding as one row ``(model)``, tokens and vectors in order, to be broadcast; its size is checked."""
    size, width = unembedding.agg(F.count(F.lit(1)), F.max(F.size("w"))).first()
    if (size or 0) * ((width or 0) * 8 + 32) > BROADCAST_BYTES:
        raise ValueError(f"an unembedding of {size} x {width} is too large for column expressions; use the folds, which hold it as a matrix")
    return F.broadcast(unembedding.agg(F.sort_array(F.collect_list(F.struct("token", "w"))).alias("model")))


def probabilities(state: DataFrame, unembedding: DataFrame) -> DataFrame:
    """``(row, token, p)``: the softmax of the products, in long form.

    For small vocabularies; large ones go through :mod:`.folds`, which never
    writes a row for each pair.
    """
    scored = state.join(as_row(unembedding)).select("row", F.col("model.token").alias("tokens"), F.transform("model", lambda m: dot("h", m["w"])).alias("l"))
    return scored.select("row", F.explode(F.arrays_zip("tokens", softmax("l").alias("p"))).alias("c")).select("row", F.col("c.tokens").alias("token"), F.col("c.p").alias("p"))


def observed(corpus: DataFrame) -> DataFrame:
    """``(row..., token, p)``: observed tokens as certain predictions."""
    return corpus.where("token IS NOT NULL").select("doc_id", "pos", "token", F.lit(1.0).alias("p"))


def bigram_model(corpus: DataFrame, alpha: float = 0.5) -> tuple[DataFrame, int]:
    """``(prev, token, n, total, p)`` of the bigrams that occur, and the size of the vocabulary.

    A bigram is two tokens at neighbouring positions of a document; ``p`` is
    its add-``alpha`` probability given ``prev``, over all tokens of the
    corpus, and ``total`` how often ``prev`` is followed by any. A token that
    never follows ``prev`` has ``alpha / (total + alpha * size)``; such
    pairs have no row, so the table is as large as what was observed.
    """
    held = corpus.where("token IS NOT NULL").select("doc_id", "pos", "token")
    counted = next_token(held).groupBy(F.col("token").alias("prev"), F.col("next").alias("token")).agg(F.count(F.lit(1)).alias("n"))
    counted = materialise(counted, "bigrams")
    size = held.select("token").distinct().count()
    context = counted.groupBy("prev").agg(F.sum("n").alias("total"))
    joined = counted.join(small(context, 24), "prev")
    return joined.select("prev", "token", "n", "total", ((F.col("n") + alpha) / (F.col("total") + alpha * size)).alias("p")), size


def bigram_predictions(model: DataFrame, size: int, targets: Sequence[int], alpha: float = 0.5) -> DataFrame:
    """``(prev, token, n, total, p)`` of every context of a :func:`bigram_model` and each of ``targets``, seen or not."""
    asked = F.explode(F.lit([int(t) for t in targets])).alias("token")
    grid = model.select("prev", "total").distinct().select("prev", "total", asked)
    seen = model.where(F.col("token").isin([int(t) for t in targets])).select("prev", "token", "n")
    filled = grid.join(small(seen, 24), ["prev", "token"], "left").fillna({"n": 0})
    return filled.select("prev", "token", "n", "total", ((F.col("n") + alpha) / (F.col("total") + alpha * size)).alias("p"))


def bigram_marginals(model: DataFrame, size: int, alpha: float = 0.5) -> DataFrame:
    """``(token, z)``: mean probability of every token over all contexts, by how often these occur.

    What contexts give to tokens that never follow them is a sum over
    contexts that is the same for every token, so no row for it is made.
    """
    contexts = model.select("prev", "total").distinct()
    whole, rest = contexts.agg(F.sum("total"), F.sum(F.col("total") * alpha / (F.col("total") + alpha * size))).first()
    seen = model.groupBy("token").agg(F.sum(F.col("total") * F.col("n") / (F.col("total") + alpha * size)).alias("more"))
    return seen.select("token", ((F.col("more") + F.lit(rest)) / F.lit(whole)).alias("z"))
