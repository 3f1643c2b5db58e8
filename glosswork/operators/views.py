"""Views of a sample: density grids, distinctiveness grids and labelled instances, ready to be drawn."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small
from . import corpus, density, distinctiveness
from .embeddings import coordinates, resolve_tokens
from .vectorspace import facets

#: States that an empirical view takes at most.
EMPIRICAL_ROWS = 10_000


def density_view(sample: DataFrame, unembedding: DataFrame, marginals: dict[int, float] | None = None, n: int = 64, **basis) -> DataFrame:
    """``(x_label, y_label[, token], gi, gj, x, y, density)`` of all states, or of tokens with their marginals.

    Facets are all ordered pairs of the axes of ``basis``; densities of
    tokens are scaled to a greatest value of one in each facet.
    """
    points = facets(coordinates(sample, unembedding, **basis))
    keys = ["x_label", "y_label"]
    if not marginals:
        return density.kernel_density(points.withColumn("w", F.lit(1.0)), keys, n)
    parts = None
    for token, z in marginals.items():
        omega = distinctiveness.token_weights(sample, unembedding, token, z, stabilise=True).withColumnRenamed("omega", "w")
        one = points.join(omega, "row").withColumn("token", F.lit(token))
        parts = one if parts is None else parts.unionByName(one)
    return density.scaled_density(parts, keys, "token", n)


def distinctiveness_view(sample: DataFrame, unembedding: DataFrame, token: int, z_t: float, n: int = 64, clip: float | None = None, **basis) -> DataFrame:
    """``(x_label, y_label, gi, gj, x, y, log_ratio)``: where a token is more probable than overall."""
    points = facets(coordinates(sample, unembedding, **basis))
    omega = distinctiveness.token_weights(sample, unembedding, token, z_t, stabilise=True).withColumnRenamed("omega", "w")
    return density.log_ratio_density(points.join(omega, "row"), ["x_label", "y_label"], n, clip=clip)


def empirical_view(sample: DataFrame, unembedding: DataFrame, places: DataFrame, tokens: DataFrame, wanted: Sequence[int], n: int = 64, most: int = EMPIRICAL_ROWS, **basis) -> DataFrame:
    """Densities of the states that were in fact followed by a token; ``places(row, doc_id, pos)`` says where states were taken."""
    points = facets(coordinates(sample, unembedding, **basis))
    following = tokens.select("doc_id", (F.col("pos") - 1).alias("pos"), "token").where(F.col("token").isin(list(wanted)))
    hits = places.join(following, ["doc_id", "pos"]).select("row", "token")
    few = None
    for token in wanted:
        one = corpus.sampled(hits.where(F.col("token") == token), ["row"], most)
        few = one if few is None else few.unionByName(one)
    return density.scaled_density(points.join(small(few, 16), "row").withColumn("w", F.lit(1.0)), ["x_label", "y_label"], "token", n)


def instances(sample: DataFrame, unembedding: DataFrame, places: DataFrame, tokens: DataFrame, vocab: DataFrame, k: int, followed_by: int | None = None, context: int = 8, **basis) -> DataFrame:
    """``(row, doc_id, pos, label, axes)``: ``k`` random states with their text and coordinates.

    ``places(row, doc_id, pos)`` must have a place for every state.
    """
    rows = sample.select("row")
    if rows.join(places, "row", "left_anti").limit(1).count():
        raise ValueError("a state has no place")
    eligible = rows.join(places, "row").join(tokens.select("doc_id", (F.col("pos") - 1).alias("pos"), F.col("token").alias("next")), ["doc_id", "pos"])
    if followed_by is not None:
        eligible = eligible.where(F.col("next") == followed_by)
    chosen = corpus.sampled(eligible.select("row", "doc_id", "pos"), ["row"], k)
    labels = corpus.labelled_places(tokens, chosen, vocab, context)
    on = coordinates(sample, unembedding, **basis).join(small(chosen.select("row"), 8), "row", "left_semi")
    axes = on.groupBy("row").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("axis", "x")))).alias("axes"))
    return chosen.join(labels, ["doc_id", "pos"]).join(axes, "row").select("row", "doc_id", "pos", "label", "axes")


def phrases(corpus_rows: DataFrame, states: DataFrame, vocab: DataFrame, texts: Sequence[str], most: int | None = None) -> DataFrame:
    """``(label, j, x)``: mean state before the end of each phrase, given as words of the vocabulary."""
    out = None
    for text in texts:
        ids = resolve_tokens(vocab, text.split())
        one = corpus.phrase_state(corpus_rows, states, ids, most).withColumn("label", F.lit(text))
        out = one if out is None else out.unionByName(one)
    return out
