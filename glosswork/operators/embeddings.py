"""Static embeddings of tokens, from moments to singular vectors, and bases to look at states in."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import EPS
from ..session import BROADCAST_BYTES, small
from . import distinctiveness, moments, vectorspace

# The bases by name.
BASES = ("token", "global", "contrast")


@dataclass
class Embedding:
    """Vectors ``(token, e)`` with the singular values and the share of the squared norm they explain."""

    vectors: DataFrame
    values: np.ndarray
    explained: float


def embed(states: DataFrame, unembedding: DataFrame, k: int, alpha: float = 0.5, log_ratio: bool = True, centre: bool = False, targets: Sequence[int] | None = None, z: DataFrame | None = None, eps: float = EPS) -> Embedding:
    """Association values, moved to log-ratio coordinates unless told otherwise, and their singular vectors.

    ``targets`` restricts the rows; log-ratio coordinates need whole rows of
    the vocabulary as columns and all tokens as rows, so the two exclude each
    other. ``eps`` is the floor of probabilities in logarithms.
    """
    if log_ratio and targets is not None:
        raise NotImplementedError("log-ratio coordinates need all tokens; leave the targets out or the coordinates")
    pmi = moments.pmi(moments.moments(states, unembedding, targets, z), eps)
    rows = vectorspace.lists_of(moments.ilr_embedding(pmi), "t", "i", "y") if log_ratio else vectorspace.lists_of(pmi, "t", "w", "pmi")
    vectors, values, share = vectorspace.svd_embedding(rows, k, alpha, centre)
    return Embedding(vectors.withColumnRenamed("t", "token"), values, share)


def neighbours_of(embedding: DataFrame, vocab: DataFrame, words: Sequence[str], k: int = 10) -> DataFrame:
    """``(word, neighbour, score, rank)`` of the nearest tokens of some words."""
    tokens = resolve_tokens(vocab, words)
    v = embedding.select(F.col("token").cast("bigint").alias("id"), "e")
    found = vectorspace.nearest_tokens(v.where(F.col("id").isin(tokens)), v, k)
    names = small(vocab.select("token", "str"), 64)
    a, b = (names.select(F.col("token").cast("bigint").alias(i), F.col("str").alias(n)) for i, n in (("id", "word"), ("other", "neighbour")))
    return found.join(a, "id").join(b, "other", "left").select("word", "neighbour", "score", "rank")


def resolve_tokens(vocab: DataFrame, wanted: int | str | Sequence[int | str]) -> list[int]:
    """Token ids of ids and strings; one that the vocabulary does not have raises."""
    wanted = [wanted] if isinstance(wanted, (int, str)) else list(wanted)
    strings = [w for w in wanted if isinstance(w, str)]
    known = vocab.where(F.col("token").isin([w for w in wanted if not isinstance(w, str)]) | F.col("str").isin(strings)).select("token", "str").orderBy("token").collect()
    ids, by_string = {r["token"] for r in known}, {}
    for r in known:
        by_string.setdefault(r["str"], r["token"])
    out = []
    for w in wanted:
        token = by_string.get(w) if isinstance(w, str) else w if w in ids else None
        if token is None:
            raise ValueError(f"{w!r} is not in the vocabulary")
        out.append(token)
    return out


def decode(rows: DataFrame, vocab: DataFrame, column: str = "ids", out: str = "text", separator: str = "") -> DataFrame:
    """``rows`` with the text of an array of token ids; ids without a string are left out, a null array gives the empty text.

    A vocabulary within the broadcast bound is held by tasks and looked up
    by binary search; a larger one is joined, rows being keyed by their
    content meanwhile. Other columns stay, and rows may repeat.
    """
    named = vocab.where("token IS NOT NULL AND str IS NOT NULL").groupBy("token").agg(F.min("str").alias("str"))
    most = BROADCAST_BYTES // 64
    held = named.limit(most + 1).toArrow()
    if held.num_rows <= most:
        token = held.column("token").to_numpy()
        order = np.argsort(token)
        token, strings = token[order], np.array(held.column("str").to_pylist(), object)[order]

        @F.pandas_udf("string")
        def text_of(ids):
            def one(x) -> str:
                if x is None or not len(x) or not len(token):
                    return ""
                at = np.minimum(np.searchsorted(token, x), len(token) - 1)
                return separator.join(strings[at[token[at] == x]])

            return ids.map(one)

        return rows.withColumn(out, text_of(column))
    keyed = rows.select(F.struct(*rows.columns).alias("__row")).withColumn("__key", F.xxhash64(F.to_json("__row")))
    once = keyed.dropDuplicates(["__key"]).select("__key", F.posexplode(f"__row.{column}").alias("k", "token"))
    text = once.join(named, "token").groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("k", "str"))).alias("l")).select("__key", F.array_join("l.str", separator).alias(out))
    return keyed.join(text, "__key", "left").select("__row.*", F.coalesce(out, F.lit("")).alias(out))


def check_axes(pcs: Sequence[int], available: int) -> list[int]:
    """The axes asked for; at least two different ones that exist."""
    pcs = list(pcs)
    if len(set(pcs)) < 2 or min(pcs) < 0 or max(pcs) >= available:
        raise ValueError(f"axes {pcs} are not two or more of 0 to {available - 1}")
    return pcs


def coordinates(sample: DataFrame, unembedding: DataFrame, basis: str = "global", token: int | None = None, z_t: float | None = None, pcs: Sequence[int] = (0, 1, 2, 3), contrasts: Sequence[tuple[int, int]] = ()) -> DataFrame:
    """``(row, axis, x)``: states on the axes of a basis.

    'token' takes the weighted and centred principal axes of a token's
    states, 'global' the singular axes of all states, 'contrast' the given
    pairs of tokens. ``sample`` has ``row``, ``h`` and, for a token, ``log_z``.
    """
    if basis not in BASES:
        raise ValueError(f"unknown basis {basis!r}; one of {BASES}")
    if basis == "contrast":
        if len(dict.fromkeys(contrasts)) < 2:
            raise ValueError("two or more contrasts are needed")
        return vectorspace.on_axes(sample, vectorspace.contrast_axes(unembedding, contrasts))
    if basis == "token":
        if token is None or z_t is None:
            raise ValueError("a token and its marginal are needed")
        omega = distinctiveness.token_weights(sample, unembedding, token, z_t, stabilise=True)
        mean, axes, _ = vectorspace.principal_axes(sample.join(omega, "row"), "h", "omega")
    else:
        mean, (_, axes, _) = None, vectorspace.principal_axes(sample, "h", centred=False)
    chosen = check_axes(pcs, axes.shape[1])
    placed = vectorspace.project(sample.select("row", "h"), axes[:, chosen], mean)
    names = F.array(*[F.lit(f"pc{k + 1}") for k in chosen])
    return placed.select("row", F.posexplode("proj").alias("k", "x")).select("row", F.get(names, F.col("k")).alias("axis"), "x")
