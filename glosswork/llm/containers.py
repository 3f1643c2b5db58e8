"""Filling containers of fixed capacity with items of varying length (problem 7).

Optimal length buckets: dynamic programming over the global histogram of
lengths chooses bucket boundaries that leave least space unused; token-budget
batches form inside each bucket. What space a batch has left is topped up
from shorter buckets in a second step. Both run on the histogram, which has
no more entries than a container has places; items then find their batch by
their number among items of the same length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, ship, small
from .encode import VOCABULARY, encode

#: Tokens a container holds, and length buckets.
CAPACITY, BUCKETS = 2048, 16

#: Items that one task numbers at a time.
NUMBERED = 1_000_000


def bucket_bounds(counts: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets; ``counts[s]`` items have length ``s``, up to the capacity.

    A container of a bucket with upper length ``u`` has ``capacity // u``
    slots, so an item of length ``s`` leaves ``capacity / (capacity // u) - s``
    places unused, padding and remainder together. Dynamic programming finds
    the bounds with the least sum.
    """
    capacity = len(counts) - 1
    lengths = np.flatnonzero(counts[1:]) + 1
    if not len(lengths):
        return []
    number = np.r_[0, np.cumsum(counts[lengths])].astype(float)
    tokens = np.r_[0, np.cumsum(counts[lengths] * lengths)].astype(float)
    slot = capacity / (capacity // lengths)
    n = len(lengths)
    # cost[i, j]: a bucket of the lengths i .. j
    cost = (number[None, 1:] - number[:-1, None]) * slot[None, :] - (tokens[None, 1:] - tokens[:-1, None])
    cost[np.tril_indices(n, -1)] = np.inf
    best, came = cost[0].copy(), [np.zeros(n, int)]
    for _ in range(1, min(buckets, n)):
        through = np.r_[np.inf, best[:-1]][:, None] + cost
        start = through.argmin(0)
        came.append(start)
        best = through[start, np.arange(n)]
    bounds, j = [], n - 1
    for start in reversed(came):
        bounds.append(int(lengths[j]))
        j = start[j] - 1
        if j < 0:
            break
    return bounds[::-1]


def bucket_batch(left: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """``(length, each)`` of one batch of the bucket of lengths above ``low`` up to ``high``: as many items as its token budget has slots, longest first."""
    slots, batch = (len(left) - 1) // high, []
    for s in np.flatnonzero(left[low + 1 : high + 1])[::-1] + low + 1:
        each = int(min(slots, left[s]))
        batch.append((int(s), each))
        slots -= each
        if not slots:
            break
    return batch


def top_up(left: np.ndarray, room: int, low: int) -> list[tuple[int, int]]:
    """``(length, each)`` of items of lengths up to ``low`` that fit into ``room``, the longest that fits first."""
    added = []
    while room > 0:
        fit = np.flatnonzero(left[1 : min(room, low) + 1])
        if not len(fit):
            break
        s = int(fit[-1]) + 1
        each = int(min(room // s, left[s]))
        added.append((s, each))
        room -= s * each
        low = s - 1
    return added


def plan(counts: np.ndarray, bounds: list[int], topped: bool = True) -> tuple[np.ndarray, int]:
    """``(length, from, to, container, each, home)`` segments and the number of containers.

    Items of ``length`` numbered ``from .. to - 1`` lie ``each`` to a
    container, from number ``container`` on; ``home`` is the upper length of
    the container's bucket. A bucket with upper length ``u`` gives batches of
    ``capacity // u`` of its items, so the bounds decide what lies together;
    then, unless ``topped`` is False, the space that a batch has left takes
    items of shorter buckets. A batch is repeated as long as its lengths
    last, so the plan has a few batches for each length whatever the number
    of items.
    """
    capacity = len(counts) - 1
    left = counts.astype(np.int64).copy()
    left[0] = 0
    taken = np.zeros_like(left)
    out, containers = [], 0
    for low, high in reversed(list(zip([0, *bounds[:-1]], bounds))):
        while left[low + 1 : high + 1].any():
            batch = bucket_batch(left, low, high)
            if topped:
                batch += top_up(left, capacity - sum(s * each for s, each in batch), low)
            times = int(min(left[s] // each for s, each in batch))
            for s, each in batch:
                out.append((s, taken[s], taken[s] + each * times, containers, each, high))
                taken[s] += each * times
                left[s] -= each * times
            containers += times
    segments = np.array(sorted(out), np.int64).reshape(-1, 6)
    return segments, containers


def _assign(segments: np.ndarray, bounds: list[int]):
    begin = segments[:, 0] << 44 | segments[:, 1]
    upper = np.array(bounds or [0], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            at = np.searchsorted(begin, size << 44 | rank, side="right") - 1
            place = segments[at, 3] + (rank - segments[at, 1]) // segments[at, 4]
            bucket = upper[np.searchsorted(upper, size)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(bucket), pa.array(place), pa.array(segments[at, 5])], names=["doc_id", "piece", "start", "n_tokens", "bucket", "container", "home"])

    return run


def fill(sizes: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, piece, start, n_tokens, bucket, container, home)`` for ``sizes(doc_id, n_ids)``.

    Every item lies whole in one container of ``capacity`` tokens, except
    that one larger than that is divided into pieces of ``capacity`` tokens
    and a last one with the rest; only those have more than one ``piece``
    (from 0; ``start`` is its first token). ``bucket`` is the upper length of
    its length bucket, ``home`` that of the bucket whose batch the container
    holds: at most ``capacity // home`` items of it, and items of shorter
    buckets in what space was left. An item without tokens, or of null size, needs no
    place: one row with ``container``, ``bucket`` and ``home`` null. Repeated rows are
    items of their own, a null ``doc_id`` stays null, equal lengths are
    placed in order of ``doc_id``; an empty table gives no rows.
    """
    ship(sizes.sparkSession)
    size = F.coalesce("n_ids", F.lit(0)).cast("bigint")
    last = F.greatest(F.ceil(size / capacity) - 1, F.lit(0)).cast("bigint")
    pieces = sizes.select("doc_id", size.alias("size"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    start = F.col("piece") * capacity
    pieces = pieces.select("doc_id", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("size") - start).cast("bigint").alias("n_tokens"))
    histogram = pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity + 1 rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in histogram:
        counts[r["n_tokens"]] = r["n"]
    bounds = bucket_bounds(counts, buckets)
    segments, _ = plan(counts, bounds)
    # number the items of each length: within salted parts where a length has many, then by the parts before
    salts = F.get(F.lit([int(max(1, -(-n // NUMBERED))) for n in counts]), F.col("n_tokens").cast("int"))
    salted = pieces.where("n_tokens > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), salts))
    parts = salted.groupBy("n_tokens", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = parts.select("n_tokens", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("within", within).join(small(offset, 24), ["n_tokens", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "n_tokens", (F.col("offset") + F.col("within") - 1).alias("rank"))
    kind = sizes.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece bigint, start bigint, n_tokens bigint, bucket bigint, container bigint, home bigint"
    placed = ranked.mapInArrow(_assign(segments, bounds), schema)
    none = F.lit(None).cast("bigint")
    empty = pieces.where("n_tokens = 0").select("doc_id", "piece", "start", "n_tokens", none.alias("bucket"), none.alias("container"), none.alias("home"))
    return placed.unionByName(empty)


def document_sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_ids)``: token counts of all texts, written once since several steps need them."""
    return materialise(encode(documents, vocabulary=vocabulary, counts_only=True), "sizes")


def divided(placed: DataFrame) -> DataFrame:
    """The ``doc_id`` of the items that had to be divided."""
    return placed.where("piece = 1").select("doc_id")


def fill_report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens in them and the share of their places that is filled."""
    whole = placed.where("container IS NOT NULL").agg(F.countDistinct("container").alias("containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))
    return whole.withColumn("filled", F.col("tokens") / F.nullif(F.col("containers") * capacity, F.lit(0)))


def faults(placed: DataFrame, sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row ``(documents, lost, divided_small, overfull, crowded)`` that tells whether a filling is whole.

    ``lost`` counts documents whose pieces do not add up to their size,
    ``divided_small`` those that were divided though they fit, ``overfull``
    containers above ``capacity``, ``crowded`` containers with more items of
    their own bucket than it has slots. Rows of one ``doc_id``, null too,
    count as one document.
    """
    size = sizes.select("doc_id", F.coalesce("n_ids", F.lit(0)).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("n_tokens"), F.lit(0).cast("bigint").alias("piece"))
    both = size.unionByName(placed.select("doc_id", F.lit(0).cast("bigint").alias("size"), "n_tokens", "piece"))
    by_doc = both.groupBy("doc_id").agg(F.sum("size").alias("size"), F.sum("n_tokens").alias("n"), F.max("piece").alias("last"))
    by_container = placed.where("container IS NOT NULL").groupBy("container", "home").agg(F.sum("n_tokens").alias("load"), F.count_if(F.col("bucket") == F.col("home")).alias("own"))
    none = F.lit(0).cast("bigint")
    found = by_doc.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("n") != F.col("size")).alias("lost"),
        F.count_if((F.col("last") > 0) & (F.col("size") <= capacity)).alias("divided_small"),
        none.alias("overfull"),
        none.alias("crowded"),
    ).unionByName(
        by_container.agg(
            none.alias("documents"),
            none.alias("lost"),
            none.alias("divided_small"),
            F.count_if(F.col("load") > capacity).alias("overfull"),
            F.count_if(F.col("own") > F.floor(F.lit(capacity) / F.col("home"))).alias("crowded"),
        )
    )
    return found.agg(*(F.sum(c).alias(c) for c in ("documents", "lost", "divided_small", "overfull", "crowded")))
