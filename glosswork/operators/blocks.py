"""Moments of a vocabulary that neither the driver nor a task holds whole.

States and unembedding vectors are packed into blocks of about a megabyte, and
every block of states meets every block of tokens in a task. A first pass adds
up the partition sum of each state, a second one the products with the targets;
of the vocabulary only these reach the driver. States below a checked bound are
held by tasks, so that a task has all sums of its tokens; above it the blocks of
both sides are joined, and the sums of a token are added up after that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, ship
from .folds import dense, target_blocks

#: Rows of a block of states and of tokens, at most, and bytes of either.
STATE_ROWS, TOKEN_ROWS, STACK_BYTES = 2048, 1024, 1 << 20

#: Bytes of states that tasks hold.
STATE_BYTES = 16 << 20

#: Bytes of partition sums that a task holds before it passes them on, or of what it keeps of the targets; rows of a batch of results.
HELD_BYTES, OUT_ROWS = 32 << 20, 1 << 17

STACK = "id bigint, n int, h binary"


def _rows(most: int, width: int) -> int:
    return max(16, min(most, STACK_BYTES // max(1, 8 * width)))


def _regrouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches joined and cut to ``rows`` rows each; the last has what is left."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = min(rows - n, batch.num_rows - at)
            held.append(batch.slice(at, take))
            n, at = n + take, at + take
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _matrix(packed: pa.Scalar, rows: int) -> np.ndarray:
    return np.frombuffer(packed.as_buffer(), np.float64).reshape(rows, -1)


def stacked_states(states: DataFrame, width: int) -> DataFrame:
    """``(id, n, h)``: the states that are not null as matrices of many rows, written down so that ids stay."""
    rows = _rows(STATE_ROWS, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, part in enumerate(_regrouped(batches, rows)):
            h = dense(part.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([first + k], pa.int64()), pa.array([len(h)], pa.int32()), pa.array([h.tobytes()], pa.binary())], names=["id", "n", "h"])

    return materialise(states.where("h IS NOT NULL").select("h").mapInArrow(run, STACK), "states")


Held = dict[int, tuple[np.ndarray, np.ndarray | None]]

Pairs = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray | None]]]


def paired(unembedding: DataFrame, width: int, stacks: DataFrame | None, held: Held | None = None) -> tuple[DataFrame, Pairs]:
    """A DataFrame, and what makes ``(tokens, w, id, h, log_z)`` of all pairs of blocks from its batches.

    Blocks of states come from ``held``, or else from ``stacks`` by a join.
    Pairs with the same tokens follow each other and share one array of tokens.
    """
    rows = _rows(TOKEN_ROWS, width)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part in _regrouped(batches, rows):
            yield part.column(0).to_numpy().astype(np.int64), dense(part.column(1))

    def with_held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for tokens, w in blocks(batches):
            for k, (h, log_z) in held.items():
                yield tokens, w, k, h, log_z

    def pack_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, w in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([tokens.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary())], names=["tokens", "w"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last, tokens = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(c)[r] for c, name in enumerate(batch.schema.names)}
                if (key := row["tokens"].as_py()) != last:
                    last, tokens = key, np.frombuffer(key, np.int64)
                log_z = np.frombuffer(row["log_z"].as_buffer(), np.float64) if "log_z" in row else None
                yield tokens, _matrix(row["w"], len(tokens)), row["id"].as_py(), _matrix(row["h"], row["n"].as_py()), log_z

    vectors = unembedding.select("token", "w")
    if held is not None:
        return vectors, with_held
    return vectors.mapInArrow(pack_tokens, "tokens binary, w binary").crossJoin(stacks), joined


def log_partitions(met: DataFrame, pairs: Pairs) -> DataFrame:
    """``(id, log_z)``: the logarithms of the partition sums of every block of states, packed."""

    def packed(sums: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for k, (top, mass) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([top.tobytes()], pa.binary()), pa.array([mass.tobytes()], pa.binary())], names=["id", "top", "mass"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held = 0
        for _, w, k, h, _ in pairs(batches):
            logits = h @ w.T
            top = logits.max(1)
            logits -= top[:, None]
            mass = np.exp(logits, out=logits).sum(1)
            if k in sums:
                sums[k] = _merged(*sums[k], top, mass)
            else:
                sums[k] = top, mass
                held += 16 * len(top)
            if held > HELD_BYTES:
                yield from packed(sums)
                sums, held = {}, 0
        yield from packed(sums)

    def merge(pieces: pa.Table) -> pa.Table:
        top, mass = None, None
        for a, b in zip(pieces.column("top"), pieces.column("mass")):
            piece = np.frombuffer(a.as_buffer(), np.float64), np.frombuffer(b.as_buffer(), np.float64)
            top, mass = piece if top is None else _merged(top, mass, *piece)
        return pa.table({"id": pieces.column("id").slice(0, 1), "log_z": pa.array([(top + np.log(mass)).tobytes()], pa.binary())})

    parts = met.mapInArrow(run, "id bigint, top binary, mass binary")
    return parts.groupBy("id").applyInArrow(merge, "id bigint, log_z binary")


def _merged(top: np.ndarray, mass: np.ndarray, top2: np.ndarray, mass2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    high = np.maximum(top, top2)
    return high, mass * np.exp(top - high) + mass2 * np.exp(top2 - high)


def target_moments(states: DataFrame, unembedding: DataFrame, width: int, targets: np.ndarray, weights: np.ndarray) -> DataFrame:
    """``(t, w, m, z_t, z_w)`` of ``targets`` with their unembedding vectors ``weights``, with every token."""
    spark = states.sparkSession
    ship(spark)
    stacks = stacked_states(states, width)
    n, size = stacks.agg(F.sum("n"), F.sum(F.length("h"))).first()
    whole = (size or 0) <= STATE_BYTES
    if whole:
        held: Held = {r["id"]: (np.frombuffer(r["h"], np.float64).reshape(r["n"], -1), None) for r in stacks.collect()}
        sums = log_partitions(*paired(unembedding, width, None, held)).collect()
        met, pairs = paired(unembedding, width, None, {r["id"]: (held[r["id"]][0], np.frombuffer(r["log_z"], np.float64)) for r in sums})
    else:
        sums = log_partitions(*paired(unembedding, width, stacks))
        met, pairs = paired(unembedding, width, materialise(stacks.join(sums, "id"), "partition_sums"))

    def products(block: slice):
        ids, own = targets[block], weights[block]

        def packed(words: np.ndarray, m: np.ndarray, z_t: np.ndarray, z_w: np.ndarray) -> Iterator[pa.RecordBatch]:
            step = max(1, OUT_ROWS // len(words))
            for a in range(0, len(ids), step):
                t = ids[a : a + step]
                columns = [np.repeat(t, len(words)), np.tile(words, len(t)), m[a : a + step].ravel(), np.repeat(z_t[a : a + step], len(words)), np.tile(z_w, len(t))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["t", "w", "m", "z_t", "z_w"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, sums, focus = None, None, {}  # focus: probabilities of the targets at blocks of states
            for found, w, k, h, log_z in pairs(batches):
                if found is not words:
                    if words is not None:
                        yield from packed(words, *sums)
                    words, sums = found, None
                log_z = log_z[:, None]
                if k not in focus:
                    if (len(focus) + 1) * len(h) * len(own) * 8 > HELD_BYTES:
                        focus = {}
                    focus[k] = np.exp(h @ own.T - log_z)
                p = h @ w.T
                p -= log_z
                np.exp(p, out=p)
                part = focus[k].T @ p, focus[k].sum(0), p.sum(0)
                sums = part if sums is None else tuple(a + b for a, b in zip(sums, part))
            if words is not None:
                yield from packed(words, *sums)

        return run

    parts = None
    for block in target_blocks(len(targets), max(_rows(STATE_ROWS, width), _rows(TOKEN_ROWS, width))):
        part = met.mapInArrow(products(block), "t bigint, w bigint, m double, z_t double, z_w double")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = spark.createDataFrame([], "t bigint, w bigint, m double, z_t double, z_w double")
    if not whole:
        parts = parts.groupBy("t", "w").agg(*[F.sum(c).alias(c) for c in ("m", "z_t", "z_w")])
    means = [(F.col(c) / F.lit(float(n or 1))).alias(c) for c in ("m", "z_t", "z_w")]
    return parts.select(F.col("t").cast("int"), F.col("w").cast("int"), *means)
