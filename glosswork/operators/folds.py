"""Additive folds over states: one pass, partial sums in each task, one small shuffle.

Every statistic of a model over states that this library computes is a sum
over rows of a function of the state and its predictive distribution. A task
turns batches of states into probabilities with one matrix product and adds
up arrays; only the sums leave it, packed by blocks of rows, and are
added by block. What is shuffled depends on the vocabulary and the number of
tasks, not on the number of states. Sums for pairs of tokens are made by
blocks of tokens (:func:`target_blocks`), so that no task holds a matrix of
the squared vocabulary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Rows of a product held at a time, at most, and bytes of it.
BATCH_ROWS, BATCH_BYTES = 2048, 64 << 20

#: Bytes of a sum that a task holds, and of the pieces in which it is shuffled.
BLOCK_BYTES, PACK_BYTES = 64 << 20, 1 << 20

PACKED = "stat string, i int, width int, sums binary"
FOLD = "stat string, i int, j int, value double"

Kernel = Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]


def dense(lists: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def dense_ints(lists: pa.Array, width: int) -> np.ndarray:
    """A list column of ``width`` integers each as a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def log_softmax(logits: np.ndarray) -> np.ndarray:
    top = logits.max(1, keepdims=True)
    return logits - top - np.log(np.exp(logits - top).sum(1, keepdims=True))




def pack(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Named arrays of one or two dimensions as rows of :data:`PACKED`; ``i`` is the first row of a piece."""
    for name, value in sums.items():
        value = np.ascontiguousarray(np.atleast_2d(value) if value.ndim < 2 else value, np.float64)
        width = value.shape[1]
        step = max(1, PACK_BYTES // max(1, 8 * width))
        for at in range(0, len(value), step):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int32()), pa.array([width], pa.int32()), pa.array([value[at : at + step].tobytes()], pa.binary())], names=["stat", "i", "width", "sums"])


def added(packed: DataFrame) -> DataFrame:
    """``(stat, i, j, value)``: the pieces of all tasks, added by stat and first row."""

    def add(pieces: pa.Table) -> pa.Table:
        name, first, width = (pieces.column(c)[0].as_py() for c in ("stat", "i", "width"))
        total = np.sum([np.frombuffer(x.as_buffer(), np.float64) for x in pieces.column("sums")], axis=0)
        i, j = np.divmod(np.arange(total.size), max(1, width))
        return pa.table({"stat": pa.array([name] * total.size, pa.string()), "i": (i + first).astype(np.int32), "j": j.astype(np.int32), "value": total})

    return packed.groupBy("stat", "i").applyInArrow(add, FOLD)


def target_blocks(targets: int, width: int) -> list[slice]:
    """Consecutive stretches of targets of which the sums with ``width`` others fit :data:`BLOCK_BYTES`."""
    step = max(1, BLOCK_BYTES // max(1, 8 * width))
    return [slice(a, min(a + step, targets)) for a in range(0, targets, step)]


def batch_rows(width: int) -> int:
    return max(16, min(BATCH_ROWS, BATCH_BYTES // max(1, 8 * width)))


def fold(states: DataFrame, weights: np.ndarray, kernel: Kernel) -> DataFrame:
    """``(stat, i, j, value)``: sums over all rows of ``states(h)`` of what ``kernel(h, log_p)`` gives.

    ``weights`` is the unembedding matrix; ``log_p`` holds the logarithms of
    the softmax of ``h @ weights.T``. The kernel returns named arrays of one
    or two dimensions, already summed over its batch. Empty states give no rows,
    null ones are left out, and states of unequal length raise.
    """
    ship(states.sparkSession)
    step = batch_rows(len(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                h = dense(batch.column(0).slice(at, step))
                for name, value in kernel(h, log_softmax(h @ weights.T)).items():
                    sums[name] = sums[name] + value if name in sums else np.asarray(value, np.float64)
        yield from pack(sums)

    return added(states.where("h IS NOT NULL").select("h").mapInArrow(run, PACKED))


def fold_probabilities(rows: DataFrame, kernel: Callable[[np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """The same over stored distributions ``rows(p)``, for samples that hold probabilities instead of states."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in kernel(dense(batch.column(0))).items():
                sums[name] = sums[name] + value if name in sums else np.asarray(value, np.float64)
        yield from pack(sums)

    return added(rows.where("p IS NOT NULL").select("p").mapInArrow(run, PACKED))


def stat(folded: DataFrame, name: str, i: str, j: str | None = None, value: str = "value") -> DataFrame:
    """One statistic of a fold; a one-dimensional one has its index in ``i``."""
    part = folded.where(F.col("stat") == name)
    if j is None:
        return part.select(F.col("j").alias(i), F.col("value").alias(value))
    return part.select(F.col("i").alias(i), F.col("j").alias(j), F.col("value").alias(value))
