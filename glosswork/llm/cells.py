"""Grid cells of variable resolution for vectors.

Each of several independent grids quantises features of a vector, one bit a
feature: on which side of a plane it lies. Planes are fitted on a bounded
sample: their direction is the difference of two sample vectors, their place
the sparsest one in the middle half of the sample, so that planes run
between dense regions. The bits form a long string; a cell is a prefix of
it, just long enough that the cell holds at most ``cap`` vectors. Cells that
stay above it at full length (copies, say) are divided by a hash of the id;
who divides them must compare the parts in another way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, ship, small, tasks_for

#: Vectors that the planes are fitted on, at most; every vector is placed.
SAMPLE = 4096

#: Bits of a string, how many are counted at first, and by how many a prefix grows at a time.
BITS, FIRST_BITS, STEP = 24, 12, 2

#: Bytes of a row of the depth table when broadcast.
DEPTH_BYTES = 48


def unit_rows(lists: pa.ListArray, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are usable, and their vectors scaled to length one, in float64.

    Usable: not null, exactly ``dim`` numbers, all finite, not all zero.
    ``dim`` None takes any length and pads with zeros.
    """
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = np.diff(lists.offsets.to_numpy())
    ok = ~np.asarray(lists.is_null()) & ((size == dim) if dim else (size > 0))
    width = dim or int(size.max(initial=1))
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    begin = lists.offsets.to_numpy()[:-1]
    if dim:
        vectors = flat[begin[ok][:, None] + np.arange(width)] if ok.any() else np.zeros((0, width))
    else:
        vectors, length = np.zeros((int(ok.sum()), width)), size[ok]
        row = np.repeat(np.arange(len(length)), length)
        column = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        vectors[row, column] = flat[np.repeat(begin[ok], length) + column]
    with np.errstate(invalid="ignore", over="ignore"):
        good = np.isfinite(vectors).all(1) & (vectors != 0).any(1)
    ok[np.flatnonzero(ok)[~good]] = False
    vectors = vectors[good]
    vectors = vectors / np.abs(vectors).max(1, keepdims=True) if len(vectors) else vectors
    return ok, vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def as_binary(vectors: np.ndarray, kind: str) -> pa.Array:
    """Each row of ``vectors`` as the bytes of its numbers of type ``kind``."""
    raw = np.ascontiguousarray(vectors.astype(kind))
    ends = (np.arange(len(raw) + 1) * (raw.shape[1] * raw.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(raw.tobytes())])


def from_binary(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    """The rows of :func:`as_binary` again."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def pad(vectors: np.ndarray, dim: int) -> np.ndarray:
    return np.pad(vectors, ((0, 0), (0, dim - vectors.shape[1])))


def fit(rows: DataFrame, dim: int | None, grids: int, seed: int = 0, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Planes of all grids: directions (grids, bits, dim) and places (grids, bits).

    ``rows`` has ``id`` and ``vec``. The sample is the ``SAMPLE`` rows of
    lowest hash, the same in every run.
    """
    held = rows.where("vec IS NOT NULL").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).select("vec").toArrow().column(0)
    _, sample = unit_rows(pa.concat_arrays(held.chunks) if held.num_chunks else pa.array([], pa.list_(pa.float64())), dim)
    rng = np.random.default_rng(seed)
    width = sample.shape[1]
    directions, places = np.zeros((grids, bits, width)), np.zeros((grids, bits))
    if len(sample) < 2:
        return directions, places
    around = max(1, len(sample) // 100)
    for g in range(grids):
        for b in range(bits):
            i, j = rng.choice(len(sample), 2, replace=False)
            d = sample[i] - sample[j]
            d = d / (np.linalg.norm(d) or 1.0)
            f = np.sort(sample @ d)
            middle = np.arange(max(around, len(f) // 4), min(len(f) - around, 3 * len(f) // 4 + 1))
            if len(middle):
                at = middle[np.argmax(f[middle + around - 1] - f[middle - around])]
                places[g, b] = (f[at] + f[at - 1]) / 2
            directions[g, b] = d
    return directions, places


def _codes(vectors: np.ndarray, directions: np.ndarray, places: np.ndarray) -> np.ndarray:
    bits = vectors @ directions.T > places
    return (bits.astype(np.int64) << np.arange(bits.shape[1] - 1, -1, -1)).sum(1)


def _coder(dim: int | None, directions: np.ndarray, places: np.ndarray, bits: int | None, kind: str = "f4"):
    """Strings of every grid: counted by their first ``bits`` bits, or with the vectors if ``bits`` is None."""
    width = directions.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, unit = unit_rows(batch.column(2), dim)
            if not ok.any():
                continue
            unit = pad(unit, width) if unit.shape[1] < width else unit
            group, ids = (batch.column(i).filter(pa.array(ok)) for i in range(2))
            data = as_binary(unit, kind) if bits is None else None
            for g in range(len(directions)):
                code = _codes(unit, directions[g], places[g])
                if bits is None:
                    yield pa.RecordBatch.from_arrays([group, pa.array(np.full(len(unit), g, np.int32)), pa.array(code), ids, data], names=["grp", "grid", "code", "id", "unit"])
                else:
                    counted = pa.Table.from_arrays([group, pa.array(code >> (BITS - bits))], names=["grp", "prefix"]).group_by(["grp", "prefix"]).aggregate([([], "count_all")])
                    n = counted.column("count_all").combine_chunks().cast(pa.int64())
                    grid = pa.array(np.full(len(n), g, np.int32))
                    yield pa.RecordBatch.from_arrays([counted.column("grp").combine_chunks(), grid, counted.column("prefix").combine_chunks(), n], names=["grp", "grid", "prefix", "n"])

    return run


def _depths(counted: DataFrame, low: int, high: int, cap: int) -> DataFrame:
    """``(grp, grid, prefix, n, depth, cell, size)``: the shallowest prefix of ``low`` to ``high`` bits within ``cap``, else the longest.

    ``counted`` has the first ``high`` bits of strings as ``prefix`` with their number ``n``.
    """
    codes = counted.groupBy("grp", "grid", "prefix").agg(F.sum("n").alias("n"))
    levels = F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(STEP))).alias("depth")
    nodes = codes.select("grp", "grid", "prefix", "n", levels).withColumn("cell", F.expr(f"shiftright(prefix, {high} - depth)"))
    size = nodes.groupBy("grp", "grid", "depth", "cell").agg(F.sum("n").alias("size"))
    fits = (F.col("size") <= cap) | (F.col("depth") == high)
    chosen = F.min(F.when(fits, F.struct("depth", "cell", "size")))
    found = nodes.join(size, ["grp", "grid", "depth", "cell"]).groupBy("grp", "grid", "prefix").agg(F.first("n").alias("n"), chosen.alias("c"))
    return found.select("grp", "grid", "prefix", "n", "c.depth", "c.cell", "c.size")


def units(dim: int | None, width: int):
    """``(id, unit)`` of the usable vectors of batches ``(id, vec)``, as float32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, unit = unit_rows(batch.column(1), dim)
            if ok.any():
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), as_binary(pad(unit, width), "f4")], names=["id", "unit"])

    return run


def place(rows: DataFrame, dim: int | None, planes: tuple[np.ndarray, np.ndarray], cap: int, kind: str = "f4") -> tuple[DataFrame, int]:
    """``(grp, grid, depth, cell, part, whole, id, unit)``: every usable vector in its cell of each grid, and tasks for them.

    ``whole`` groups lie in one cell undivided and come in the first grid only.
    """
    located, tasks, _ = locate(rows, dim, planes, cap, kind)
    part = F.pmod(F.xxhash64("id", "grid"), F.ceil(F.col("size") / cap)).cast("int")
    whole = (F.col("depth") == 0) & (F.col("size") <= cap)
    located = located.select("grp", "grid", "depth", "cell", part.alias("part"), whole.alias("whole"), "id", "unit")
    return located.where("grid = 0 OR NOT whole"), tasks


def locate(rows: DataFrame, dim: int | None, planes: tuple[np.ndarray, np.ndarray], cap: int, kind: str = "f4") -> tuple[DataFrame, int, bool]:
    """``(grp, grid, depth, cell, size, id, unit)``, cells undivided, tasks to shuffle them into, and whether any cell is above ``cap``.

    ``rows`` has ``grp`` and ``id`` (BIGINT) and ``vec``; groups are never
    mixed. ``unit`` holds the scaled vector as bytes of type ``kind``.
    Strings are counted by their first ``FIRST_BITS`` bits, of which there
    are few; only where a cell is still above ``cap`` are whole strings
    counted in another pass.
    """
    ship(rows.sparkSession)
    rows = rows.select("grp", "id", "vec").where("grp IS NOT NULL AND id IS NOT NULL AND vec IS NOT NULL")
    counts = "grp bigint, grid int, prefix bigint, n bigint"
    short = materialise(_depths(rows.mapInArrow(_coder(dim, *planes, FIRST_BITS), counts), 0, FIRST_BITS, cap), "depths")
    placed = rows.mapInArrow(_coder(dim, *planes, None, kind), "grp bigint, grid int, code bigint, id bigint, unit binary")
    rest = BITS - FIRST_BITS
    located = placed.withColumn("prefix", F.shiftright("code", rest)).join(small(short.drop("n"), DEPTH_BYTES), ["grp", "grid", "prefix"])
    over = False
    full = short.where((F.col("depth") == FIRST_BITS) & (F.col("size") > cap)).select("grp", "grid", F.col("prefix").alias("head"))
    total, above = short.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if((F.col("depth") == FIRST_BITS) & (F.col("size") > cap))).first()
    if above:
        whole = rows.mapInArrow(_coder(dim, *planes, BITS), counts).withColumn("head", F.shiftright("prefix", rest))
        deep = materialise(_depths(whole.join(small(full, DEPTH_BYTES), ["grp", "grid", "head"], "left_semi"), FIRST_BITS, BITS, cap), "depths")
        over = deep.where(F.col("size") > cap).limit(1).count() > 0
        deep = deep.select("grp", "grid", F.col("prefix").alias("code"), *(F.col(c).alias(f"deep_{c}") for c in ("depth", "cell", "size")))
        located = located.join(small(deep, DEPTH_BYTES), ["grp", "grid", "code"], "left")
        located = located.withColumns({c: F.coalesce(f"deep_{c}", c) for c in ("depth", "cell", "size")})
    tasks = tasks_for(rows.sparkSession, total * (planes[0].shape[2] * np.dtype(kind).itemsize + DEPTH_BYTES))
    return located.select("grp", "grid", "depth", "cell", "size", "id", "unit"), tasks, over
