"""Items that appear together in a basket, and how much more often than chance (problem 4).

Large-basket blocking: baskets above a size are split into item chunks whose
chunk-pair products are spread over tasks; ordinary baskets pair their items
where they lie. Pairs are counted within a task first and travel as sorted,
delta-coded runs, one row per task and bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, materialise, ship, small
from .corpus import current

#: Items a basket may have before it is split into chunks of about this many.
CHUNK_ITEMS = 1024

#: Pair instances a task holds before it counts them; distinct pairs before it passes them on.
HELD_PAIRS, KEPT_PAIRS = 1 << 20, 1 << 21

#: A basket with more than this part of the rows of all large ones is hot; there are no more of them than this.
HOT_BASKETS = 10_000

#: Pair instances that one bucket of the final count is planned for.
BUCKET_PAIRS = 1 << 21

#: Positions of a document that share a task, as a power of two; a block of 32 lies within.
SPREAD_BITS = 12

_CODEC = "zstd"


def _pack(key: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted keys ``a << 32 | b`` with their counts as compressed bytes."""
    a, b = (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
    planes = np.stack([np.diff(a, prepend=np.int32(0)), np.diff(b, prepend=np.int32(0)), count.astype(np.int32)])
    raw = np.ascontiguousarray(planes.view(np.uint8).reshape(3, len(key), 4).transpose(0, 2, 1)).tobytes()
    return len(key).to_bytes(8, "little") + pa.compress(raw, codec=_CODEC, asbytes=True)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], decompressed_size=12 * n, codec=_CODEC, asbytes=True)
    planes = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(3, 4, n).transpose(0, 2, 1)).view(np.int32).reshape(3, n)
    a, b = np.cumsum(planes[0], dtype=np.int32), np.cumsum(planes[1], dtype=np.int32)
    return (a.astype(np.int64) << 32) | b.view(np.uint32).astype(np.int64), planes[2].astype(np.int64)


def _total(key: np.ndarray, count: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their counts (1 each without counts)."""
    if count is None:
        key = np.sort(key)
    else:
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    if count is None:
        return key[starts], np.diff(np.r_[starts, len(key)])
    return key[starts], np.add.reduceat(count, starts) if len(key) else count


def _spread(x: np.ndarray, sides: int) -> np.ndarray:
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % sides


class _Counter:
    """Counts pair keys of one task and hands them on by bucket."""

    def __init__(self, sides: int):
        self.sides = sides
        self.fresh: list[np.ndarray] = []
        self.n = 0
        self.key, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.fresh.append((low.astype(np.int64) << 32) | (high.astype(np.int64) & 0xFFFFFFFF))
        self.n += len(low)
        if self.n >= HELD_PAIRS:
            self._fold()
            if len(self.key) > KEPT_PAIRS:
                yield from self.out()

    def _fold(self) -> None:
        if self.fresh:
            key, count = _total(np.concatenate(self.fresh), None)
            self.key, self.count = _total(np.concatenate([self.key, key]), np.concatenate([self.count, count]))
            self.fresh, self.n = [], 0

    def out(self) -> Iterator[pa.RecordBatch]:
        self._fold()
        bucket = _spread(self.key >> 32, self.sides) * self.sides + _spread(self.key & 0xFFFFFFFF, self.sides)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(self.sides**2 + 1))
        for i in np.flatnonzero(np.diff(ends)):
            at = order[ends[i] : ends[i + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([int(i)], pa.int32()), pa.array([_pack(self.key[at], self.count[at])], pa.binary())], names=["bucket", "run"])
        self.key, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)


def _pairs_within(kept: np.ndarray | None, sides: int):
    """All pairs of each row's items (sorted, distinct); ``kept`` names the items that may form a case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(sides)
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            size = np.diff(lists.offsets.to_numpy())
            if kept is not None:
                at = np.minimum(np.searchsorted(kept, flat), max(0, len(kept) - 1))
                good = kept[at] == flat if len(kept) else np.zeros(len(flat), bool)
                size = np.bincount(np.repeat(np.arange(len(size)), size)[good], minlength=len(size))
                flat = flat[good]
            start = np.cumsum(size) - size
            for s in np.unique(size[size > 1]):
                i, j = np.triu_indices(s, 1)
                rows = start[size == s]
                step = max(1, HELD_PAIRS // len(i))
                for r in range(0, len(rows), step):
                    items = flat[rows[r : r + step, None] + np.arange(s)]
                    yield from counter.add(items[:, i].ravel(), items[:, j].ravel())
        yield from counter.out()

    return run


def _pairs_between(kept: np.ndarray | None, sides: int):
    """Products of two item chunks of one large basket; a chunk with itself gives its pairs once."""

    def only(x: np.ndarray) -> np.ndarray:
        return x if kept is None else x[np.isin(x, kept)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(sides)
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1)):
                x, y = (only(np.asarray(v.values)) for v in (left, right))
                a, b = np.repeat(x, len(y)), np.tile(y, len(x))
                if left == right:
                    a, b = a[a < b], b[a < b]
                yield from counter.add(np.minimum(a, b), np.maximum(a, b))
        yield from counter.out()

    return run


def _combine(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = [_unpack(x) for batch in batches for x in batch.column(1).to_pylist()]
        key, count = _total(np.concatenate([k for k, _ in runs]), np.concatenate([c for _, c in runs]))
        key, count = key[count >= least], count[count >= least]
        yield pa.RecordBatch.from_arrays([pa.array((key >> 32).astype(np.int32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(count)], names=["item_a", "item_b", "n_ab"])

    return run


def _gather(n_keys: int):
    """Distinct items of each basket part as a list; rows come sorted by part and item, so only the last part waits for more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        names: list[str] = []

        def out(columns: list[np.ndarray], end: int) -> Iterator[pa.RecordBatch]:
            *keys, item = (c[:end] for c in columns)
            new = np.ones(len(item), bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            fresh = new.copy()
            fresh[1:] |= item[1:] != item[:-1]
            starts = np.flatnonzero(new[fresh])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, int(fresh.sum())].astype(np.int32)), pa.array(item[fresh].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(pa.array(k[new]) for k in keys), lists], names=[*names[:n_keys], "items"])

        for batch in batches:
            names = batch.schema.names
            fresh = [c.to_numpy() for c in batch.columns]
            if not batch.num_rows:
                continue
            columns = fresh if held is None else [np.concatenate(x) for x in zip(held, fresh)]
            keys = columns[:-1]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
            end = int(change[-1]) + 1 if len(change) else 0
            if end:
                yield from out(columns, end)
            held = [c[end:] for c in columns]
        if held is not None and len(held[0]):
            yield from out(held, len(held[0]))

    return run


def gather_baskets(rows: DataFrame, basket: list[str], item: str, spread: str | None = None) -> DataFrame:
    """``(*basket, part, parts, items)``: the distinct items of every basket, in parts of about ``CHUNK_ITEMS``.

    ``rows`` holds BIGINT basket columns and an INT item; rows with a null
    in one of them are left out, repeats count once. With ``spread``, a
    column by which (with the first basket column) ``rows`` is already
    partitioned and within which every basket is known to have fewer than
    ``CHUNK_ITEMS`` items, no shuffle and no size count is needed. Else the
    baskets above that size are found first and their items spread by hash,
    so that a basket of any size takes many tasks.
    """
    rows = rows.select(*basket, F.col(item).cast("int").alias("item"), *([spread] if spread else [])).na.drop()
    if spread:
        placed, keys = rows, basket
    else:
        sizes = materialise(rows.groupBy(*basket).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > CHUNK_ITEMS), "basket-sizes")
        # baskets of more than a share of all rows are few, whatever the data, so that no hot basket is a key of a join
        total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        hot = max(CHUNK_ITEMS, total // HOT_BASKETS)
        giant = sizes.where(F.col("size") > hot).select(*basket, F.col("size").alias("giant"))
        placed = rows.join(F.broadcast(giant), basket, "left")
        large = F.col("giant")
        if sizes.where(F.col("size") <= hot).limit(1).count():
            placed = placed.join(small(sizes.where(F.col("size") <= hot), 8 * (len(basket) + 2)), basket, "left")
            large = F.coalesce("giant", "size")
        parts = F.ceil(F.coalesce(large, F.lit(1)) / CHUNK_ITEMS).cast("bigint")
        placed = placed.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("item"), "parts"))
        keys = [*basket, "part", "parts"]
        placed = placed.repartition(*basket, "part")
    schema = ", ".join(f"`{k}` bigint" for k in keys) + ", items array<int>"
    gathered = placed.select(*keys, "item").sortWithinPartitions(*keys, "item").mapInArrow(_gather(len(keys)), schema)
    if spread:
        gathered = gathered.withColumns({"part": F.lit(0).cast("bigint"), "parts": F.lit(1).cast("bigint")})
    return gathered.select(*basket, "part", "parts", "items")


def cooccurrence(baskets: DataFrame, basket: list[str], least: int = 1, lift: float = 0.0) -> DataFrame:
    """``(item_a, item_b, n_ab, n_a, n_b, n, lift, pmi)`` for ``item_a < item_b``.

    ``baskets`` comes from :func:`gather_baskets`. ``n`` is the number of
    baskets with an item, ``n_a`` and ``n_b`` those with either, ``n_ab``
    those with both; ``lift = n_ab * n / (n_a * n_b)`` and ``pmi`` is its
    logarithm. Pairs below ``least`` or ``lift`` are left out. Since
    ``n_ab <= min(n_a, n_b)``, an item in fewer than ``least`` baskets or in
    more than ``n / lift`` cannot belong to a pair that stays, so such items
    are left out before pairs are made; no pair that stays is lost. That is
    done up to 8 million such items, which tasks hold; with more, pairs of
    all items are made and filtered after, which costs more and gives the
    same. Empty input gives no rows.
    """
    spark = baskets.sparkSession
    ship(spark)
    baskets = materialise(baskets, "baskets")
    large = baskets.where("parts > 1")
    size = F.size("items").cast("double")
    ordinary, instances = baskets.agg(F.sum((F.col("parts") == 1).cast("bigint")), F.sum(size * (size - 1) / 2 * F.col("parts"))).first()
    split_up = large.limit(1).count()
    n = (ordinary or 0) + (large.select(*basket).distinct().count() if split_up else 0)
    instances = instances or 0
    counts = materialise(baskets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n_item")), "item-counts")
    useful = counts.where((F.col("n_item") >= least) & (F.col("n_item") * F.lit(float(lift)) <= n)).select("item")
    most = BROADCAST_BYTES // 8
    kept = useful.limit(most + 1).toPandas()["item"].to_numpy()
    kept = np.sort(kept) if len(kept) <= most else None  # beyond the bound no item is left out early
    sides = max(1, math.ceil(math.sqrt(instances / BUCKET_PAIRS)))
    runs = baskets.where("parts = 1").select("items").mapInArrow(_pairs_within(kept, sides), "bucket int, run binary")
    if split_up:
        left = large.select(*basket, F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"), F.col("items").alias("x"))
        right = large.select(*basket, F.col("part").alias("j"), F.col("items").alias("y"))
        products = left.join(right, [*basket, "j"]).repartition(*basket, "i", "j").select("x", "y")
        runs = runs.unionByName(products.mapInArrow(_pairs_between(kept, sides), "bucket int, run binary"))
    together = runs.groupBy("bucket").applyInArrow(_combine_group(least), "item_a int, item_b int, n_ab bigint")
    a = counts.select(F.col("item").alias("item_a"), F.col("n_item").alias("n_a"))
    b = counts.select(F.col("item").alias("item_b"), F.col("n_item").alias("n_b"))
    ratio = F.col("n_ab") * F.lit(float(n)) / (F.col("n_a") * F.col("n_b"))
    scored = together.join(a, "item_a").join(b, "item_b").withColumns({"n": F.lit(n), "lift": ratio, "pmi": F.log(ratio)})
    return scored.where(F.col("lift") >= lift).select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", "lift", "pmi")


def _combine_group(least: int):
    combine = _combine(least)

    def run(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(combine(iter(group.to_batches()))))

    return run


def document_baskets(corpus: DataFrame, vocab: DataFrame) -> DataFrame:
    """Documents as baskets of their current tokens; long ones are large baskets."""
    held = current(corpus, vocab, F.shiftright("pos", SPREAD_BITS))
    return gather_baskets(held.select("doc_id", "token"), ["doc_id"], "token")


def block_baskets(corpus: DataFrame, vocab: DataFrame, width_bits: int = 5) -> DataFrame:
    """Blocks of ``2 ** width_bits`` positions of a document as baskets of their current tokens."""
    held = current(corpus, vocab, F.shiftright("pos", SPREAD_BITS))
    rows = held.select("doc_id", "chunk", F.shiftright("pos", width_bits).alias("block"), "token")
    return gather_baskets(rows, ["doc_id", "block"], "token", spread="chunk")
