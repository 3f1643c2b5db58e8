"""The most similar vectors for every vector (problem 5).

Hash-prefix forest: in every tree the vectors lie in a sorted array of long
hash strings. A vector descends to the longest prefix it shares with others;
then all trees ascend together, one bit at a time, until the nodes that the
vector lies in hold its quota of candidates, and it is compared with all of
them. A node is never cut, however many vectors share it.

For all vectors at once (:func:`nearest`) they are brought together by
prefixes of a few independent strings first, the upper part of the forest,
so that the trees of a region need no shuffle. For a stated set of queries
(:func:`search`) the index stays where it is: every block of it has its own
forest, and blocks of queries go over them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, materialise, ship, small
from .cells import fit, from_binary, locate, units

#: Independent ways to bring vectors together, and vectors in a region at most.
GRIDS, CAP = 3, 131072

#: Trees of a region, bits of their hash strings, and candidates in its nodes with which a vector stops to ascend.
TREES, STRING_BITS, QUOTA = 12, 40, 4608

#: The same for a block of an index that queries go over; strings are short enough to count every prefix of a block.
SEARCH_TREES, SEARCH_BITS, SEARCH_QUOTA = 48, 16, 8192

#: Vectors in a block of an index, of queries or of all pairs, rows of it compared at a time, products held at a time, and bytes of the blocks that a task meets at most.
INDEX_BLOCK, BLOCK, ROWS, PRODUCTS, MET_BYTES = 32768, 8192, 2048, 1 << 24, 32 << 20

#: Bytes of a row of a table of ids when broadcast.
ID_BYTES = 48

#: Cosines of single precision that differ by less count as equal.
EQUAL = 1e-6


def hash_strings(vectors: np.ndarray, trees: int, bits: int, seed: int) -> np.ndarray:
    """Hash strings ``(trees, rows)``: the sides of random planes on which a vector lies, as the bits of a number."""
    rng = np.random.default_rng(seed)
    out = np.empty((trees, len(vectors)), np.uint64)
    for t in range(trees):
        planes = rng.normal(size=(bits, vectors.shape[1])).astype(np.float32)
        packed = np.packbits(vectors @ planes.T > 0, axis=1)
        whole = np.zeros((len(vectors), 8), np.uint8)
        whole[:, : packed.shape[1]] = packed
        out[t] = whole.view(">u8").ravel() >> np.uint64(64 - bits)
    return out


def common_bits(strings: np.ndarray, bits: int) -> np.ndarray:
    """Leading bits that each of the sorted ``strings`` shares with the next."""
    differ = strings[1:] ^ strings[:-1]
    mantissa, power = np.frexp(differ.astype(np.float64))  # bits < 53, so that powers are exact
    return bits - np.where(differ > 0, power, 0)


def ascend(shared: list[np.ndarray], order: list[np.ndarray], bits: int, quota: int) -> np.ndarray:
    """The level at which each row stops: the longest prefix length at which its nodes of all trees together hold ``quota`` rows, else 0."""
    n = len(order[0])
    level, still = np.zeros(n, np.int64), np.ones(n, bool)
    for x in range(bits, 0, -1):
        met = np.zeros(n, np.int64)
        for s, o in zip(shared, order):
            node = np.cumsum(np.r_[False, s < x])
            met[o] += np.bincount(node)[node]
        stop = still & (met >= quota)
        level[stop] = x
        still &= ~stop
        if not still.any():
            break
    return level


class _Best:
    """The best ``k`` partners of every row so far; equal cosines by the lesser id."""

    def __init__(self, ids: np.ndarray, k: int, least: float):
        self.ids, self.k = ids, k
        self.partner = np.full((len(ids), k), -1)
        self.cosine = np.full((len(ids), k), least, np.float32)
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def offer(self, rows: np.ndarray, columns: np.ndarray, product: np.ndarray) -> None:
        floor = self.cosine[rows, -1]
        if product.shape[1] > 4 * self.k and (product >= floor[:, None]).mean() > 0.1:
            # nothing is known of these rows yet: their k best here, themselves and equals included, are enough
            floor = np.maximum(floor, np.partition(product, -self.k - 1, axis=1)[:, -self.k - 1] - EQUAL)
        r, c = np.nonzero(product >= floor[:, None])
        value = product[r, c]
        r, c = rows[r], columns[c]
        keep = r != c
        self.pending.append((r[keep], c[keep], value[keep]))
        self.held += len(self.pending[-1][0])
        if self.held > 4_000_000:
            self.settle()

    def settle(self) -> None:
        old = np.flatnonzero(self.partner >= 0)
        rows = np.concatenate([p[0] for p in self.pending] + [old // self.k])
        columns = np.concatenate([p[1] for p in self.pending] + [self.partner.ravel()[old]])
        value = np.concatenate([p[2] for p in self.pending] + [self.cosine.ravel()[old]])
        self.pending, self.held = [], 0
        _, once = np.unique(rows * np.int64(len(self.ids)) + columns, return_index=True)
        rows, columns, value = rows[once], columns[once], value[once]
        order = np.lexsort((self.ids[columns], -np.rint(value / EQUAL), rows))
        rows, columns, value = rows[order], columns[order], value[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        top = rank < self.k
        self.partner[:] = -1
        floor = self.cosine[:, -1].copy()
        self.cosine[:] = floor[:, None]
        self.partner[rows[top], rank[top]] = columns[top]
        self.cosine[rows[top], rank[top]] = value[top]


def region_neighbours(ids: np.ndarray, vectors: np.ndarray, k: int, least: float, seed: int, trees: int = TREES, quota: int = QUOTA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(id, neighbour, cosine)`` of the best partners within one region."""
    best = _Best(ids, k, np.float32(least))
    strings = hash_strings(vectors, trees, STRING_BITS, seed)
    order = [np.lexsort((ids, s)) for s in strings]
    shared = [common_bits(s[o], STRING_BITS) for s, o in zip(strings, order)]
    level = ascend(shared, order, STRING_BITS, quota)
    levels = np.unique(level)
    for s, o in zip(shared, order):
        for x in levels:
            ends = np.r_[0, np.flatnonzero(s < x) + 1, len(ids)]
            here = np.flatnonzero(level[o] == x)
            at = np.searchsorted(ends, here, side="right") - 1
            for rows in np.split(here, np.flatnonzero(at[1:] != at[:-1]) + 1):
                c, d = ends[np.searchsorted(ends, rows[0], side="right") - 1 :][:2]
                near, step = vectors[o[c:d]], max(1, PRODUCTS // (d - c))
                for i in range(0, len(rows), step):
                    some = o[rows[i : i + step]]
                    best.offer(some, o[c:d], vectors[some] @ near.T)
        best.settle()
    rows, rank = np.nonzero(best.partner >= 0)
    return ids[rows], ids[best.partner[rows, rank]], best.cosine[rows, rank]


def _region(k: int, least: float, trees: int, quota: int):
    def run(region: pa.Table) -> pa.Table:
        ids, once = np.unique(region.column("id").to_numpy(), return_index=True)  # repeated rows
        vectors = from_binary(region.column("unit").take(pa.array(once)), "f4")
        seed = 17 + (region.column("region")[0].as_py() >> 56)
        own, other, cosine = region_neighbours(ids, vectors, k, least, seed, trees, quota)
        return pa.table({"id": own, "neighbour": other, "cosine": cosine.astype(np.float64)})

    return run


def _pack(size: int):
    """Rows ``(id, unit)`` as blocks ``(ids, units)`` of ``size`` rows at most."""

    def block(table: pa.Table) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"ids": [table.column(0).to_numpy().astype(np.int64).tobytes()], "units": [b"".join(table.column(1).to_pylist())]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, size))
                held, n = table.slice(size).to_batches(), n - size
        if n:
            yield block(pa.Table.from_batches(held))

    return run


class _Block:
    """The best ``k`` partners of the vectors of one block so far, as :class:`_Best` ranks them."""

    def __init__(self, key: bytes, units: bytes, k: int, least: float):
        self.key, self.k, self.least = key, k, np.float32(least)
        self.ids = np.frombuffer(key, np.int64)
        self.vectors = np.frombuffer(units, np.float32).reshape(len(self.ids), -1)
        self.partner = np.zeros((len(self.ids), k), np.int64)
        self.cosine = np.full((len(self.ids), k), -np.inf, np.float32)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for a in range(0, len(self.ids), ROWS):
            own, cosine, partner = self.ids[a : a + ROWS], self.cosine[a : a + ROWS], self.partner[a : a + ROWS]
            product = self.vectors[a : a + ROWS] @ vectors.T
            floor = cosine[:, -1]
            if len(ids) > 4 * self.k and np.isneginf(floor).any():
                # nothing is known yet: the k best here, the vector itself included, are enough
                floor = np.maximum(floor, np.partition(product, -self.k - 1, axis=1)[:, -self.k - 1])
            floor = np.maximum(floor - np.float32(2 * EQUAL), self.least)
            r, c = np.divmod(np.flatnonzero((product >= floor[:, None]).ravel()), len(ids))
            keep = own[r] != ids[c]
            r, c = r[keep], c[keep]
            old, at = np.nonzero(np.isfinite(cosine))
            row = np.concatenate([old, r])
            other = np.concatenate([partner[old, at], ids[c]])
            value = np.concatenate([cosine[old, at], product[r, c]])
            order = np.lexsort((other, -np.rint(value / EQUAL), row))
            row, other, value = row[order], other[order], value[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            top = rank < self.k
            partner[row[top], rank[top]] = other[top]
            cosine[row[top], rank[top]] = value[top]

    def found(self) -> pa.RecordBatch:
        row, rank = np.nonzero(np.isfinite(self.cosine))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(self.partner[row, rank]), pa.array(self.cosine[row, rank].astype(np.float64))], names=["id", "neighbour", "cosine"])


def _meet(k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for row in range(batch.num_rows):
                key, own, ids, other = (c[row].as_py() for c in batch.columns)
                if best is None or key != best.key:
                    if best:
                        yield best.found()
                    best = _Block(key, own, k, least)
                ids = np.frombuffer(ids, np.int64)
                best.meet(ids, np.frombuffer(other, np.float32).reshape(len(ids), -1))
        if best:
            yield best.found()

    return run


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    return materialise(vectors.dropDuplicates(["id"]).mapInArrow(_pack(size), "ids binary, units binary"), "blocks")


def all_pairs(vectors: DataFrame, k: int, least: float, queries: DataFrame | None = None) -> DataFrame:
    """``(id, neighbour, cosine)``: the best partners of ``queries(id, unit)``, of all if None, among all ``vectors(id, unit)``, every pair compared.

    A task holds the blocks of one part and goes over those of another, and
    passes on only the best of them. Work grows with the product of both.
    """
    blocks = _blocks(vectors, BLOCK)
    asked = blocks if queries is None else _blocks(queries, BLOCK)
    size = blocks.agg(F.sum(F.length("units"))).first()[0] or 0
    met = blocks.coalesce(int(size // MET_BYTES) + 1).select(F.col("ids").alias("met"), F.col("units").alias("met_units"))
    return asked.crossJoin(met).mapInArrow(_meet(k, least), "id bigint, neighbour bigint, cosine double")


class Forest:
    """The trees of one block of an index."""

    def __init__(self, ids: bytes, units: bytes, trees: int, quota: int, seed: int = 29):
        self.key, self.quota, self.trees, self.seed = ids, quota, trees, seed
        self.ids = np.frombuffer(ids, np.int64)
        self.vectors = np.frombuffer(units, np.float32).reshape(len(self.ids), -1)
        strings = hash_strings(self.vectors, trees, SEARCH_BITS, seed).astype(np.int64)
        self.order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        # where each prefix of full length begins in the sorted array; shorter ones are stretches of them
        self.begin = np.stack([np.r_[0, np.cumsum(np.bincount(s, minlength=1 << SEARCH_BITS))] for s in strings]).astype(np.int32)

    def candidates(self, vectors: np.ndarray) -> Iterator[np.ndarray]:
        """For each of ``vectors`` the distinct rows of its nodes, all trees ascending together until these hold the quota."""
        strings = hash_strings(vectors, self.trees, SEARCH_BITS, self.seed).astype(np.int64)
        tree = np.arange(self.trees)[:, None]
        low, high = np.zeros(strings.shape, np.int32), np.full(strings.shape, len(self.ids), np.int32)
        still = np.ones(len(vectors), bool)
        for x in range(SEARCH_BITS, 0, -1):
            rest = SEARCH_BITS - x
            prefix = strings[:, still] >> rest
            a, b = self.begin[tree, prefix << rest], self.begin[tree, (prefix + 1) << rest]
            full = (b - a).sum(0) >= self.quota
            at = np.flatnonzero(still)[full]
            low[:, at], high[:, at] = a[:, full], b[:, full]
            still[at] = False
            if not still.any():
                break
        seen = np.zeros(len(self.ids), bool)
        for q in range(len(vectors)):
            for t in range(self.trees):
                seen[self.order[t, low[t, q] : high[t, q]]] = True
            rows = np.flatnonzero(seen)
            seen[rows] = False
            yield rows

    def search(self, ids: np.ndarray, vectors: np.ndarray, k: int, least: float) -> pa.RecordBatch:
        out: list[list[np.ndarray]] = [[], [], []]
        for own, vector, rows in zip(ids, vectors, self.candidates(vectors)):
            cosine = self.vectors[rows] @ vector
            top = np.argpartition(-cosine, min(k, len(rows) - 1))[: k + 1] if len(rows) > k + 1 else np.arange(len(rows))
            if len(rows) > k + 1:  # all that tie with the last one stay
                top = np.flatnonzero(cosine >= cosine[top].min() - EQUAL)
            top = top[(self.ids[rows[top]] != own) & (cosine[top] >= least)]
            out[0].append(np.full(len(top), own))
            out[1].append(self.ids[rows[top]])
            out[2].append(cosine[top].astype(np.float64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["id", "neighbour", "cosine"])


def _search(k: int, least: float, trees: int, quota: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = None
        for batch in batches:
            for row in range(batch.num_rows):
                key, own, ids, other = (c[row].as_py() for c in batch.columns)
                if forest is None or key != forest.key:
                    forest = Forest(key, own, trees, quota)
                ids = np.frombuffer(ids, np.int64)
                yield forest.search(ids, np.frombuffer(other, np.float32).reshape(len(ids), -1), k, least)

    return run


def _usable(rows: DataFrame, dim: int | None) -> DataFrame:
    """``(id, unit)`` of the usable vectors."""
    width = dim or rows.agg(F.max(F.size("vec"))).first()[0] or 1
    return rows.select("id", "vec").where("id IS NOT NULL AND vec IS NOT NULL").mapInArrow(units(dim, width), "id bigint, unit binary")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("cosine", 6)), "neighbour"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def search(index: DataFrame, queries: DataFrame, k: int = 5, dim: int | None = 48, least: float = -1.0, trees: int = SEARCH_TREES, quota: int = SEARCH_QUOTA, exact: bool = False) -> DataFrame:
    """``(id, neighbour, cosine, rank)``: up to ``k`` most similar other vectors of ``index`` for each of ``queries``.

    Both have ``id`` (BIGINT) and ``vec``; a neighbour of the same id is the
    vector itself and left out. Nulls, unusable vectors, repeated rows and
    ties are treated as in :func:`nearest`; empty tables give no rows.
    The index is neither shuffled by hash nor divided: every block of it has
    a forest, and a query meets at least ``quota`` of a block's vectors,
    counted by tree (all of it if it has no more). ``exact`` compares every
    query with every vector instead.
    """
    ship(index.sparkSession)
    vectors, asked = _usable(index, dim), _usable(queries, dim)
    if exact:
        return _ranked(all_pairs(vectors, k, least, asked), k)
    blocks, asked = _blocks(vectors, INDEX_BLOCK), _blocks(asked, BLOCK).select(F.col("ids").alias("asked"), F.col("units").alias("asked_units"))
    size = asked.agg(F.coalesce(F.sum(F.length("asked") + F.length("asked_units")), F.lit(0))).first()[0]
    # a stated set of queries against all rows, block by block
    paired = blocks.crossJoin(F.broadcast(asked) if size <= BROADCAST_BYTES else asked)
    return _ranked(paired.mapInArrow(_search(k, least, trees, quota), "id bigint, neighbour bigint, cosine double"), k)


def _forest(rows: DataFrame, k: int, dim: int | None, least: float, grids: int, cap: int, trees: int, quota: int) -> DataFrame:
    """``(id, neighbour, cosine)`` of partners that share a region; those of a cell that no prefix divides are all compared."""
    rows = rows.select(F.lit(0).cast("bigint").alias("grp"), "id", "vec")
    placed, tasks, over = locate(rows, dim, fit(rows, dim, grids, seed=5), cap)
    fits = placed.where(F.col("size") <= cap) if over else placed
    region = F.shiftleft(F.col("grid").cast("bigint"), 56) + F.shiftleft(F.col("depth").cast("bigint"), 48) + F.col("cell")
    fits = fits.select(region.alias("region"), "id", "unit").repartition(tasks, "region")
    found = fits.groupBy("region").applyInArrow(_region(k, least, trees, quota), "id bigint, neighbour bigint, cosine double")
    return found.union(all_pairs(placed.where(F.col("size") > cap).select("id", "unit"), k, least)) if over else found


def nearest(rows: DataFrame, k: int = 5, dim: int | None = 48, least: float = -1.0, grids: int = GRIDS, cap: int = CAP, trees: int = TREES, quota: int = QUOTA) -> DataFrame:
    """``(id, neighbour, cosine, rank)``: up to ``k`` most similar other vectors of every vector.

    ``rows`` has ``id`` (BIGINT) and ``vec``. Partners below cosine
    ``least`` are left out early. Equal cosines are ranked by the
    lesser id. Vectors that are null, not of ``dim`` numbers, not finite or all
    zero take no part, nor do rows with a null ``id``; repeated rows (same id,
    same content) count once; a single vector and an empty table give no
    rows. Other columns are not read. Every vector is indexed; the planes
    that divide regions are fitted on a bounded sample. Of exact copies the
    ``k + 1`` of least id are compared for all of them.

    Near partners are found almost surely; those far apart (cosine about
    0.5) share a region only by chance. :func:`search` finds these too.
    """
    rows = rows.select("id", "vec").where("id IS NOT NULL AND vec IS NOT NULL")
    ship(rows.sparkSession)
    copy = [F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2")]
    hashed = rows.select("id", *copy)
    many = materialise(hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1).select("h1", "h2"), "copied")
    copies = None
    if many.limit(1).count():
        held = hashed.join(small(many, ID_BYTES), ["h1", "h2"]).distinct()
        order = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
        last = materialise(held.withColumn("r", order).where(F.col("r") <= k + 1).where(F.col("r") == k + 1).select("h1", "h2", F.col("id").alias("like")), "likes")
        last = small(last, ID_BYTES)
        copies = materialise(held.join(last, ["h1", "h2"]).where("id > like").select("id", "like"), "copies")
        rows = rows.select("*", *copy).join(last, ["h1", "h2"], "left").where("like IS NULL OR id <= like").select("id", "vec")
    best = _ranked(_forest(rows, k, dim, least, grids, cap, trees, quota), k)
    if copies is None:
        return best
    # the k best of the last one compared are those of every copy after it
    best = materialise(best, "nearest")
    lists = best.join(small(copies.select(F.col("like").alias("id")).distinct(), ID_BYTES), "id", "left_semi").withColumnRenamed("id", "like")
    return best.unionByName(copies.join(small(lists, ID_BYTES), "like").select("id", "neighbour", "cosine", "rank"))


def close_pairs(found: DataFrame) -> DataFrame:
    """``(emb_a, emb_b)`` with ``emb_a < emb_b``: pairs of which at least one names the other."""
    return found.select(F.least("id", "neighbour").alias("emb_a"), F.greatest("id", "neighbour").alias("emb_b")).distinct()


def recall(found: DataFrame, exact: DataFrame, least: float) -> DataFrame:
    """One row ``(queries, partners, enough)``: queries and partners of ``exact``, and whether ``found`` has at least the share ``least`` of them."""
    both = exact.select("id", "neighbour").join(found.select("id", "neighbour", F.lit(1).alias("hit")), ["id", "neighbour"], "left")
    by_query = both.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"))
    enough = F.sum("hits") >= least * F.sum("n")
    return by_query.agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum("n"), F.lit(0)).alias("partners"), F.coalesce(enough, F.lit(True)).alias("enough"))
