"""Groups of mutually similar records with their size and most typical members (problem 2).

Grid density clustering: records are quantised into cells of two
independent grids; within a cell alike records are linked exactly, and cells
of different grids that share records are adjacent. In 64 dimensions a cell
has 3**64 neighbours by offset, so what lies beyond a cell's planes is found
by bounds instead: the linked records of a dense cell lie in balls, and a
record can only be linked to a ball's members if it is near enough to its
centre. Records of no dense cell are balls of their own. Every record meets
the centres, the few that come near enough meet the members, so no link is
lost. Minimum labels run over all joins until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, small, tasks_for
from .cells import as_binary, fit, from_binary, place

#: Independent grids, records in a cell at most, and linked members that make a cell dense.
GRIDS, CAP, DENSE = 2, 16384, 5

#: Rows compared with the unlabelled ones at a time, and seeds without a partner after which blocks are compared.
FRONT, ALONE = 512, 16

#: Least cosine of a ball's members to its centre where it can be divided, members of one that is not divided, and slack of bounds.
TIGHT, FEW, SLACK = 0.8, 8, 1e-4

#: Bytes of all balls that are broadcast at most.
BALL_BYTES = 48 << 20

#: Records and balls in a block, rows of a block compared at a time, and records that meet a ball's members in one task.
BLOCK, ROWS, MEET = 4096, 1024, 16384

LOCAL = "grp bigint, id bigint, grid int, whole boolean, low bigint, members int, near double, unit binary, ball bigint, centre binary, reach double"


def components(vectors: np.ndarray, alike: float) -> np.ndarray:
    """Number of the linked component of every row: rows are linked if their product is at least ``alike``.

    A front of newly reached rows meets only rows not reached yet, so that
    dense components cost little; where seeds keep staying alone, a block of
    them is compared at once. The result is exact.
    """
    label, open_rows, n, alone = np.full(len(vectors), -1), np.arange(len(vectors)), 0, 0
    while len(open_rows):
        if alone >= ALONE:
            block = open_rows[:FRONT]
            lonely = (vectors[block] @ vectors[open_rows].T >= alike).sum(1) <= 1  # a row that is not reached has no link to any that is
            label[block[lonely]] = n + np.arange(lonely.sum())
            n += int(lonely.sum())
            open_rows = np.concatenate([block[~lonely], open_rows[FRONT:]])
            if lonely.sum() < len(block) // 2:
                alone = 0
            if lonely.any():
                continue
        front, open_rows = open_rows[:1], open_rows[1:]
        label[front] = n
        reached = 0
        while len(front) and len(open_rows):
            hit = np.zeros(len(open_rows), bool)
            for a in range(0, len(front), FRONT):
                rest = np.flatnonzero(~hit)
                if not len(rest):
                    break
                hit[rest] = (vectors[front[a : a + FRONT]] @ vectors[open_rows[rest]].T >= alike).any(0)
            front, open_rows = open_rows[hit], open_rows[~hit]
            label[front] = n
            reached += len(front)
        alone = alone + 1 if not reached else 0
        n += 1
    return label


def balls(vectors: np.ndarray, tight: float = TIGHT) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """``(rows, centre, reach)`` of balls that hold all of ``vectors``: ``reach`` is the least cosine of their rows to the centre.

    A ball whose reach is below ``tight`` is divided between two far members.
    """
    done, todo = [], [np.arange(len(vectors))]
    while todo:
        rows = todo.pop()
        mean = vectors[rows].mean(0, dtype=np.float64)
        length = np.linalg.norm(mean)
        centre = (mean / length if length > 0 else vectors[rows[0]]).astype(vectors.dtype)
        cosine = vectors[rows] @ centre
        if cosine.min() < tight and len(rows) > FEW:
            one = vectors[rows[cosine.argmin()]]
            two = vectors[rows[(vectors[rows] @ one).argmin()]]
            side = vectors[rows] @ (two - one) > 0
            if 0 < side.sum() < len(rows):
                todo += [rows[side], rows[~side]]
                continue
        done.append((rows, centre, float(cosine.min())))
    return done


def _link(alike: float, dense: int, kind: str):
    def run(cell: pa.Table) -> pa.Table:
        ids, once = np.unique(cell.column("id").to_numpy(), return_index=True)  # repeated rows
        vectors = from_binary(cell.column("unit").take(pa.array(once)), kind)
        label = components(vectors, alike)
        low = np.full(label.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, label, ids)
        members = np.bincount(label)
        grp, grid, whole = (cell.column(c)[0].as_py() for c in ("grp", "grid", "whole"))
        n = len(ids)
        near, unit, ball, centre, reach = np.zeros(n), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.float64())
        if grid == 0:
            mean = np.zeros((len(members), vectors.shape[1]))
            np.add.at(mean, label, vectors)
            length = np.linalg.norm(mean, axis=1)
            near = (vectors * mean[label]).sum(1) / np.where(length > 0, length, 1)[label]
        if grid == 0 and not whole:
            own, middle, least = ids.copy(), vectors.copy(), np.ones(n)
            by_label = np.argsort(label, kind="stable")
            for rows in np.split(by_label, np.cumsum(members)[:-1]):
                if len(rows) >= dense:
                    for at, c, r in balls(vectors[rows]):
                        first = rows[at].min()  # ids are sorted
                        own[rows[at]], middle[first], least[first] = ids[first], c, r
            unit, ball, reach = as_binary(vectors, kind), pa.array(own), pa.array(least, mask=own != ids)
            centre = pa.array(as_binary(middle, kind).to_pylist(), pa.binary(), mask=own != ids)
        columns = [np.full(n, grp), ids, np.full(n, grid, np.int32), np.full(n, whole), low[label], members[label].astype(np.int32), near]
        return pa.Table.from_arrays([*map(pa.array, columns), unit, ball, centre, reach], names=[f.split()[0] for f in LOCAL.split(", ")])

    return run


def _blocks(names: list[str]):
    """Batches ``(grp, stray, label, *names, unit)`` as rows ``(grp, stray, size, *columns as bytes)`` of one group and kind, up to ``BLOCK`` records each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[list]] = {}

        def out(key: tuple[int, bool]) -> pa.RecordBatch:
            parts = held.pop(key)
            columns = [pa.array([b"".join(p[i] for p in parts)], pa.binary()) for i in range(1, len(parts[0]))]
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([sum(p[0] for p in parts)], pa.int64()), *columns], names=["grp", "stray", "size", "label", *names, "unit"])

        for batch in batches:
            grp, stray = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            numbers = [c.to_numpy() for c in batch.columns[2:-1]]
            order = np.lexsort((stray, grp))
            change = np.flatnonzero((grp[order][1:] != grp[order][:-1]) | (stray[order][1:] != stray[order][:-1])) + 1
            for rows in np.split(order, change) if len(order) else []:
                key = (int(grp[rows[0]]), bool(stray[rows[0]]))
                for a in range(0, len(rows), BLOCK):
                    some = rows[a : a + BLOCK]
                    part = [len(some), *(x[some].tobytes() for x in numbers), b"".join(batch.column(batch.num_columns - 1).take(pa.array(some)).to_pylist())]
                    parts = held.setdefault(key, [])
                    if parts and sum(p[0] for p in parts) + len(some) > BLOCK:
                        yield out(key)
                        parts = held.setdefault(key, [])
                    parts.append(part)
        for key in list(held):
            yield out(key)

    return run


def _near(alike: float, kind: str):
    """Records that come near enough to a ball of another label to be linked to a member; for balls of one record, to be linked."""
    angle = np.arccos(min(1.0, alike))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                stray, alone = r["stray"], r["ball_stray"]
                label, ids, other, ball = (np.frombuffer(r[c], np.int64) for c in ("label", "id", "ball_label", "ball"))
                unit, centre = (np.frombuffer(r[c], kind).reshape(len(x), -1) for c, x in (("unit", ids), ("centre", ball)))
                reach = np.frombuffer(r["reach"], np.float64)
                least = np.cos(np.minimum(np.pi, angle + np.arccos(np.clip(reach, -1, 1)))) - SLACK
                if alone:
                    least = np.full(len(ball), alike)
                found = [[], []]
                for a in range(0, len(ids), ROWS):
                    x, b = np.divmod(np.flatnonzero((unit[a : a + ROWS] @ centre.T >= least.astype(unit.dtype)).ravel()), len(ball))
                    x += a
                    # one direction is enough: a stray looks at dense balls, of two of a kind the lesser label looks
                    keep = (label[x] < other[b]) if stray == alone else (label[x] != other[b])
                    found[0].append(x[keep])
                    found[1].append(b[keep])
                x, b = map(np.concatenate, found)
                if alone:
                    pairs = np.unique(np.stack([label[x], other[b]]), axis=1)
                    n = pairs.shape[1]
                    columns = [pa.array(pairs[0]), pa.array(pairs[1]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
                else:
                    n = len(x)
                    columns = [pa.array(label[x]), pa.array(other[b]), pa.array(ids[x]), pa.array(ball[b]), as_binary(unit[x], kind)]
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["grp"])), *columns], names=["grp", "a", "b", "id", "ball", "unit"])

    return run


def _meet(alike: float, kind: str):
    """Links between the records that came near a ball and its members."""

    def run(visitors: pa.Table, members: pa.Table) -> pa.Table:
        links = np.zeros((2, 0), np.int64)
        if visitors.num_rows and members.num_rows:
            x, y = (from_binary(t.column("unit"), kind) for t in (visitors, members))
            a, b = visitors.column("a").to_numpy(), visitors.column("b").to_numpy()
            hit = np.concatenate([(x[i : i + ROWS] @ y.T >= alike).any(1) for i in range(0, len(x), ROWS)])
            links = np.unique(np.stack([a[hit], b[hit]]), axis=1)
        grp = (visitors if visitors.num_rows else members).column("grp")[0].as_py()
        return pa.table({"grp": np.full(links.shape[1], grp, np.int64), "a": links[0], "b": links[1]})

    return run


def _across(told: DataFrame, alike: float, kind: str, width: int) -> DataFrame:
    """``(grp, a, b)``: labels of ``told(grp, id, label, stray, ball, centre, reach, unit)`` with linked records, whatever cells these lie in.

    Work is that of all records against all balls; what travels are the
    balls (joined to blocks of records, in salted parts of a group where
    they are too many to broadcast) and the records that come near one.
    """
    bytes_each = width * np.dtype(kind).itemsize + 40
    block = "grp bigint, stray boolean, size bigint, label binary, {} unit binary"
    records = told.select("grp", "stray", "label", "id", "unit").mapInArrow(_blocks(["id"]), block.format("id binary,"))
    middle = told.where("centre IS NOT NULL").select("grp", "stray", "label", "ball", "reach", "centre")
    middle = materialise(middle.mapInArrow(_blocks(["ball", "reach"]), block.format("ball binary, reach binary,")), "balls")
    middle = middle.select("grp", F.col("stray").alias("ball_stray"), F.col("size").alias("balls"), F.col("label").alias("ball_label"), "ball", "reach", F.col("unit").alias("centre"))
    held = middle.agg(F.coalesce(F.sum("balls"), F.lit(0))).first()[0]
    if held * bytes_each <= BALL_BYTES:
        paired = records.join(F.broadcast(middle), "grp")
    else:
        parts = tasks_for(told.sparkSession, told.count() * bytes_each)
        records = records.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(parts)))
        middle = middle.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
        paired = records.join(middle, ["grp", "slot"])
    paired = paired.where("stray OR NOT ball_stray").select("grp", "stray", "label", "id", "unit", "ball_stray", "ball_label", "ball", "reach", "centre")
    near = materialise(paired.mapInArrow(_near(alike, kind), "grp bigint, a bigint, b bigint, id bigint, ball bigint, unit binary"), "near")
    links = near.where("ball IS NULL").select("grp", "a", "b")
    asked = near.where("ball IS NOT NULL")
    many = asked.groupBy("grp", "ball").agg(F.ceil(F.count(F.lit(1)) / MEET).alias("parts"))
    many = small(materialise(many, "asked"), 32)
    visitors = asked.join(many, ["grp", "ball"]).select("grp", "ball", F.pmod(F.xxhash64("id"), "parts").alias("part"), "a", "b", "unit")
    members = told.join(many, ["grp", "ball"]).select("grp", "ball", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), "unit")
    keys = ["grp", "ball", "part"]
    met = visitors.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(_meet(alike, kind), "grp bigint, a bigint, b bigint")
    return materialise(links.union(met).distinct(), "across")


def _propagate(edges: DataFrame) -> DataFrame:
    """``(grp, node, label)``: the least node that each node reaches over ``(grp, a, b)``.

    Every round takes the least label among neighbours and then follows the
    label once more; rounds end when no label changes. Each round's table
    is written to the shared folder.
    """
    both = materialise(edges.select("grp", F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("grp", "b", "a")).distinct(), "links")
    label = materialise(both.groupBy("grp", "node").agg(F.least("node", F.min("other")).alias("label")), "labels")
    while True:
        reach = both.join(label.select("grp", F.col("node").alias("other"), "label"), ["grp", "other"]).groupBy("grp", "node").agg(F.min("label").alias("seen"))
        step = label.join(reach, ["grp", "node"]).select("grp", "node", F.col("label").alias("old"), F.least("label", "seen").alias("near"))
        onward = label.select("grp", F.col("node").alias("near"), F.col("label").alias("far"))
        fresh = step.join(onward, ["grp", "near"], "left").select("grp", "node", "old", F.least("near", F.coalesce("far", "near")).alias("label"))
        fresh = materialise(fresh, "labels")
        label = fresh.select("grp", "node", "label")
        if not fresh.where("label <> old").limit(1).count():
            return label


def similarity_groups(rows: DataFrame, alike: float, dim: int | None = None, least: int = 5, kind: str = "f4", grids: int = GRIDS, cap: int = CAP) -> DataFrame:
    """``(grp, id, group_key, size, members, near)`` of all records in groups of at least ``least``.

    ``rows`` has ``grp`` and ``id`` (BIGINT) and ``vec`` (an array of
    numbers); records of different ``grp`` never meet. Two records are
    alike if the cosine of their vectors is at least ``alike``; alike
    records are in one group, and so are records linked by alike ones.
    ``group_key`` is the least ``id`` of the group, ``size`` its number of
    distinct ids; ``members`` is the number of linked records in the
    record's cell of the first grid (its density) and ``near`` its cosine
    to their mean. Vectors that are null, of another length than ``dim``
    (of any length, zeros added, if None), not finite or all zero take no
    part, nor do rows with a null ``grp`` or ``id``; repeated rows count
    once; empty tables give none. No column besides the three is read.

    The groups are exact, at any ``cap`` and number of ``grids``. A group of
    ``rows`` that fits a cell is compared there; in larger ones every record
    meets the centre of every ball besides, so work grows with the records
    times the dense cells and stray records.
    """
    rows = rows.select("grp", "id", "vec")
    planes = fit(rows, dim, grids, seed=1)
    placed, tasks = place(rows, dim, planes, cap, kind)
    keys = ["grp", "grid", "depth", "cell", "part", "whole"]
    local = materialise(placed.repartition(tasks, *keys).groupBy(*keys).applyInArrow(_link(alike, DENSE, kind), LOCAL), "cells")
    first = local.where("grid = 0").select("grp", "id", F.col("low").alias("node"), "members", "near")
    nodes = first.groupBy("grp", "node").agg(F.count(F.lit(1)).alias("n"))
    nodes = nodes.select("*", F.col("node").alias("label"))
    if local.where("NOT whole").limit(1).count():
        open_rows = local.where("NOT whole")
        lows = open_rows.groupBy("grp", "id").agg(F.min(F.when(F.col("grid") == 0, F.col("low"))).alias("a"), F.collect_set("low").alias("lows"))
        label = _propagate(lows.select("grp", "a", F.explode("lows").alias("b")).where("a <> b").distinct())
        held = open_rows.where("grid = 0").select("grp", "id", F.col("low").alias("node"), (F.col("members") < DENSE).alias("stray"), "ball", "centre", "reach", "unit")
        told = held.join(small(label, 32), ["grp", "node"], "left").withColumn("label", F.coalesce("label", "node"))
        more = _propagate(_across(told, alike, kind, planes[0].shape[2]))
        joined = label.join(more.select("grp", F.col("node").alias("label"), F.col("label").alias("final")), ["grp", "label"], "left")
        joined = joined.select("grp", "node", F.coalesce("final", "label").alias("linked"))
        # labels that no cell of another grid had joined before
        direct = more.select("grp", "node", F.col("label").alias("direct"))
        nodes = nodes.drop("label").join(joined, ["grp", "node"], "left").join(direct, ["grp", "node"], "left")
        nodes = nodes.select("grp", "node", "n", F.coalesce("linked", "direct", "node").alias("label"))
    nodes = materialise(nodes, "nodes")
    size = nodes.groupBy("grp", "label").agg(F.sum("n").alias("size")).where(F.col("size") >= least)
    groups = nodes.join(size, ["grp", "label"]).select("grp", "node", F.col("label").alias("group_key"), "size")
    # a node has no more records than a cell, so that no key of this join is hot
    return first.join(groups, ["grp", "node"]).select("grp", "id", "group_key", "size", "members", "near")


def describe(groups: DataFrame, typical: int = 3) -> DataFrame:
    """``(grp, group_key, size, typical)``: each group with its most typical members.

    These are the ``typical`` records of its densest cell part that are
    nearest to that part's mean, the least ``id`` first among equals.
    """
    rank = F.row_number().over(Window.partitionBy("grp", "group_key").orderBy(F.desc("members"), F.desc("near"), "id"))
    # a group's candidates are cut within salted parts first, so that no task sorts a whole large group
    salted = Window.partitionBy("grp", "group_key", "salt").orderBy(F.desc("members"), F.desc("near"), "id")
    few = groups.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("r", F.row_number().over(salted)).where(F.col("r") <= typical)
    top = few.withColumn("r", rank).where(F.col("r") <= typical)
    lists = top.groupBy("grp", "group_key").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("r", "id"))).alias("l"))
    return lists.select("grp", "group_key", "size", F.col("l.id").alias("typical"))


def complete_records(responsibilities: DataFrame) -> DataFrame:
    """``(grp, id, vec)`` of the complete records: ``r`` in order of ``sense_id``.

    A record is complete with a non-null ``r`` for every ``sense_id`` that
    occurs for its ``t``. Repeated rows count once (of differing values the
    greatest holds); rows with a null key are left out, a NaN counts as null.
    """
    rows = responsibilities.where("t IS NOT NULL AND row_index IS NOT NULL AND sense_id IS NOT NULL")
    rows = rows.select(F.col("t").cast("bigint").alias("grp"), F.col("row_index").alias("id"), "sense_id", F.when(~F.isnan("r"), F.col("r")).alias("r"))
    senses = rows.select("grp", "sense_id").distinct().groupBy("grp").agg(F.count(F.lit(1)).alias("k"))
    once = rows.repartition("grp", "id").groupBy("grp", "id", "sense_id").agg(F.max("r").alias("r")).where("r IS NOT NULL")
    lists = once.groupBy("grp", "id").agg(F.sort_array(F.collect_list(F.struct("sense_id", "r"))).alias("l"))
    return lists.join(senses, "grp").where(F.size("l") == F.col("k")).select("grp", "id", F.col("l.r").alias("vec"))
