"""Clusters and neighbours against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glosswork.llm import cells, clusters, neighbours


def frame(spark, x, ids=None, grp=None):
    ids = range(len(x)) if ids is None else ids
    grp = [0] * len(x) if grp is None else grp
    rows = [(int(g), int(i), None if v is None else [float(a) for a in v], 1.0, "c") for g, i, v in zip(grp, ids, x)]
    return spark.createDataFrame(rows, "grp bigint, id bigint, vec array<double>, unit double, cell string").repartition(4)


def planted(rng, sizes, dim, spread):
    centres = rng.normal(size=(len(sizes), dim))
    return np.concatenate([c / np.linalg.norm(c) + rng.normal(size=(n, dim)) * spread / np.sqrt(dim) for c, n in zip(centres, sizes)])


def brute_groups(x, alike, least=5, grp=None, ids=None):
    ids = np.arange(len(x)) if ids is None else np.asarray(ids)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= alike
    if grp is not None:
        link &= np.asarray(grp)[:, None] == np.asarray(grp)
    label = np.arange(len(x))
    while True:
        low = np.array([label[row].min() for row in link])
        if (low == label).all():
            break
        label = low
    out = {}
    for k in np.unique(label):
        members = np.flatnonzero(label == k)
        if len(members) >= least:
            out.update({int(ids[m]): int(ids[members].min()) for m in members})
    return out


def found(df):
    return {r["id"]: r["group_key"] for r in df.collect()}


def test_usable_rows():
    lists = pa.array([[1.0, 2.0], None, [1.0], [0.0, 0.0], [np.nan, 1.0], [np.inf, 1.0], [1e300, 1e300], [1.0, None], []], pa.list_(pa.float64()))
    ok, unit = cells.unit_rows(lists, 2)
    assert ok.tolist() == [True, False, False, False, False, False, True, False, False]
    assert np.allclose(np.linalg.norm(unit, axis=1), 1)
    ok, unit = cells.unit_rows(lists.slice(0, 3), None)
    assert ok.tolist() == [True, False, True] and unit.shape == (2, 2)
    ok, unit = cells.unit_rows(lists.slice(2, 5), 2)
    assert ok.tolist() == [False, False, False, False, True]


def test_cells_hold_at_most_their_cap(spark, rng):
    df = frame(spark, np.r_[rng.normal(size=(300, 6)), np.ones((80, 6))])
    placed, tasks = cells.place(df, 6, cells.fit(df, 6, 2, bits=cells.BITS), 40)
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert placed.count() == 2 * 380
    assert placed.groupBy("grid", "id").count().agg(F.max("count")).first()[0] == 1
    sizes = [r[0] for r in placed.where("depth < 24").groupBy("grid", "depth", "cell", "part").count().select("count").collect()]
    assert max(sizes) <= 40
    copies = placed.where("depth = 24 AND id >= 300").groupBy("grid", "cell", "part").count().collect()
    assert len({(r["grid"], r["part"]) for r in copies}) > 2


def test_components(rng):
    u = rng.normal(size=(400, 3))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    label = clusters.components(u, 0.97)
    want = brute_groups(u, 0.97, 1)
    groups = {}
    for i, k in enumerate(label):
        groups.setdefault(k, []).append(i)
    assert {i: min(g) for g in groups.values() for i in g} == want


@pytest.mark.parametrize("cap", [40, 16384])
def test_groups_match_brute_force(spark, rng, cap):
    x = np.r_[planted(rng, [70, 60, 30, 12, 5, 4, 3], 16, 0.3), rng.normal(size=(40, 16))]
    ids = rng.permutation(5000)[: len(x)]
    got = clusters.similarity_groups(frame(spark, x * rng.uniform(0.01, 100, (len(x), 1)), ids), 0.8, dim=16, cap=cap)
    assert found(got) == brute_groups(x, 0.8, ids=ids)


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("spread", [0.48, 0.52])
def test_no_link_is_lost_around_the_threshold(spark, seed, spread, monkeypatch):
    """Groups whose members are about as alike as the threshold asks, in cells far smaller than the table."""
    rng = np.random.default_rng(seed)
    x = planted(rng, [15] * 100 + [200, 7], 64, spread)
    want = brute_groups(x, 0.8)
    assert 500 < len(want) < len(x)
    if seed:
        monkeypatch.setattr(clusters, "BALL_BYTES", 0)  # balls meet records in salted parts instead
        monkeypatch.setattr(clusters, "BLOCK", 100)
    assert found(clusters.similarity_groups(frame(spark, x), 0.8, dim=64, cap=150)) == want


def test_balls_hold_all(rng):
    u = np.concatenate([rng.normal(size=(100, 6)), np.ones((50, 6))])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    got = clusters.balls(u)
    assert sorted(np.concatenate([rows for rows, _, _ in got]).tolist()) == list(range(150))
    for rows, centre, reach in got:
        assert np.isclose(np.linalg.norm(centre), 1) and ((u[rows] @ centre) >= reach - 1e-9).all()
        assert reach >= clusters.TIGHT or len(rows) <= clusters.FEW


def test_chains_are_one_group(spark):
    angle = np.deg2rad(np.arange(0, 330, 30))
    x = np.c_[np.cos(angle), np.sin(angle)]
    got = clusters.similarity_groups(frame(spark, x), 0.85, dim=2)
    assert found(got) == dict.fromkeys(range(11), 0)


def test_groups_keep_apart(spark, rng):
    x = np.repeat(rng.normal(size=(1, 5)), 24, 0)
    grp = [0] * 10 + [1] * 10 + [2] * 4
    got = clusters.similarity_groups(frame(spark, x, grp=grp), 0.9, kind="f8")
    assert found(got) == {i: 10 * (i // 10) for i in range(20)}


def test_copies_beyond_the_cap(spark, rng):
    x = np.r_[np.ones((400, 8)), rng.normal(size=(60, 8))]
    got = found(clusters.similarity_groups(frame(spark, x), 0.95, dim=8, cap=50))
    assert {got[i] for i in range(400)} == {0}


def test_dirty_rows_take_no_part(spark):
    good = [[1.0, 0.1 * i] for i in range(5)]
    x = good + [None, [1.0], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], good[0]]
    df = frame(spark, x, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0]).union(spark.createDataFrame([(0, None, [1.0, 0.0], 0.0, ""), (None, 77, [1.0, 0.0], 0.0, "")], "grp bigint, id bigint, vec array<double>, unit double, cell string"))
    got = clusters.similarity_groups(df, 0.9, dim=2)
    assert found(got) == dict.fromkeys(range(5), 0) and {r["size"] for r in got.collect()} == {5}
    assert clusters.similarity_groups(df.where("id > 100"), 0.9, dim=2).count() == 0
    assert clusters.similarity_groups(df.where("id = 0"), 0.9, dim=2).count() == 0


def test_typical_members(spark, rng):
    x = planted(rng, [40], 8, 0.3)
    groups = clusters.similarity_groups(frame(spark, x), 0.5, dim=8)
    r = clusters.describe(groups).first()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.mean(0)
    assert r["size"] == 40 and r["typical"] == np.argsort(-near)[:3].tolist()


def test_complete_records(spark):
    rows = [(1, 10, 0, 0.4), (1, 10, 1, 0.6), (1, 10, 1, 0.6), (1, 11, 0, 1.0), (1, 11, 1, None), (2, 12, 5, 1.0), (1, 13, 0, float("nan")), (1, 13, 1, 0.5), (None, 14, 0, 1.0), (2, None, 5, 1.0)]
    df = spark.createDataFrame(rows, "t int, row_index bigint, sense_id int, r double").withColumn("grp", F.lit("clash"))
    assert sorted((r["grp"], r["id"], r["vec"]) for r in clusters.complete_records(df).collect()) == [(1, 10, [0.4, 0.6]), (2, 12, [1.0])]
    assert clusters.complete_records(df.where("t = 9")).count() == 0


# -- neighbours --------------------------------------------------------------


def brute_nearest(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), s.shape), -np.round(s, 5)), axis=1)[:, :k]
    return order, np.take_along_axis(s, order, 1)


def test_one_region_is_exact(spark, rng):
    x = planted(rng, [30, 20, 1, 1], 8, 0.4)
    got = neighbours.nearest(frame(spark, x), 5, 8).orderBy("id", "rank").collect()
    order, cosine = brute_nearest(x, 5)
    assert [r["neighbour"] for r in got] == order.ravel().tolist()
    assert np.allclose([r["cosine"] for r in got], cosine.ravel(), atol=1e-5)


@pytest.mark.parametrize("cap", [700, 65536])
def test_recall_of_the_forest(spark, cap):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(2600, 24))
    x = np.r_[base, base[:400] + rng.normal(size=(400, 24)) * 0.18]
    got = {(r["id"], r["neighbour"]) for r in neighbours.nearest(frame(spark, x), 5, 24, least=0.9, cap=cap).collect()}
    order, cosine = brute_nearest(x, 5)
    want = {(i, int(j)) for i in range(len(x)) for j, c in zip(order[i], cosine[i]) if c >= 0.9}
    assert len(want) > 500 and len(got & want) / len(want) >= 0.9 and got <= want


def test_copies_and_ties(spark, rng):
    x = np.r_[np.ones((9, 4)), rng.normal(size=(6, 4))]
    got = neighbours.nearest(frame(spark, x), 5, 4).where("id < 9").orderBy("id", "rank").collect()
    for i in range(9):
        assert [r["neighbour"] for r in got if r["id"] == i] == [j for j in range(9) if j != i][:5]
    many = neighbours.nearest(frame(spark, np.ones((1500, 4))), 5, 4, cap=300)
    assert many.groupBy("id").count().where("count = 5").count() == 1500


def test_search_finds_far_partners(spark, monkeypatch):
    """Data without near neighbours: exact by blocks, and nine tenths of that by the forests of several blocks."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(6000, 24))
    monkeypatch.setattr(neighbours, "INDEX_BLOCK", 2000)
    monkeypatch.setattr(neighbours, "BLOCK", 1500)
    df = frame(spark, x)
    asked = df.where("id % 100 = 0")
    order, _ = brute_nearest(x, 5)
    want = {(i, int(j)) for i in range(0, 6000, 100) for j in order[i]}
    exact = neighbours.search(df, asked, 5, 24, exact=True)
    assert {(r["id"], r["neighbour"]) for r in exact.collect()} == want
    found = neighbours.search(df, asked, 5, 24, quota=1500)
    assert len({(r["id"], r["neighbour"]) for r in found.collect()} & want) >= 0.9 * len(want)
    assert neighbours.recall(found, exact, 0.9).first().asDict() == {"queries": 60, "partners": 300, "enough": True}
    assert not neighbours.recall(found.where("rank < 3"), exact, 0.9).first()["enough"]
    assert neighbours.search(df, df.where("id < 0"), 5, 24).count() == 0
    assert neighbours.recall(found.limit(0), exact.limit(0), 0.9).first()["enough"]


def test_search_of_dirt_and_ties(spark):
    x = [[1.0, 0.0], [1.0, 0.0], None, [0.0, 0.0], [1.0], [float("nan"), 1.0], [1.0, 0.0], [0.0, 1.0]]
    df = frame(spark, x, [0, 1, 2, 3, 4, 5, 0, 7])
    got = sorted((r["id"], r["neighbour"], r["rank"]) for r in neighbours.search(df, df.where("id IN (0, 2, 3)"), 5, 2).collect())
    assert got == [(0, 1, 1), (0, 7, 2)]


def test_copies_name_their_least_ids(spark, rng):
    x = np.r_[np.ones((3000, 8)), rng.normal(size=(200, 8))]
    ids = rng.permutation(9000)[: len(x)]
    least = sorted(ids[:3000].tolist())
    got = neighbours.nearest(frame(spark, x, ids), 5, 8, least=0.9, cap=700).where(F.col("id").isin(ids[:3000].tolist())).collect()
    lists = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        lists.setdefault(r["id"], []).append(r["neighbour"])
    assert lists == {i: [j for j in least[:6] if j != i][:5] for i in least}


@pytest.mark.parametrize("cap", [300, 65536])
def test_a_hot_direction_is_searched_whole(spark, cap):
    rng = np.random.default_rng(13)
    hot = np.ones(24) / np.sqrt(24) + rng.normal(size=(1800, 24)) * 0.004
    x = np.r_[hot, rng.normal(size=(3600, 24))]
    df = frame(spark, x)
    got = {(r["id"], r["neighbour"]) for r in neighbours.nearest(df, 5, 24, least=0.9, cap=cap).where("id < 1800").collect()}
    u = hot / np.linalg.norm(hot, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i, row in enumerate(np.argsort(-s)[:, :5]) for j in row}
    assert len(got) == 9000 and len(got & want) / len(want) >= 0.97
    if cap == 300:
        assert cells.locate(df, 24, cells.fit(df, 24, neighbours.GRIDS, seed=5), cap)[2]


def test_neighbours_of_dirt_and_nothing(spark):
    x = [[1.0, 0.0], [1.0, 0.1], None, [0.0, 0.0], [1.0], [float("nan"), 1.0], [1.0, 0.0]]
    df = frame(spark, x, [0, 1, 2, 3, 4, 5, 0])
    got = sorted((r["id"], r["neighbour"]) for r in neighbours.nearest(df, 5, 2).collect())
    assert got == [(0, 1), (1, 0)]
    assert neighbours.nearest(df.where("id = 0"), 5, 2).count() == 0 and neighbours.nearest(df.where("id > 99"), 5, 2).count() == 0
    pairs = neighbours.close_pairs(neighbours.nearest(df, 5, 2))
    assert [tuple(r) for r in pairs.collect()] == [(0, 1)]


def test_all_trees_ascend_together(rng):
    """A row stops at the longest prefix length at which its nodes of all trees hold the quota."""
    bits, quota = 12, 90
    strings = rng.integers(0, 1 << bits, (3, 400)).astype(np.uint64)
    strings[:, :60] = 5
    order = [np.argsort(s, kind="stable") for s in strings]
    shared = [neighbours.common_bits(s[o], bits) for s, o in zip(strings, order)]
    level = neighbours.ascend(shared, order, bits, quota)
    for i in range(400):
        met = [sum(int((s >> np.uint64(bits - x) == s[i] >> np.uint64(bits - x)).sum()) for s in strings) for x in range(bits + 1)]
        assert level[i] == max([x for x in range(1, bits + 1) if met[x] >= quota], default=0)
    assert (level[:60] == bits).all()  # copies meet whole


@pytest.mark.parametrize("n", [300, 3000])
def test_a_region_is_searched_alike_at_any_size(n):
    """More trees and candidates find more; nothing switches to brute force below a size."""
    rng = np.random.default_rng(14)
    base = rng.normal(size=(n, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    x = np.r_[base, base + rng.normal(size=base.shape) * 0.08].astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(2 * n)
    share = {}
    for trees, quota in ((1, 20), (12, 240)):
        own, other, _ = neighbours.region_neighbours(ids, x, 1, 0.8, 3, trees, quota)
        share[trees] = np.mean((own + n) % (2 * n) == other) * len(own) / (2 * n)
    assert share[1] < share[12] and share[12] > 0.9


def test_forest_candidates_are_its_nodes(rng):
    x = rng.normal(size=(500, 8)).astype(np.float32)
    forest = neighbours.Forest(np.arange(500).tobytes(), x.tobytes(), 4, 100)
    for q, rows in zip(range(20), forest.candidates(x[:20])):
        assert q in rows and len(np.unique(rows)) == len(rows) and 25 <= len(rows) <= 500
