"""Splitting, frequency and co-occurrence over the token stream, against plain loops."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosswork.llm import cooccur, corpus, frequency, split

SCHEMA = "doc_id bigint, pos bigint, token int, loaded_at timestamp_ntz, level string"


def stream(spark, rows):
    """Rows ``(doc_id, pos, token, second)`` as a corpus with columns that clash with inner names."""
    df = spark.createDataFrame(rows, "doc_id bigint, pos bigint, token int, at bigint")
    return df.select("doc_id", "pos", "token", F.timestamp_seconds("at").cast("timestamp_ntz").alias("loaded_at"), F.lit("x").alias("chunk"), F.lit("y").alias("level"), F.lit(1).alias("n"))


def vocabulary(spark, tokens, ends=()):
    marks = dict(ends)
    return spark.createDataFrame([(t, f"w{t}", marks.get(t), "z") for t in tokens], "token int, str string, boundary string, level string")


def docs_of(docs):
    return [(d, p, t, 0) for d, tokens in docs.items() for p, t in enumerate(tokens)]


DIRT = [(1, 0, 3, 0), (1, 0, 4, 5), (1, 1, 3, 0), (1, 1, 3, 0), (1, 2, None, 9), (1, 2, 3, 1), (1, 3, 999, 0), (None, 1, 3, 0), (2, None, 3, 0), (2, 7, 5, None), (2, 7, 4, None), (2, 8, 4, None), (2, 8, 5, 1)]


def test_current_tokens(spark):
    got = corpus.current(stream(spark, DIRT[:9] + DIRT[11:]), vocabulary(spark, [3, 4, 5, 3]), F.lit(0) * F.col("pos"))
    assert sorted((r.doc_id, r.pos, r.token) for r in got.collect()) == [(1, 0, 4), (1, 1, 3), (2, 8, 5)]


def test_boundary_levels(spark):
    v = vocabulary(spark, range(5), {0: "sentence", 1: " Paragraph ", 2: "document", 3: "other"}.items())
    assert [r[0] for r in v.orderBy("token").select(corpus.boundary_level()).collect()] == [1, 2, 3, 0, 0]


# -- splitting ---------------------------------------------------------------


def check_pieces(tokens, marks, pieces, limit, overlap):
    """Every piece within the limit, no token lost, the overlap right, cuts at boundaries where one is in reach."""
    pieces = sorted(pieces, key=lambda r: r["fresh"])
    assert pieces[0]["fresh"] == 0 and pieces[-1]["last"] == len(tokens) and pieces[-1]["cut"] == "end"
    for a, b in zip(pieces, pieces[1:]):
        assert b["fresh"] == a["last"] and b["first"] == max(0, b["fresh"] - overlap)
    for p in pieces:
        assert 0 < p["last"] - p["fresh"] and p["n_tokens"] == p["last"] - p["first"] <= limit
        if p["cut"] == "inside":
            begin = end = p["last"]
            while begin > 0 and tokens[begin - 1] not in marks:
                begin -= 1
            while end < len(tokens) and tokens[end] not in marks:
                end += 1
            assert end - begin >= limit - overlap  # a stretch too long for any piece, boundary or not
        elif p["cut"] != "end":
            assert marks[tokens[p["last"] - 1]] == p["cut"]


@pytest.mark.parametrize("seed", range(4))
def test_pieces(spark, seed):
    rng = np.random.default_rng(seed)
    marks = {0: "sentence", 1: "paragraph", 2: "document"}
    docs = {}
    for d in range(6):
        n = int(rng.integers(1, 400))
        docs[d] = [int(rng.choice([0, 1, 2])) if rng.random() < (0.1, 0.02)[d % 2] else int(rng.integers(3, 9)) for _ in range(n)]
    vocab = vocabulary(spark, range(9), marks.items())
    got = split.split(stream(spark, docs_of(docs)), vocab, 40, 8).collect()
    for d, tokens in docs.items():
        mine = [r for r in got if r["doc_id"] == d]
        check_pieces(tokens, marks, mine, 40, 8)
        runs = "".join("." if t in marks else "x" for t in tokens).split(".")
        divided = [n for n in map(len, runs) if n > 32]
        assert max(r["run"] for r in mine) == max(divided, default=0) or max(r["run"] for r in mine) == 32
    large = {r["doc_id"] for r in split.split(stream(spark, docs_of(docs)), vocab, 40, 8, oversized_only=True).collect()}
    assert large == {d for d, t in docs.items() if len(t) > 40}


def test_long_documents_are_packed_by_segment(spark, monkeypatch, rng):
    monkeypatch.setattr(split, "CHUNK_BITS", 5)
    monkeypatch.setattr(split, "SEGMENT_BITS", 7)
    marks = {0: "sentence", 1: "paragraph"}
    tokens = [0 if i % 9 == 8 else 1 if i % 31 == 30 else 5 for i in range(1000)]
    vocab = vocabulary(spark, range(9), marks.items())
    got = split.split(stream(spark, docs_of({1: tokens})), vocab, 40, 8).collect()
    assert len({r["segment"] for r in got}) == 8
    check_pieces(tokens, marks, got, 40, 8)
    assert all(r["cut"] != "inside" for r in got)
    bare = split.split(stream(spark, docs_of({1: [5] * 500})), vocab, 40, 8).collect()
    check_pieces([5] * 500, marks, bare, 40, 8)
    assert {r["run"] for r in bare} == {500}


def test_coarse_boundaries_are_preferred(spark):
    marks = {0: "sentence", 1: "paragraph"}
    tokens = [5] * 9 + [1] + ([5] * 4 + [0]) * 3 + [5] * 4 + [1] + [5] * 10
    got = split.split(stream(spark, docs_of({1: tokens})), vocabulary(spark, range(6), marks.items()), 24, 0).collect()
    assert sorted((r["fresh"], r["last"], r["cut"]) for r in got)[0] == (0, 10, "paragraph")


def test_piece_tokens(spark, rng):
    docs = {d: rng.integers(0, 9, 150).tolist() for d in range(3)}
    vocab = vocabulary(spark, range(9), {0: "sentence"}.items())
    got = split.piece_tokens(stream(spark, docs_of(docs)), vocab, 32, 4).collect()
    for r in got:
        assert r["tokens"] == docs[r["doc_id"]][r["first"] : r["first"] + len(r["tokens"])] and len(r["tokens"]) <= 32
    for d, tokens in docs.items():
        mine = sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["fresh"])
        assert sum((r["tokens"][r["fresh"] - r["first"] :] for r in mine), []) == tokens


def test_oversized_documents(spark):
    vocab = vocabulary(spark, range(9), {0: "sentence"}.items())
    docs = {1: [5] * 40, 2: [5] * 41, 3: ([5] * 9 + [0]) * 5, 4: [5] * 32 + [0] + [5] * 32}
    got = split.oversized(split.split(stream(spark, docs_of(docs)), vocab, 40, 8, oversized_only=True), 40, 8)
    assert sorted(map(tuple, got.collect())) == [(2, "inside"), (3, "boundary"), (4, "boundary")]


def test_splitting_nothing(spark):
    vocab = vocabulary(spark, range(9))
    none = stream(spark, docs_of({1: [5]})).where("doc_id = 9")
    assert split.split(none, vocab).count() == 0 and split.piece_tokens(none, vocab).count() == 0
    assert split.split(stream(spark, docs_of({1: [5]})), vocab.where("token = 99")).count() == 0
    assert split.split(stream(spark, DIRT[:9]), vocab).count() == 1
    with pytest.raises(ValueError):
        split.split(none, vocab, 10, 10)


# -- frequency ---------------------------------------------------------------


def frequencies(docs):
    n, d = Counter(), Counter()
    for tokens in docs.values():
        n.update(tokens)
        d.update(set(tokens))
    return n, d


def test_frequency(spark, rng):
    docs = {d: np.minimum(rng.zipf(1.5, 60), 40).tolist() for d in range(20)}
    got = frequency.token_frequency(stream(spark, docs_of(docs)), vocabulary(spark, range(41))).collect()
    n, d = frequencies(docs)
    assert {r["token"]: (r["n"], r["docs"]) for r in got} == {t: (n[t], d[t]) for t in n}
    marks = {r["token"]: r["mark"] for r in got}
    assert all(m == ("rare" if d[t] <= 2 else "common" if d[t] > 10 else None) for t, m in marks.items())


def test_shared_records_count_once(spark, rng, monkeypatch):
    docs = {d: rng.integers(0, 30, 500).tolist() for d in range(4)}
    monkeypatch.setattr(frequency, "CHUNK_BITS", 4)
    monkeypatch.setattr(frequency, "heavy_hitters", lambda c: ([0, 1, 2], [1, 3]))
    got = frequency.token_frequency(stream(spark, docs_of(docs)), vocabulary(spark, range(30))).collect()
    n, d = frequencies(docs)
    assert {r["token"]: (r["n"], r["docs"]) for r in got} == {t: (n[t], d[t]) for t in n}


def test_frequency_of_dirt_and_nothing(spark):
    got = frequency.token_frequency(stream(spark, DIRT[:9] + DIRT[11:]), vocabulary(spark, [3, 4, 5])).collect()
    assert {r["token"]: (r["n"], r["docs"], r["mark"]) for r in got} == {3: (1, 1, "rare"), 4: (1, 1, "rare"), 5: (1, 1, "rare")}
    none = stream(spark, DIRT).where("doc_id = 99")
    assert frequency.token_frequency(none, vocabulary(spark, [3])).count() == 0
    assert frequency.token_frequency(stream(spark, DIRT), vocabulary(spark, [3]).where("token = 1")).count() == 0


# -- co-occurrence -----------------------------------------------------------


def together(baskets):
    n, ab = Counter(), Counter()
    for items in baskets.values():
        n.update(set(items))
        ab.update(combinations(sorted(set(items)), 2))
    return n, ab


def check_pairs(got, baskets, least, lift):
    n, ab = together(baskets)
    total = sum(bool(b) for b in baskets.values())
    want = {k: v for k, v in ab.items() if v >= least and v * total / (n[k[0]] * n[k[1]]) >= lift}
    assert {(r["item_a"], r["item_b"]): r["n_ab"] for r in got} == want
    for r in got:
        assert r["n"] == total and r["n_a"] == n[r["item_a"]] and r["n_b"] == n[r["item_b"]]
        assert np.isclose(r["lift"], r["n_ab"] * total / (r["n_a"] * r["n_b"])) and np.isclose(r["pmi"], np.log(r["lift"]))


@pytest.mark.parametrize("least,lift", [(1, 0.0), (3, 1.2)])
@pytest.mark.parametrize("chunk", [4, 1024])
def test_pairs_of_baskets(spark, rng, monkeypatch, least, lift, chunk):
    monkeypatch.setattr(cooccur, "CHUNK_ITEMS", chunk)
    monkeypatch.setattr(cooccur, "BUCKET_PAIRS", 50)
    baskets = {b: rng.integers(-5, 25, int(rng.integers(1, 24))).tolist() for b in range(40)}
    rows = [(b, i) for b, items in baskets.items() for i in items] + [(None, 1), (3, None)]
    df = spark.createDataFrame(rows, "basket bigint, item int").repartition(5)
    gathered = cooccur.gather_baskets(df, ["basket"], "item")
    assert (gathered.where("parts > 1").count() > 0) == (chunk == 4)
    check_pairs(cooccur.cooccurrence(gathered, ["basket"], least, lift).collect(), baskets, least, lift)


def test_items_beyond_the_bound_are_not_left_out_early(spark, rng, monkeypatch):
    monkeypatch.setattr(cooccur, "BROADCAST_BYTES", 8)
    baskets = {b: rng.integers(0, 12, 6).tolist() for b in range(30)}
    df = spark.createDataFrame([(b, i) for b, items in baskets.items() for i in items], "basket bigint, item int")
    check_pairs(cooccur.cooccurrence(cooccur.gather_baskets(df, ["basket"], "item"), ["basket"], 2, 1.0).collect(), baskets, 2, 1.0)


def test_blocks_of_documents(spark, rng):
    docs = {d: rng.integers(0, 40, 200).tolist() for d in range(5)}
    baskets = defaultdict(list)
    for d, tokens in docs.items():
        for p, t in enumerate(tokens):
            if t != 39:
                baskets[d, p // 32].append(t)
    got = cooccur.cooccurrence(cooccur.block_baskets(stream(spark, docs_of(docs)), vocabulary(spark, range(39))), ["doc_id", "block"], 2, 1.0)
    check_pairs(got.collect(), baskets, 2, 1.0)


def test_pairs_of_nothing(spark):
    none = spark.createDataFrame([], "basket bigint, item int")
    assert cooccur.cooccurrence(cooccur.gather_baskets(none, ["basket"], "item"), ["basket"], 1).count() == 0
    single = spark.createDataFrame([(1, 5), (1, 5), (2, 6)], "basket bigint, item int")
    assert cooccur.cooccurrence(cooccur.gather_baskets(single, ["basket"], "item"), ["basket"], 1).count() == 0
    assert cooccur.cooccurrence(cooccur.block_baskets(stream(spark, DIRT).where("doc_id = 9"), vocabulary(spark, [3])), ["doc_id", "block"], 1).count() == 0


def test_runs_survive_packing(rng):
    key = np.unique(rng.integers(-(1 << 62), 1 << 62, 500))
    count = rng.integers(1, 1 << 30, len(key))
    k, c = cooccur._unpack(cooccur._pack(key, count))
    assert np.array_equal(k, key) and np.array_equal(c, count)
    assert len(cooccur._unpack(cooccur._pack(key[:0], count[:0]))[0]) == 0
