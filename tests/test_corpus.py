import numpy as np
import pytest
from pyspark.sql import functions as F

from glosswork.functions import windowing
from glosswork.operators import corpus, providers


def stream(spark, docs):
    rows = [(d, p, t) for d, tokens in docs.items() for p, t in enumerate(tokens)]
    return spark.createDataFrame(rows, "doc_id bigint, pos bigint, token int")


def test_latest_rows_hold(spark):
    rows = [(1, 0, 5, 1), (1, 0, 6, 2), (1, 1, 7, 1), (1, 1, 7, 1), (None, 1, 7, 1), (1, None, 7, 1), (1, 2, None, 9), (1, 2, 3, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, pos bigint, token int, at int").select("doc_id", "pos", "token", F.timestamp_seconds("at").alias("loaded_at"))
    assert sorted(map(tuple, corpus.latest(df).collect())) == [(1, 0, 6), (1, 1, 7)]
    assert corpus.latest(df.where("doc_id = 9")).count() == 0


def test_window_counts_match_a_loop(spark, rng):
    docs = {d: rng.integers(0, 6, 40).tolist() for d in range(3)}
    off = windowing.offsets(spark, 2, "harmonic", include_target=False)
    got = {(r["t"], r["w"]): r["f"] for r in corpus.window_counts(stream(spark, docs), off).collect()}
    want = {}
    for tokens in docs.values():
        for i, t in enumerate(tokens):
            for o, wt in ((-2, 0.5), (-1, 1), (1, 1), (2, 0.5)):
                if 0 <= i + o < len(tokens):
                    want[t, tokens[i + o]] = want.get((t, tokens[i + o]), 0) + wt
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)
    few = spark.createDataFrame([(0,), (1,)], "token int")
    assert {t for t, _ in ((r["t"], r["w"]) for r in corpus.window_counts(stream(spark, docs), off, few).collect())} <= {0, 1}


def test_count_pmi(spark):
    counts = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, 3.0), (1, 1, 1.0)], "t int, w int, f double")
    got = {(r["t"], r["w"]): r["pmi"] for r in corpus.count_pmi(counts).collect()}
    assert np.isclose(got[0, 1], np.log(3 * 8 / 16)) and np.isclose(got[0, 0], np.log(8 / 16))


def test_next_tokens_and_phrases(spark):
    c = stream(spark, {1: [1, 2, 3, 1, 2, 1, 2, 3], 2: [3, 1, 2]})
    assert sorted((r["doc_id"], r["pos"]) for r in corpus.predicting(c, 3).collect()) == [(1, 1), (1, 6)]
    assert sorted(map(tuple, corpus.phrase_ends(c, [1, 2, 3]).collect())) == [(1, 1), (1, 6)]
    assert sorted(map(tuple, corpus.phrase_ends(c, [2]).collect())) == [(1, 0), (1, 3), (1, 5), (2, 1)]
    twice = stream(spark, {1: [4, 4, 4]})
    assert sorted(map(tuple, corpus.phrase_ends(twice, [4, 4]).collect())) == [(1, 0), (1, 1)]
    with pytest.raises(ValueError):
        corpus.phrase_ends(c, [])


def test_snippets_are_clipped(spark):
    c = stream(spark, {1: [0, 1, 2, 3]})
    vocab = spark.createDataFrame([(0, "a"), (1, "b"), (2, None), (3, "d")], "token int, str string")
    places = spark.createDataFrame([(1, 0), (1, 2), (1, 9)], "doc_id bigint, pos bigint")
    got = {r["pos"]: (r["context_before"], r["focus"], r["context_after"]) for r in corpus.snippets(c, places, vocab, 2, 2).collect()}
    assert got == {0: ("a", "b", "d"), 2: ("b", "d", ""), 9: ("", "", "")}


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(200).withColumnRenamed("id", "row")
    a = [r[0] for r in corpus.sampled(rows.repartition(7), ["row"], 20).collect()]
    b = [r[0] for r in corpus.sampled(rows.coalesce(1), ["row"], 20).collect()]
    assert a == b == sorted(a) and len(a) == 20
    assert corpus.sampled(rows, ["row"], 999).count() == 200


def test_valid_positions(spark):
    lengths = spark.createDataFrame([(1, 10), (2, 3)], "doc_id bigint, length bigint")
    got = corpus.valid_positions(lengths, 2, 1).where("doc_id = 1").orderBy("row").collect()
    assert [(r["row"], r["pos"]) for r in got] == [(i, i + 2) for i in range(7)]
    assert corpus.valid_positions(lengths, 2, 1).where("doc_id = 2").count() == 0


def test_windows_over_stretches(spark, monkeypatch, rng):
    docs = {d: rng.integers(0, 50, 70).tolist() for d in range(2)}
    window = windowing.Window(((-2, 1.0), (0, 1.0), (3, 1.0)))
    monkeypatch.setattr(corpus, "STRETCH_BITS", 3)
    got = {(r["doc_id"], r["pos"]): r["tokens"] for r in corpus.in_windows(stream(spark, docs).where("pos <> 20"), window).collect()}
    want = {(d, p): [t[p - 2], t[p], t[p + 3]] for d, t in docs.items() for p in range(2, 67) if 20 not in (p - 2, p, p + 3)}
    want = {k: v for k, v in want.items() if not any(q == 20 for q in range(k[1] - 2, k[1] + 4))}
    assert got == want


def test_window_predictions_agree_with_averages(spark, rng, monkeypatch):
    c = stream(spark, {1: rng.integers(0, 4, 60).tolist()})
    model = providers.bigram_predictions(*providers.bigram_model(c), [0, 1, 2])
    off = windowing.offsets(spark, 1, "exponential", 0.5)
    fast, names = corpus.window_predictions(c, off, model)
    assert names == [0, 1, 2]
    a = {(r["doc_id"], r["pos"]): r["p"] for r in fast.collect()}
    monkeypatch.setattr(corpus, "BROADCAST_BYTES", 1)
    slow, _ = corpus.window_predictions(c, off, model)
    b = {(r["doc_id"], r["pos"]): r["p"] for r in slow.collect()}
    assert a.keys() == b.keys() and len(a) == 58 and all(np.allclose(a[k], b[k]) for k in a)


def test_bigram_model_sums_to_one(spark, rng):
    tokens = rng.integers(0, 5, 80).tolist() + [7]
    c = stream(spark, {1: tokens})
    model, size = providers.bigram_model(c)
    assert size == 6
    whole = providers.bigram_predictions(model, size, [0, 1, 2, 3, 4, 7])
    assert all(np.isclose(r["s"], 1) for r in whole.groupBy("prev").agg(F.sum("p").alias("s")).collect())
    seen = {(r["prev"], r["token"]): r["p"] for r in model.collect()}
    filled = {(r["prev"], r["token"]): r["p"] for r in whole.collect()}
    assert all(np.isclose(filled[k], p) for k, p in seen.items()) and len(filled) == 30
    loss = corpus.perplexity(model.select("p", F.col("n").cast("double").alias("weight"))).first()
    assert loss["n"] == 80 and np.isclose(loss["perplexity"], np.exp(loss["loss"]))
    z = {r["token"]: r["z"] for r in providers.bigram_marginals(model, size).collect()}
    weight = {t: tokens[:-1].count(t) for t in range(5)}
    assert np.isclose(sum(z.values()), 1) and np.isclose(z[7], sum(weight[p] * filled[p, 7] for p in weight) / 80)


@pytest.mark.parametrize("bits", [3, 16])
def test_window_pairs_and_counts(spark, monkeypatch, rng, bits):
    """Pairs over stretches and batches with gaps, against plain loops."""
    monkeypatch.setattr(corpus, "STRETCH_BITS", bits)
    monkeypatch.setattr(corpus, "HELD_PAIRS", 50)
    docs = {d: rng.integers(0, 6, 60).tolist() for d in range(3)}
    c = stream(spark, docs).where("pos NOT IN (20, 21, 40)")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        off = spark.createDataFrame([(-2, 0.5), (1, 1.0), (0, 0.25), (9, 2.0)], "o int, wt double")
        held = {(d, p): t for d, ts in docs.items() for p, t in enumerate(ts) if p not in (20, 21, 40)}
        want = sorted((d, p, t, o, held[d, p + o], w) for (d, p), t in held.items() for o, w in ((-2, 0.5), (1, 1.0), (0, 0.25), (9, 2.0)) if (d, p + o) in held)
        assert sorted(tuple(r) for r in corpus.window_pairs(c, off).collect()) == want
        sums = {}
        for _, _, t, _, other, w in want:
            sums[t, other] = sums.get((t, other), 0) + w
        got = {(r["t"], r["w"]): r["f"] for r in corpus.window_counts(c, off).collect()}
        assert got.keys() == sums.keys() and all(np.isclose(got[k], sums[k]) for k in sums)
        after = sorted(tuple(r) for r in corpus.next_token(c).collect())
        assert after == sorted((d, p, t, held[d, p + 1]) for (d, p), t in held.items() if (d, p + 1) in held)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert corpus.window_counts(c.where("pos < 0"), off).count() == 0


def test_sample_of_ties_and_none(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (3, 3)], "doc_id bigint, pos bigint")
    assert [corpus.sampled(df, ["doc_id", "pos"], n).count() for n in (0, 1, 2, 3, 4, 9)] == [0, 1, 2, 3, 4, 4]


def test_words_and_counts(spark):
    docs = spark.createDataFrame([(1, "Élan, élan 2nd"), (2, None), (3, ""), (4, "ÉLAN")], "doc_id bigint, text string")
    got = {r["word"]: (r["n"], r["docs"]) for r in corpus.vocabulary_counts(corpus.words(docs), "word").collect()}
    assert got == {"élan": (3, 2), "nd": (1, 1)}


def test_training_blocks(spark):
    c = stream(spark, {1: list(range(30))})
    rows = corpus.training_blocks(c, 5, 4).collect()
    assert len(rows) == 4 and all(r["x"] == list(range(r["start"], r["start"] + 5)) and r["y"] == list(range(r["start"] + 1, r["start"] + 6)) for r in rows)
