import numpy as np
import pytest
from pyspark.sql import functions as F

from glosswork.operators import distinctiveness, folds, moments, providers, similarity


def test_marginals(toy):
    rows = {r["token"]: r for r in moments.marginals(toy["states"], toy["unembedding"]).collect()}
    assert np.allclose([rows[t]["z"] for t in range(8)], toy["p"].mean(0)) and rows[0]["n"] == 120
    assert np.isclose(sum(r["z"] for r in rows.values()), 1)


def test_moments_and_association(toy, as_matrix):
    m = as_matrix(moments.moments(toy["states"], toy["unembedding"]), "t", "w", "m")
    assert np.allclose(m, toy["p"].T @ toy["p"] / 120) and np.allclose(m, m.T)
    z = toy["p"].mean(0)
    pmi = as_matrix(moments.pmi(moments.moments(toy["states"], toy["unembedding"])), "t", "w", "pmi")
    assert np.allclose(pmi, np.log(m) - np.log(z)[:, None] - np.log(z))


def test_subset_equals_rows_of_the_whole(toy):
    some = moments.moments(toy["states"], toy["unembedding"], targets=[1, 6]).select("t", "w", F.round("m", 9), F.round("z_t", 9), F.round("z_w", 9))
    whole = moments.moments(toy["states"], toy["unembedding"]).where("t IN (1, 6)").select("t", "w", F.round("m", 9), F.round("z_t", 9), F.round("z_w", 9))
    assert sorted(some.collect()) == sorted(whole.collect())
    with pytest.raises(ValueError):
        moments.moments(toy["states"], toy["unembedding"], targets=[99])


def test_token_ids_need_not_be_places(spark, toy, as_matrix):
    moved = toy["unembedding"].withColumn("token", F.col("token") * 10 + 5)
    names = {r["t"] for r in moments.moments(toy["states"], moved).select("t").distinct().collect()}
    assert names == {10 * t + 5 for t in range(8)}
    z = {r["token"]: r["z"] for r in moments.marginals(toy["states"], moved).collect()}
    assert np.allclose([z[10 * t + 5] for t in range(8)], toy["p"].mean(0))


def test_stored_and_live_agree(spark, toy, as_matrix):
    stored = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(toy["p"])], "row bigint, p array<double>")
    assert np.allclose(as_matrix(moments.moments_of(stored), "t", "w", "m_sum"), toy["p"].T @ toy["p"])
    long = providers.probabilities(toy["states"], toy["unembedding"])
    assert np.allclose(as_matrix(long, "row", "token", "p"), toy["p"])


def test_pair_similarity(spark, toy):
    p, z = toy["p"], toy["p"].mean(0)
    pairs = spark.createDataFrame([(0, 1, "a"), (1, 0, "b"), (0, 1, "c"), (None, 2, "d"), (3, 77, "e"), (4, 4, "f")], "t1 int, t2 int, note string")
    got = {r["note"]: r for r in similarity.pair_similarities(pairs, toy["states"], toy["unembedding"]).collect()}
    assert len(got) == 6 and got["d"]["kl"] is None and got["e"]["kl"] is None
    w = p[:, 0] / p[:, 0].sum()
    assert np.isclose(got["a"]["expected_probability"], w @ p[:, 1]) and np.isclose(got["a"]["expected_surprisal"], -w @ np.log(p[:, 1]))
    assert np.isclose(got["a"]["kl"], w @ (np.log(p[:, 0]) - np.log(p[:, 1])) + np.log(z[1]) - np.log(z[0]))
    assert got["a"]["kl"] == got["c"]["kl"] and got["a"]["kl"] != got["b"]["kl"] and abs(got["f"]["kl"]) < 1e-12
    alone = similarity.pair_similarities(pairs.where("note = 'a'"), toy["states"], toy["unembedding"], ["kl"]).first()
    assert np.isclose(alone["kl"], got["a"]["kl"])
    with pytest.raises(ValueError):
        similarity.pair_similarities(pairs, toy["states"], toy["unembedding"], ["cosine"])


def test_distinctiveness(toy):
    z = toy["p"].mean(0)
    sample = distinctiveness.with_log_partition(toy["states"], toy["unembedding"])
    d = np.log(toy["p"]) - np.log(z)
    field = distinctiveness.distinctiveness_field(sample, toy["unembedding"], 2, float(z[2]))
    got = np.array([r["d"] for r in field.orderBy("row").collect()])
    assert np.allclose(got, d[:, 2])
    one = distinctiveness.expected_distinctiveness(field).first()
    w = np.exp(d[:, 2])
    assert np.isclose(one["kl"], (w * d[:, 2]).sum() / w.sum()) and one["kl"] >= 0 and np.isclose(one["mean_omega"], 1)
    assert np.isclose(one["ess"], w.sum() ** 2 / (w * w).sum())
    every = {r["token"]: r for r in distinctiveness.expected_distinctiveness_all(toy["states"], toy["unembedding"]).collect()}
    assert np.isclose(every[2]["kl"], one["kl"]) and np.isclose(every[2]["ess"], one["ess"])
    with pytest.raises(ValueError):
        distinctiveness.distinctiveness_field(sample, toy["unembedding"], 2, 0.0)


def test_tokens_without_a_marginal(toy):
    z = toy["p"].mean(0)
    z[3] = 0
    every = {r["token"]: r for r in distinctiveness.expected_distinctiveness_all(toy["states"], toy["unembedding"], z).collect()}
    assert every[3]["kl"] is None and every[3]["ess"] == 0 and every[2]["kl"] is not None


def test_constant_weights_say_nothing(spark):
    states = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "row bigint, h array<double>")
    flat = spark.createDataFrame([(t, [0.0, 0.0]) for t in range(5)], "token int, w array<double>")
    for r in distinctiveness.expected_distinctiveness_all(states, flat).collect():
        assert abs(r["kl"]) < 1e-12 and np.isclose(r["ess"], 20)


def test_excess_moments_and_centroids(toy, as_matrix):
    p, h, z = toy["p"], toy["h"], toy["p"].mean(0)
    d = np.maximum(0, np.log(p) - np.log(z))
    assert np.allclose(as_matrix(moments.excess_moments(toy["states"], toy["unembedding"], z), "t", "w", "m"), d.T @ p / 120)
    c = as_matrix(moments.centroids(toy["states"], toy["unembedding"], "aitchison"), "t", "j", "x")
    assert np.allclose(c, p.T @ h / p.sum(0)[:, None] - h.mean(0))
    plus = as_matrix(moments.centroids(toy["states"], toy["unembedding"], z=z), "t", "j", "x")
    assert np.allclose(plus, d.T @ h / d.sum(0)[:, None])
    with pytest.raises(ValueError):
        moments.centroids(toy["states"], toy["unembedding"], "nowhere")


def test_certain_predictions_give_the_states_themselves(spark, rng, as_matrix):
    w = rng.normal(size=(5, 5))
    h = np.linalg.solve(w, 50 * np.eye(5)).T
    states = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(h)], "row bigint, h array<double>")
    model = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(w)], "token int, w array<double>")
    assert np.allclose(as_matrix(moments.centroids(states, model), "t", "j", "x"), h, atol=1e-6)


def test_log_ratio_coordinates_need_no_softmax(toy, as_matrix):
    a = as_matrix(moments.ilr_of_unembedding(toy["unembedding"]).selectExpr("i - 1 i", "j", "y"), "i", "j", "y")
    from glosswork.functions.geometry import ilr_matrix

    assert np.allclose(toy["h"] @ a.T, ilr_matrix(np.log(toy["p"]).T).T)


def test_degenerate_direction(spark, rng):
    w = np.c_[rng.normal(size=(6, 3)), np.ones(6)]
    model = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(w)], "token int, w array<double>")
    assert np.allclose(moments.degenerate_direction(model), [0, 0, 0, 1], atol=1e-9)
    with pytest.raises(RuntimeError):
        moments.degenerate_direction(spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0])], "token int, w array<double>"))


def test_empty_states(spark, toy):
    assert folds.fold(toy["states"].where("row < 0"), toy["w"], lambda h, lp: {"z": lp.sum(0)}).count() == 0


def test_size_of_the_model_is_checked(spark, monkeypatch, toy):
    monkeypatch.setattr(providers, "MODEL_BYTES", 10)
    with pytest.raises(ValueError):
        moments.marginals(toy["states"], toy["unembedding"])


def test_blocks_of_targets_add_up_alike(toy, as_matrix, monkeypatch):
    """Moments by blocks of two targets are those of one block; stored distributions too."""
    whole = as_matrix(moments.moments(toy["states"], toy["unembedding"]), "t", "w", "m")
    z = toy["p"].mean(0)
    excess = as_matrix(moments.excess_moments(toy["states"], toy["unembedding"], z), "t", "w", "m")
    monkeypatch.setattr(folds, "BLOCK_BYTES", 8 * 8 * 2)
    assert len(folds.target_blocks(8, 8)) == 4
    assert np.allclose(as_matrix(moments.moments(toy["states"], toy["unembedding"]), "t", "w", "m"), whole)
    assert np.allclose(as_matrix(moments.excess_moments(toy["states"], toy["unembedding"], z), "t", "w", "m"), excess)
    subset = moments.moments(toy["states"], toy["unembedding"], targets=[1, 5, 6])
    assert {r["t"] for r in subset.collect()} == {1, 5, 6}
    stored = toy["states"].sparkSession.createDataFrame([(x.tolist(),) for x in toy["p"]], "p array<double>")
    assert np.allclose(as_matrix(moments.moments_of(stored), "t", "w", "m_sum"), toy["p"].T @ toy["p"])


def test_pairs_come_in_slabs(spark, toy, monkeypatch):
    pairs = spark.createDataFrame([(a, b) for a in range(8) for b in range(8)] + [(1, 99), (None, 2)], "t1 int, t2 int")
    one = {(r["t1"], r["t2"]): r["kl"] for r in similarity.pair_similarities(pairs, toy["states"], toy["unembedding"], ["kl"]).collect()}
    monkeypatch.setattr(similarity, "SLAB_PAIRS", 20)
    many = {(r["t1"], r["t2"]): r["kl"] for r in similarity.pair_similarities(pairs, toy["states"], toy["unembedding"], ["kl"]).collect()}
    assert one.keys() == many.keys() and one[1, 99] is None and all(one[k] is None or np.isclose(one[k], many[k]) for k in one)
    none = similarity.pair_similarities(pairs.limit(0), toy["states"], toy["unembedding"])
    assert none.count() == 0 and none.columns == ["t1", "t2", "expected_probability", "expected_surprisal", "kl"]


@pytest.mark.parametrize("bound", [None, 16 << 20, 0])
def test_moments_of_a_vocabulary_that_is_not_held(spark, monkeypatch, bound):
    monkeypatch.setattr(providers, "MODEL_BYTES", 1024)  # the vocabulary must reach neither driver nor tasks whole
    monkeypatch.setattr(moments, "WHOLE_BYTES", 0, raising=False)
    if bound is not None:
        from glosswork.operators import blocks

        monkeypatch.setattr(blocks, "STATE_BYTES", bound)
        monkeypatch.setattr(blocks, "STATE_ROWS", 16)
        monkeypatch.setattr(blocks, "TOKEN_ROWS", 16)
    r = np.random.default_rng(5)
    h, w = r.normal(size=(70, 4)), r.normal(size=(50, 4)) * 20
    states = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(h)] + [(99, None)], "row bigint, h array<double>").repartition(3)
    unembedding = spark.createDataFrame([(3 * i + 1, x.tolist()) for i, x in enumerate(w)], "token int, w array<double>").repartition(4)
    logits = h @ w.T
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    z = p.mean(0)
    rows = moments.moments(states, unembedding, targets=[1, 22, 148]).collect()
    assert len(rows) == 150 and {x["t"] for x in rows} == {1, 22, 148}
    for x in rows:
        t, k = (x["t"] - 1) // 3, (x["w"] - 1) // 3
        assert np.allclose([x["m"], x["z_t"], x["z_w"]], [(p[:, t] * p[:, k]).mean(), z[t], z[k]], rtol=1e-9, atol=1e-300)
    given = spark.createDataFrame([(3 * i + 1, 0.5 + i) for i in range(50)], "token int, z double")
    assert {(x["t"], x["z_t"]) for x in moments.moments(states, unembedding, [1, 22], given).collect()} == {(1, 0.5), (22, 7.5)}
    assert moments.moments(states.where("row < 0"), unembedding, [1]).count() == 0
    assert moments.moments(states, unembedding, []).count() == 0
    with pytest.raises(ValueError):
        moments.moments(states, unembedding, targets=[2])


def test_usable_vocabulary(spark):
    rows = [(4, [3.0, 4.0]), (4, [0.0, 0.0]), (4, [3.0, 4.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1e31, 1.0]), (8, None), (9, [1.0]), (None, [1.0, 1.0]), (2, [0.0, -2.0])]
    sample = spark.createDataFrame(rows, "row_index bigint, h array<float>")
    got = providers.usable_unembedding(sample, dim=2)
    assert dict(got.dtypes) == {"token": "int", "w": "array<double>"}
    assert {r["token"]: [round(x, 9) for x in r["w"]] for r in got.collect()} == {4: [4.8, 6.4], 2: [0.0, -8.0]} and got.count() == 2
