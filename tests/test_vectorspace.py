import numpy as np
import pytest
from pyspark.sql import functions as F

from glosswork.operators import density, distinctiveness, mixtures, moments, vectorspace


def frame(spark, x, key="row", column="h"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{key} bigint, {column} array<double>").repartition(3)


def test_principal_axes(spark, rng):
    x = rng.normal(size=(200, 4)) * [3, 2, 1, 0.5]
    mean, axes, value = vectorspace.principal_axes(frame(spark, x))
    assert np.allclose(mean, x.mean(0)) and np.allclose(value, np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1])
    assert np.allclose(axes.T @ axes, np.eye(4))
    _, _, raw = vectorspace.principal_axes(frame(spark, x), centred=False)
    assert np.allclose(np.sqrt(raw * 200), np.linalg.svd(x, compute_uv=False))
    with pytest.raises(ValueError):
        vectorspace.principal_axes(frame(spark, x).where("row < 0"))


def test_weighted_axes(spark, rng):
    x, w = rng.normal(size=(50, 3)), rng.random(50)
    df = frame(spark, x).join(spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "row bigint, omega double"), "row")
    mean, _, value = vectorspace.principal_axes(df, "h", "omega")
    assert np.allclose(mean, w @ x / w.sum())
    assert np.allclose(value.sum(), np.trace((x - mean).T @ ((x - mean) * w[:, None])) / w.sum())


@pytest.mark.parametrize("centre", [False, True])
def test_svd_embedding(spark, rng, centre):
    x = rng.normal(size=(30, 6)) + 1
    got, s, share = vectorspace.svd_embedding(frame(spark, x, "t", "v"), 3, 0.5, centre)
    e = np.array([r["e"] for r in got.orderBy("t").collect()])
    y = x - x.mean(0) if centre else x
    u, sv, _ = np.linalg.svd(y, full_matrices=False)
    assert np.allclose(s, sv[:3]) and np.isclose(share, (sv[:3] ** 2).sum() / (y * y).sum())
    assert np.allclose(e @ e.T, (u[:, :3] * sv[:3]) @ u[:, :3].T)
    with pytest.raises(ValueError):
        vectorspace.svd_embedding(frame(spark, x, "t", "v"), 7)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_nearest_tokens(spark, rng, metric):
    x = rng.normal(size=(60, 5))
    x[7] = x[3]
    df = frame(spark, x, "id", "e")
    got = vectorspace.nearest_tokens(df.where("id < 10"), df, 4, metric, block=3).orderBy("id", "rank").collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = u @ u.T if metric == "cosine" else -((x[:, None] - x) ** 2).sum(2)
    np.fill_diagonal(score, -np.inf)
    for i in range(10):
        order = np.lexsort((np.arange(60), -np.round(score[i], 9)))[:4]
        assert [r["other"] for r in got if r["id"] == i] == order.tolist()
    with pytest.raises(ValueError):
        vectorspace.nearest_tokens(df, df, 4, "manhattan")


def test_contrasts(toy):
    v = vectorspace.contrast(toy["unembedding"], 1, 2)
    assert np.allclose(v, toy["w"][1] - toy["w"][2])
    axes = vectorspace.contrast_axes(toy["unembedding"], [(0, 1), (2, 3), (0, 1)])
    assert len(axes) == 2
    on = vectorspace.on_axes(toy["states"], axes)
    assert on.count() == 240 and vectorspace.facets(on).count() == 240
    odds = {r["row"]: r["x"] for r in on.where("axis = '0-1'").collect()}
    assert np.isclose(odds[5], np.log(toy["p"][5, 0] / toy["p"][5, 1]))
    for bad in ((1, 1), (1, 99)):
        with pytest.raises(ValueError):
            vectorspace.contrast(toy["unembedding"], *bad)


def test_suggested_contrasts(toy):
    _, axes, value = vectorspace.principal_axes(toy["states"])
    got = vectorspace.suggest_contrasts(toy["unembedding"], axes[:, :2], value[:2], n=2).collect()
    best = max(((toy["w"][a] - toy["w"][b]) @ axes[:, 0] / np.linalg.norm(toy["w"][a] - toy["w"][b]), a, b) for a in range(8) for b in range(8) if a != b)
    top = [r for r in got if r["pc"] == 0 and r["rank"] == 1][0]
    assert top["score"] <= best[0] + 1e-9 and top["score"] > 0
    assert len(vectorspace.axes_of(vectorspace.suggest_contrasts(toy["unembedding"], axes[:, :2], value[:2]))) == 2
    with pytest.raises(ValueError):
        vectorspace.suggest_contrasts(toy["unembedding"], axes, value, only=[3])


def test_standardisation(spark):
    df = frame(spark, np.array([[1.0, 5.0], [3.0, 5.0]]))
    got = {r["j"]: (r["mean"], r["std"]) for r in vectorspace.standardisation(df).collect()}
    assert got == {0: (2.0, 1.0), 1: (5.0, 1.0)}


def kernel(points, w, at):
    w = w / w.sum()
    mean = w @ points
    c = (points - mean).T @ ((points - mean) * w[:, None]) / (1 - (w * w).sum())
    c = c * (1 / (w * w).sum()) ** (-1 / 3)
    d = at[:, None] - points
    q = np.einsum("ijk,kl,ijl->ij", d, np.linalg.inv(c), d)
    return (np.exp(-0.5 * q) / (2 * np.pi * np.sqrt(np.linalg.det(c)))) @ w


def test_kernel_density(spark, rng):
    x, w = rng.normal(size=(80, 2)), rng.random(80)
    df = spark.createDataFrame([("f", i, *map(float, (*p, v))) for i, (p, v) in enumerate(zip(x, w))], "facet string, row int, x double, y double, w double")
    got = density.kernel_density(df, ["facet"], 6).orderBy("gi", "gj").collect()
    at = np.array([(r["x"], r["y"]) for r in got])
    assert len(got) == 36 and np.allclose([r["density"] for r in got], kernel(x, w, at))
    span = x[:, 0].max() - x[:, 0].min()
    assert np.isclose(at[:, 0].min(), x[:, 0].min() - 0.05 * span) and np.isclose(at[:, 0].max(), x[:, 0].max() + 0.05 * span)
    flat = density.log_ratio_density(df.withColumn("w", F.lit(2.0)), ["facet"], 5)
    assert all(abs(r["log_ratio"]) < 1e-9 for r in flat.collect())
    clipped = density.log_ratio_density(df, ["facet"], 5, clip=0.01).collect()
    assert max(abs(r["log_ratio"]) for r in clipped) <= 0.01
    scaled = density.scaled_density(df.withColumn("token", F.lit(1)), ["facet"], "token", 5)
    assert np.isclose(scaled.agg(F.max("density")).first()[0], 1)
    assert density.bands(scaled, [0.5]).agg(F.max("band")).first()[0] == 1


def planted(spark, n=150, seed=1):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(2, 0.3, (n, 3)), r.normal(-2, 0.3, (2 * n, 3))])
    return x, spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in enumerate(x)], "row bigint, x array<double>, w double").repartition(3)


def test_mixture_recovers_planted_modes(spark):
    x, rows = planted(spark)
    m = mixtures.fit_mixture(rows, k=2, tries=1).sorted()
    assert np.allclose(m.pi, [2 / 3, 1 / 3], atol=0.02)
    assert np.allclose(m.means[0], -2, atol=0.15) and np.allclose(m.means[1], 2, atol=0.15)
    r = m.responsibilities(x)
    assert (r[:150, 1] > 0.99).all() and (r[150:, 0] > 0.99).all()


def test_number_of_components_by_bic(spark):
    _, rows = planted(spark, 60)
    assert len(mixtures.fit_mixture(rows, most=3, tries=1, iterations=30).pi) == 2


def test_normalised_weights_make_bic_scale_free(spark):
    _, rows = planted(spark, 30)
    a = mixtures.fit_mixture(rows, k=1, normalise=True)
    b = mixtures.fit_mixture(rows.withColumn("w", F.lit(7.0)), k=1, normalise=True)
    c = mixtures.fit_mixture(rows.withColumn("w", F.lit(7.0)), k=1)
    assert np.isclose(a.bic, b.bic) and not np.isclose(a.bic, c.bic) and np.isclose(a.ess, 90)


def test_bad_weights_raise(spark):
    _, rows = planted(spark, 5)
    for value in (F.lit(0.0), F.when(F.col("row") == 0, -1.0).otherwise(1.0), F.lit(float("nan"))):
        with pytest.raises(ValueError):
            mixtures.fit_mixture(rows.withColumn("w", value), k=1)


def test_senses(spark, toy):
    z = moments.marginal_vector(toy["states"], toy["unembedding"])
    omega = distinctiveness.token_weights(distinctiveness.with_log_partition(toy["states"], toy["unembedding"]), toy["unembedding"], 0, float(z[0]))
    lift = moments.unembedding_coordinates(moments.Model.of(toy["unembedding"]))
    senses, shares = mixtures.fit_senses(toy["states"].join(omega, "row"), 0, lift, k=2, tries=1)
    assert np.isclose(senses.mixture.pi.sum(), 1) and senses.mixture.pi[0] >= senses.mixture.pi[1]
    assert senses.means_y.shape == (2, 7) and np.allclose(senses.means_y, senses.means_h @ lift.T)
    total = shares.groupBy("row").agg(F.sum("r").alias("s")).collect()
    assert len(total) == 120 and all(np.isclose(r["s"], 1) for r in total)
    split = mixtures.variance_split(senses)
    m = senses.mixture
    centre = m.pi @ m.means
    whole = sum(p * (np.trace(c) + ((mu - centre) ** 2).sum()) for p, c, mu in zip(m.pi, m.covariances, m.means))
    assert np.isclose(split["total"], whole) and np.isclose(split["within_share"] + split["between_share"], 1)
    y = mixtures.variance_split(senses, in_y=True)
    assert np.isclose(y["within"], sum(p * np.trace(senses.axes_y @ c @ senses.axes_y.T) for p, c in zip(m.pi, m.covariances)))
    for way in ("weighted_responsibility", "responsibility", "distance"):
        best = mixtures.sense_examples(shares, senses, 3, way).collect()
        assert len(best) == 6 and {r["rank"] for r in best} == {1, 2, 3}
    with pytest.raises(ValueError):
        mixtures.sense_examples(shares, senses, 3, "beauty")
    assert mixtures.sense_table(senses, toy["states"]).count() == 2


def test_fit_space():
    assert mixtures.reduced_dimension(16, 5) == 16 and mixtures.reduced_dimension(64, 5) == 2
    assert mixtures.reduced_dimension(64, 120) == 12 and mixtures.reduced_dimension(64, 1e6) == 20


def test_density_model(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 2)) * [3, 0.5] + [1, -1]
    model = density.DensityModel.fit(frame(spark, x), k=1)
    c = np.cov(x.T, bias=True)
    d = x[:5] - x.mean(0)
    want = -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.log(np.linalg.det(c)) - np.log(2 * np.pi)
    got = [v[0] for v in frame(spark, x).select(model.log_density("h"), "row").where("row < 5").orderBy("row").collect()]
    assert np.allclose(got, want, atol=1e-3)
    again = density.DensityModel.of(model.table(spark))
    assert np.allclose(again.mixture.covariances, model.mixture.covariances)
    drawn = np.array([v["h"] for v in model.sample(spark, 2000).collect()])
    assert np.allclose(drawn.mean(0), x.mean(0), atol=0.3) and np.allclose(drawn.std(0), x.std(0), rtol=0.15)


def test_variance_by_label(spark, rng):
    x = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(x)], "row bigint, h array<double>, label int")
    r = mixtures.variance_by_label(df).first()
    within = sum(x[k::4].var(0).sum() / 4 for k in range(4))
    assert np.isclose(r["within_var"], within) and np.isclose(r["total_var"], x.var(0).sum())


@pytest.mark.parametrize("centre", [False, True])
def test_wide_rows_take_the_range_finder(spark, rng, monkeypatch, centre):
    """Singular vectors without a Gram matrix are those with one."""
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 40)) * 3 + rng.normal(size=(60, 40)) * 0.05 + 1.0
    df = frame(spark, x, "t", "v")
    exact = vectorspace.right_vectors(df, "v", 5, centre)
    monkeypatch.setattr(vectorspace, "GRAM_WIDTH", 8)
    found = vectorspace.right_vectors(df, "v", 5, centre)
    assert np.allclose(found[0], exact[0]) and np.allclose(found[1], exact[1], atol=1e-6) and np.isclose(found[3], exact[3]) and found[4] == 60
    embedded, s, share = vectorspace.svd_embedding(df, 5, 1.0, centre)
    held = x - x.mean(0) if centre else x
    e = np.array([r["e"] for r in embedded.orderBy("t").collect()])
    u, values, _ = np.linalg.svd(held, full_matrices=False)
    assert np.allclose(s, values[:5]) and np.isclose(share, (values[:5] ** 2).sum() / (values**2).sum())
    assert np.allclose(e @ e.T, (u[:, :5] * values[:5] ** 2) @ u[:, :5].T, atol=1e-4)


def test_projection_keeps_nulls_and_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, None, None), (3, [0.0, 1.0], "c")], "row int, h array<double>, proj string")
    got = vectorspace.project(df, np.array([[1.0], [2.0]]), np.array([1.0, 0.0])).orderBy("row").collect()
    assert [(r["row"], r["h"], r["proj"]) for r in got] == [(1, [1.0, 2.0], [4.0]), (2, None, None), (3, [0.0, 1.0], [1.0])]


def test_many_queries_take_several_passes(spark, rng, monkeypatch):
    x = rng.normal(size=(50, 4))
    df = frame(spark, x, "id", "e")
    want = {tuple(r) for r in vectorspace.nearest_tokens(df, df, 3).select("id", "other", "rank").collect()}
    monkeypatch.setattr(vectorspace, "QUERY_BYTES", 1000)
    assert {tuple(r) for r in vectorspace.nearest_tokens(df, df, 3).select("id", "other", "rank").collect()} == want and len(want) == 150


def test_factor_of_any_covariance(rng):
    a = rng.normal(size=(4, 4))
    good = a @ a.T
    lower = mixtures.factor(good, 1e-6)
    assert np.allclose(lower, np.linalg.cholesky(good + 1e-6 * np.eye(4))) and np.allclose(np.triu(lower, 1), 0)
    flat = np.outer(a[0], a[0]) - 0.1 * np.outer(a[1], a[1])  # not even semidefinite
    lower = mixtures.factor(flat, 1e-3)
    assert np.linalg.eigvalsh(lower @ lower.T)[0] > 5e-4
    with pytest.raises(np.linalg.LinAlgError):
        mixtures.factor(np.full((2, 2), np.nan), 1e-6)
