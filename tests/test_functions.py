import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glosswork.functions import geometry, register, schedule, vectors, windowing


def dense_basis(v):
    out = np.zeros((v - 1, v))
    for i in range(1, v):
        out[i - 1, :i] = np.sqrt(1 / (i * (i + 1)))
        out[i - 1, i] = -np.sqrt(i / (i + 1))
    return out


@given(st.integers(2, 40), st.integers(0, 1000))
@settings(max_examples=25, deadline=None)
def test_running_sums_equal_the_dense_basis(v, seed):
    x = np.random.default_rng(seed).normal(size=(v, 3))
    assert np.allclose(geometry.ilr_matrix(x), dense_basis(v) @ x)


def test_basis_is_orthonormal_and_kills_constants(spark, as_matrix):
    b = as_matrix(geometry.basis_table(spark, 9).selectExpr("i - 1 i", "j - 1 j", "x"), "i", "j", "x")
    assert np.allclose(b @ b.T, np.eye(8)) and np.allclose(b @ np.ones(9), 0)
    assert np.allclose(b, dense_basis(9))


def test_coordinates_and_adjoint(spark, rng, as_matrix):
    x = rng.normal(size=(3, 7))
    long = spark.createDataFrame([(g, j, float(x[g, j])) for g in range(3) for j in range(7)], "g int, j int, x double")
    y = geometry.ilr_apply(long, ["g"], "j", "x")
    assert np.allclose(as_matrix(y.selectExpr("g", "i - 1 i", "y"), "g", "i", "y"), x @ dense_basis(7).T)
    back = as_matrix(geometry.ilr_adjoint(y, ["g"]).selectExpr("g", "i - 1 i", "x"), "g", "i", "x")
    assert np.allclose(back, x - x.mean(1, keepdims=True))


def test_three_parts_round_trip(spark):
    df = spark.createDataFrame([(0.2, 0.3, 0.5), (1.0, 1.0, 1.0), (0.9, 0.05, 0.05)], "a double, b double, c double")
    y = df.select("a", "b", "c", *(c.alias(n) for c, n in zip(geometry.three_parts(F.col("a"), F.col("b"), F.col("c")), ("y1", "y2"))))
    parts = geometry.three_parts_inverse(F.col("y1"), F.col("y2"))
    for r in y.select("a", "b", "c", *(p.alias(n) for p, n in zip(parts, "xyz"))).collect():
        total = r.a + r.b + r.c
        assert np.allclose([r.x, r.y, r.z], [r.a / total, r.b / total, r.c / total])
    assert geometry.gridlines(spark, 5, 4).count() == 3 * 4 * 4
    corner = df.select(*geometry.barycentric(F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()
    assert np.allclose(corner, (0.5, np.sqrt(3) / 2))


def offsets_of(spark, *args, **kwargs):
    return {r["o"]: round(r["wt"], 9) for r in windowing.offsets(spark, *args, **kwargs).collect()}


def test_offset_tables(spark):
    assert offsets_of(spark, 2, "linear") == {-1: 0.5, 0: 1.0, 1: 0.5}
    assert offsets_of(spark, 2, "harmonic", direction="forward", include_target=False) == {1: 1.0, 2: 0.5}
    assert offsets_of(spark, 1, "none", direction="backward") == {-1: 1.0, 0: 1.0}
    assert offsets_of(spark, 2, "exponential", alpha=0.5, direction="forward", tokens_per_minute=2.0)[2] == round(float(np.exp(-0.5)), 9)
    assert offsets_of(spark, 1, "linear") == {0: 1.0}
    with pytest.raises(ValueError):
        windowing.resolve(windowing.offsets(spark, 1, "linear", include_target=False))
    with pytest.raises(ValueError):
        windowing.offsets(spark, 2, "exponential", tokens_per_minute=0)
    with pytest.raises(ValueError):
        windowing.offsets(spark, 2, "cubic")


def test_window_extents(spark):
    w = windowing.resolve(windowing.offsets(spark, 3, "harmonic", direction="backward"))
    assert (w.forward, w.backward, w.trivial) == (0, 3, False)
    assert w.context(1) == 3 and w.context(5) == 5
    with pytest.raises(ValueError):
        w.context(4, block=4)


def test_vector_expressions(spark, rng):
    a, b = rng.normal(size=(2, 5))
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    r = df.select(vectors.cosine("a", "b").alias("c"), vectors.logsumexp("a").alias("l"), vectors.softmax("a").alias("s"), vectors.squared_distance("a", "b").alias("d"), vectors.norm("a").alias("n")).first()
    e = np.exp(a - a.max())
    assert np.isclose(r.c, a @ b / np.linalg.norm(a) / np.linalg.norm(b)) and np.isclose(r.l, np.log(np.exp(a).sum()))
    assert np.allclose(r.s, e / e.sum()) and np.isclose(r.d, ((a - b) ** 2).sum()) and np.isclose(r.n, np.linalg.norm(a))
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>").select(vectors.cosine("a", "b")).first()[0]
    assert zero is None


def test_schedule(spark):
    df = spark.range(0, 101, 50).select(F.col("id").alias("step"))
    rates = [r[0] for r in df.select(schedule.learning_rate(F.col("step"), 1.0, 0.1, 10, 90)).collect()]
    assert np.isclose(rates[0], 1 / 11) and np.isclose(rates[1], 0.55) and np.isclose(rates[2], 0.1)
    one = spark.range(1).select(schedule.flops_utilisation(*(F.lit(float(x)) for x in (1e8, 12, 12, 64, 1024, 480, 10)))).first()[0]
    assert np.isclose(one, (6e8 + 12 * 12 * 12 * 64 * 1024) * 1024 * 480 / 10 / 312e12)


def test_sql_functions(spark):
    register.register(spark)
    assert np.isclose(spark.sql("SELECT vector_cosine(array(1D, 0D), array(1D, 1D))").first()[0], 1 / np.sqrt(2))
    assert np.isclose(spark.sql("SELECT vector_logsumexp(array(0D, 0D))").first()[0], np.log(2))
    assert spark.sql("SELECT decay_weight(3D, 2D, 'none', 1D)").first()[0] == 0
    assert {r.o for r in spark.sql("SELECT * FROM context_window(2, 'linear', 1D, 'symmetric', false)").collect()} == {-1, 1}
    assert spark.sql("SELECT * FROM kde_grid(0D, 1D, 0D, 0D, 3)").count() == 9
    assert spark.sql("SELECT kish_ess(v) FROM VALUES (1D), (1D), (1D) t(v)").first()[0] == 3
    half = spark.sql("SELECT half_precision(array(0.1D))").first()[0][0]
    assert half == float(np.float16(0.1))
    density = spark.sql("SELECT gaussian_logpdf(array(0D), array(0D), array(1D))").first()[0]
    assert np.isclose(density, -0.5 * np.log(2 * np.pi))


def test_sql_functions_for_matrices(spark):
    register.register(spark)
    r = spark.sql("SELECT vector_ilr(array(1.0D, 3.0D, 2.0D)) AS y, vector_ilr(array(1.0D)) AS one, vector_matvec(array(array(1.0D, 2.0D), array(0.0D, 1.0D)), array(3.0D, 4.0D)) AS p").first()
    assert np.allclose(r["y"], [(1 - 3) / np.sqrt(2), (4 - 2 * 2) / np.sqrt(6)]) and r["one"] == [] and r["p"] == [11.0, 4.0]
    spark.createDataFrame([(1, [1.0, 2.0], 2.0), (1, [0.0, 1.0], 1.0), (1, None, 1.0), (2, None, 1.0)], "g int, v array<double>, w double").createOrReplaceTempView("gw_vectors")
    got = {r["g"]: r["m"] for r in spark.sql("SELECT g, weighted_gram(v, w) AS m FROM gw_vectors GROUP BY g").collect()}
    assert got == {1: [2.0, 4.0, 4.0, 9.0], 2: []}
    half = spark.sql("SELECT half_precision(v) AS v FROM gw_vectors").collect()
    assert sorted(map(str, (r["v"] for r in half))) == ["None", "None", "[0.0, 1.0]", "[1.0, 2.0]"]


def test_training_plan(spark):
    plan = schedule.training_plan(F.lit(1e8), 12 * 1024, 20.0, 1e8, 2)
    r = spark.range(1).select(*(c.alias(k) for k, c in plan.items())).first()
    batch = r["accumulation"] * 12 * 1024
    assert r["tokens"] == 2_000_000_000 and r["iterations"] == 2e8 // batch and np.isclose(r["epochs_run"], r["iterations"] * batch / 1e8)
    assert np.isclose(r["learning_rate"], 6e-4 * np.sqrt(batch / 524288)) and r["weight_decay"] <= 0.5 and 100 <= r["warmup"] <= 2000
