import numpy as np
import pytest
from pyspark.sql import functions as F

from glosswork import __main__ as command
from glosswork.operators import distinctiveness, embeddings, moments, vectorspace, views
from glosswork.sources import arrays


@pytest.fixture(scope="module")
def sample(toy):
    return distinctiveness.with_log_partition(toy["states"], toy["unembedding"]).persist()


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([(t, f"w{t}") for t in range(8)] + [(8, "w0"), (9, None)], "token int, str string")


def test_embedding_end_to_end(toy):
    made = embeddings.embed(toy["states"], toy["unembedding"], 3)
    m = toy["p"].T @ toy["p"] / 120
    z = toy["p"].mean(0)
    from glosswork.functions.geometry import ilr_matrix

    y = ilr_matrix((np.log(m) - np.log(z)[:, None] - np.log(z)).T).T
    u, s, _ = np.linalg.svd(y, full_matrices=False)
    e = np.array([r["e"] for r in made.vectors.orderBy("token").collect()])
    assert np.allclose(made.values, s[:3]) and np.allclose(e @ e.T, (u[:, :3] * s[:3]) @ u[:, :3].T)
    plain = embeddings.embed(toy["states"], toy["unembedding"], 2, log_ratio=False, targets=[1, 4, 6], centre=True)
    assert [r["token"] for r in plain.vectors.orderBy("token").collect()] == [1, 4, 6]
    with pytest.raises(NotImplementedError):
        embeddings.embed(toy["states"], toy["unembedding"], 2, targets=[1, 2, 3])


def test_tokens_by_name(vocab):
    assert embeddings.resolve_tokens(vocab, ["w3", 5, "w0"]) == [3, 5, 0] and embeddings.resolve_tokens(vocab, "w7") == [7]
    for bad in ("nope", 77, ["w1", "zz"]):
        with pytest.raises(ValueError):
            embeddings.resolve_tokens(vocab, bad)


def test_neighbours_by_name(spark, vocab, toy):
    made = embeddings.embed(toy["states"], toy["unembedding"], 4).vectors
    got = embeddings.neighbours_of(made, vocab, ["w2"], 3).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3] and all(r["word"] == "w2" and r["neighbour"] != "w2" for r in got)


@pytest.mark.parametrize("bound", [64 << 20, 64])
def test_decoding(spark, vocab, monkeypatch, bound):
    monkeypatch.setattr(embeddings, "BROADCAST_BYTES", bound)
    rows = spark.createDataFrame([(1, [1, 2, 1]), (2, []), (3, None), (1, [1, 2, 1]), (4, [9, 99, 3])], "k int, ids array<int>")
    got = [(r["k"], r["text"]) for r in embeddings.decode(rows, vocab, separator="-").collect()]
    assert sorted(got) == [(1, "w1-w2-w1"), (1, "w1-w2-w1"), (2, ""), (3, ""), (4, "w3")]


def test_bases(sample, toy):
    w = toy["unembedding"]
    whole = embeddings.coordinates(sample, w, "global", pcs=(0, 1))
    _, axes, _ = vectorspace.principal_axes(toy["states"], centred=False)
    x = {(r["row"], r["axis"]): r["x"] for r in whole.collect()}
    assert np.isclose(x[7, "pc1"], toy["h"][7] @ axes[:, 0]) and len(x) == 240
    z = float(moments.marginal_vector(toy["states"], w)[1])
    of_token = embeddings.coordinates(sample, w, "token", 1, z, (0, 1))
    omega = toy["p"][:, 1] / z
    pc1 = np.array([r["x"] for r in of_token.where("axis = 'pc1'").orderBy("row").collect()])
    assert abs(omega @ pc1) < 1e-6
    for bad in ({"basis": "moon"}, {"basis": "contrast", "contrasts": [(0, 1)]}, {"basis": "token"}, {"basis": "global", "pcs": (0, 0)}, {"basis": "global", "pcs": (0, 9)}):
        with pytest.raises(ValueError):
            embeddings.coordinates(sample, w, **bad)


def test_grids(sample, toy):
    w, z = toy["unembedding"], moments.marginal_vector(toy["states"], toy["unembedding"])
    basis = {"basis": "contrast", "contrasts": [(0, 1), (2, 3), (4, 5)]}
    assert views.density_view(sample, w, n=5, **basis).count() == 6 * 25
    two = views.density_view(sample, w, {0: float(z[0]), 1: float(z[1])}, n=5, basis="global", pcs=(0, 1))
    top = two.groupBy("x_label", "y_label", "token").agg(F.max("density").alias("m")).collect()
    assert len(top) == 4 and all(np.isclose(r["m"], 1) for r in top)
    ratio = views.distinctiveness_view(sample, w, 0, float(z[0]), n=5, clip=1.0, **basis)
    assert ratio.agg(F.max(F.abs("log_ratio"))).first()[0] <= 1


def test_instances_and_empirical_view(spark, sample, toy, vocab):
    places = sample.select("row", F.lit(1).cast("bigint").alias("doc_id"), F.col("row").alias("pos"))
    tokens = spark.createDataFrame([(1, p, p % 8) for p in range(121)], "doc_id bigint, pos bigint, token int")
    basis = {"basis": "global", "pcs": (0, 1)}
    got = views.instances(sample, toy["unembedding"], places, tokens, vocab, 5, followed_by=3, context=3, **basis).collect()
    assert len(got) == 5 and all(r["label"] == "w1 w2 w3" or r["pos"] < 2 for r in got) and set(got[0]["axes"]) == {"pc1", "pc2"}
    seen = views.empirical_view(sample, toy["unembedding"], places, tokens, [3, 5], n=4, **basis)
    assert seen.count() == 2 * 2 * 16
    with pytest.raises(ValueError):
        views.instances(sample, toy["unembedding"], places.where("row > 5"), tokens, vocab, 5, **basis)
    states = sample.join(places, "row")
    mean = views.phrases(tokens, states, vocab, ["w1 w2"], most=3).orderBy("j").collect()
    assert np.allclose([r["x"] for r in mean], toy["h"][[1, 9, 17]].mean(0))


def test_commands(spark, tmp_path, toy, vocab):
    at = {k: str(tmp_path / k) for k in ("states", "line", "w", "vocab", "z", "e", "density", "scores", "pairs")}
    toy["states"].write.parquet(at["states"])
    toy["states"].select(F.lit(0).cast("bigint").alias("doc_id"), F.col("row").alias("pos"), F.col("h").alias("v")).write.parquet(at["line"])
    toy["unembedding"].write.parquet(at["w"])
    vocab.where("token < 8").write.parquet(at["vocab"])
    (tmp_path / "p.csv").write_text("word1,word2,similarity\nw0,w1,1\nw2,w3,2\nw4,w5,3\nw6,zz,4\n")
    command.run(spark, ["marginals", at["states"], at["w"], at["z"]])
    assert np.isclose(spark.read.parquet(at["z"]).agg(F.sum("z")).first()[0], 1)
    command.run(spark, ["embeddings", at["states"], at["w"], at["e"], "-k", "3", "--z-from", at["z"]])
    assert spark.read.parquet(at["e"]).count() == 8
    command.run(spark, ["embeddings", at["states"], at["w"], str(tmp_path / "e.npz"), "-k", "2", "--top-tokens", "4"])
    assert arrays.embedding_archive(spark, str(tmp_path / "e.npz")).count() == 4
    command.run(spark, ["similarity", str(tmp_path / "p.csv"), at["states"], at["w"], at["vocab"], at["pairs"], "--quantities", "kl"])
    done = {r["word2"]: r["kl"] for r in spark.read.csv(at["pairs"], header=True).collect()}
    assert done["zz"] is None and float(done["w1"]) == float(done["w1"])
    command.run(spark, ["benchmarks", at["e"], at["vocab"], at["scores"], "--files", f"rg65={tmp_path / 'p.csv'}"])
    assert spark.read.csv(at["scores"], header=True).first()["benchmark_size"] == "3"
    command.run(spark, ["density", at["states"], at["density"], "--components", "1"])
    assert spark.read.parquet(at["density"]).count() == 1
    command.run(spark, ["extract", at["line"], at["w"], str(tmp_path / "x"), "--window", "1", "--weights", "harmonic", "--project-degenerate", "--save-subsample", "5"])
    assert spark.read.parquet(str(tmp_path / "x" / "sample_sub.parquet")).count() == 5
    with pytest.raises(SystemExit):
        command.run(spark, ["fly"])


def test_vector_files(spark, tmp_path):
    z = spark.createDataFrame([(1, 0.75), (0, 0.25)], "token int, z double")
    arrays.save_vector_file(z, str(tmp_path / "z.npy"))
    assert np.load(tmp_path / "z.npy").tolist() == [0.25, 0.75]
