import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosswork.functions import windowing
from glosswork.operators import moments, pairs, similarity
from glosswork.sources import arrays, benchmarks, samples
from glosswork.streaming import sums


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_pairs_csv_headers(spark, tmp_path):
    p = write(tmp_path / "a.csv", "Word_1, word2 ,Score\nCat,DOG,3.5\nsun,,1\n")
    assert rows(benchmarks.load(spark, "rg65", p)) == [("rg65", "cat", "dog", 3.5)]
    w = write(tmp_path / "w.csv", "Word 1,Word 2,Human (Mean)\nLove,Sex,6.77\n")
    assert rows(benchmarks.load(spark, "ws353", w)) == [("ws353", "love", "sex", 6.77)]


@pytest.mark.parametrize("as_list", [False, True])
def test_association_json(spark, tmp_path, as_list):
    data = {"CAT": {"dog": 3, "hot dog": 1}, "bad": "x", "none": {}, "zero": {"a": 0}}
    p = write(tmp_path / "e.json", json.dumps([{k: v} for k, v in data.items()] if as_list else data))
    assert rows(benchmarks.load(spark, "eat", p)) == [("eat", "cat", "dog", 0.75)]


def test_norms_and_priming(spark, tmp_path):
    s = write(tmp_path / "s.csv", "cue;response;R1;R1.Strength\na;b;2;0.5\na;two words;2;0.5\na;c;0;0.1\nb;;3;0.2\n")
    assert rows(benchmarks.load(spark, "swow", s)) == [("swow", "a", "b", 0.5)]
    u = write(tmp_path / "u.tsv", "cues\ttargets\tforward strength\nA\tB\t0.25\n")
    assert rows(benchmarks.load(spark, "usf", u)) == [("usf", "a", "b", 0.25)]
    m = write(tmp_path / "m.csv", "cue_word,target_word,target_Z_RT,keep_target,keep_participant\nA,b,1.0,keep,keep\nA,b,2.0,keep,keep\nA,b,9,exclude,keep\n")
    assert rows(benchmarks.load(spark, "spaml", m)) == [("spaml", "A", "b", -1.5)]
    q = write(tmp_path / "q.csv", "prime,target,target.rt,keep\nA,B,500,1\nA,B,700,1\nA,B,10,0\n")
    assert rows(benchmarks.load(spark, "spp", q)) == [("spp", "a", "B", -600.0)]


def test_loading_many(spark, tmp_path):
    good = write(tmp_path / "g.csv", "word1,word2,similarity\na,b,1\n")
    bad = write(tmp_path / "b.csv", "x,y\n1,2\n")
    assert rows(benchmarks.load_all(spark, {"mc30": good, "rw": bad})) == [("mc30", "a", "b", 1.0)]
    for name, path in (("nothing", good), ("swow", None)):
        with pytest.raises(ValueError):
            benchmarks.load(spark, name, path)
    assert pairs.benchmark_table(spark).count() == 15


def test_lookup_order(spark):
    vocab = spark.createDataFrame([(0, "cat"), (1, " cat"), (2, " dog"), (3, "sun"), (4, " moon"), (5, None)], "token int, str string")
    words = spark.createDataFrame([("cat",), ("dog",), ("Sun",), ("MOON",), ("zzz",), (None,)], "word string")
    got = {r["word"]: r["token"] for r in pairs.resolve(words, vocab).collect()}
    assert got == {"cat": 0, "dog": 2, "Sun": 3, "MOON": 4}
    exact = pairs.with_tokens(spark.createDataFrame([("cat", "Sun", 1)], "word1 string, word2 string, x int"), vocab).first()
    assert exact["t1"] == 0 and exact["t2"] is None and exact["x"] == 1
    assert tuple(pairs.coverage(pairs.with_tokens(spark.createDataFrame([("cat", "Sun"), ("cat", "sun")], "word1 string, word2 string"), vocab)).first()) == (2, 1, 1)


def test_spearman(spark, rng):
    e = rng.normal(size=(20, 4))
    vocab = spark.createDataFrame([(i, f"w{i}") for i in range(20)], "token int, str string")
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "token int, e array<float>")
    u = e / np.linalg.norm(e, axis=1, keepdims=True)
    bench = spark.createDataFrame([("b", f"w{i}", f"w{i + 10}", float(u[i] @ u[i + 10])) for i in range(10)] + [("b", "w0", "oov", 1.0), ("c", "w0", "oov", 1.0)], "name string, word1 string, word2 string, similarity double")
    got = {r["name"]: r for r in pairs.run_benchmarks(bench, vectors, vocab).collect()}
    assert np.isclose(got["b"]["spearman_r"], 1) and got["b"]["n_pairs"] == 11 and got["b"]["benchmark_size"] == 10
    assert got["c"]["spearman_r"] is None and got["c"]["benchmark_size"] == 0
    with pytest.raises(ValueError):
        pairs.run_benchmarks(bench, vectors, vocab, "jaccard")


def test_ties_share_their_rank(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 3.0)], "name string, v double")
    assert sorted(r["r"] for r in pairs.mean_ranks(df, ["name"], "v", "r").collect()) == [1.0, 2.5, 2.5, 4.0]


def test_token_stream(spark, tmp_path, rng):
    data = rng.integers(0, 60000, 1000).astype(np.uint16)
    data.tofile(tmp_path / "t.bin")
    arrays.register(spark)
    df = spark.read.format("token_stream").option("split", 300).load(str(tmp_path / "t.bin"))
    assert df.rdd.getNumPartitions() == 4
    assert [r["token"] for r in df.orderBy("pos").collect()] == data.tolist()
    (tmp_path / "empty.bin").write_bytes(b"")
    assert arrays.token_stream(spark, str(tmp_path / "empty.bin")).count() == 0


def test_matrices(spark, tmp_path, rng):
    x = rng.normal(size=(50, 3)).astype(np.float16)
    np.save(tmp_path / "x.npy", x)
    got = np.array([r["v"] for r in arrays.matrix(spark, str(tmp_path / "x.npy")).orderBy("row").collect()])
    assert np.array_equal(got, x.astype(np.float32))
    np.save(tmp_path / "z.npy", np.array([0.25, 0.75]))
    assert rows(arrays.vector_file(spark, str(tmp_path / "z.npy"))) == [(0, 0.25), (1, 0.75)]
    vectors = spark.createDataFrame([(1, [3.0, 4.0]), (0, [1.0, 2.0])], "token int, e array<float>")
    arrays.save_embedding_archive(vectors, str(tmp_path / "e.npz"), k=2)
    assert rows(arrays.embedding_archive(spark, str(tmp_path / "e.npz")).selectExpr("token", "e[0]", "e[1]")) == [(0, 1.0, 2.0), (1, 3.0, 4.0)]


def test_sample_kinds(spark):
    h = spark.createDataFrame([([1.0, 2.0],)], "h array<double>")
    assert samples.sample_kind(h, 2, 5) == "h" and samples.sample_kind(h, 3, 2) == "probs" and samples.sample_kind(h, 2, 2) == "h"
    with pytest.raises(ValueError):
        samples.sample_kind(h, 3, 4)
    good = spark.createDataFrame([([0.25, 0.75],)], "p array<double>")
    assert samples.checked_distributions(good).count() == 1
    with pytest.raises(Exception):
        samples.checked_distributions(spark.createDataFrame([([0.5, 0.9],)], "p array<double>")).collect()


def test_extraction(spark, tmp_path, toy):
    line = toy["states"].select(F.lit(0).cast("bigint").alias("doc_id"), F.col("row").alias("pos"), F.col("h").alias("v"))
    meta = samples.extract(line, toy["unembedding"], windowing.offsets(spark, 1), str(tmp_path), "x", least=3, subsample=10)
    assert meta.n_valid == 116 and meta.min_context == 3 and (meta.d, meta.v) == (4, 8)
    again = samples.read_meta(spark, str(tmp_path / "x_meta"))
    assert again.offsets == [[-1, 1.0], [0, 1.0], [1, 1.0]] and again.kind == "h"
    path = samples.locate(spark, str(tmp_path), "x")
    got = {r["pos"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert set(got) == set(range(3, 119)) and np.allclose(got[7], toy["h"][6:9].mean(0))
    z = spark.read.parquet(str(tmp_path / "x_Z.parquet"))
    assert np.isclose(z.agg(F.sum("z")).first()[0], 1)
    assert spark.read.parquet(str(tmp_path / "x_sub.parquet")).count() == 10
    with pytest.raises(FileNotFoundError):
        samples.locate(spark, str(tmp_path), "y")


def test_projected_extraction(spark, tmp_path, toy):
    line = toy["states"].select(F.lit(0).cast("bigint").alias("doc_id"), F.col("row").alias("pos"), F.col("h").alias("v"))
    v = np.array([1.0, 0, 0, 0])
    samples.extract(line, toy["unembedding"], windowing.offsets(spark, 0), str(tmp_path), "p", direction=v)
    assert all(abs(r["v"][0]) < 1e-12 for r in spark.read.parquet(samples.locate(spark, str(tmp_path), "p")).collect())


def test_averages_of_states_and_distributions_differ(spark, toy):
    line = toy["states"].select(F.lit(0).cast("bigint").alias("doc_id"), F.col("row").alias("pos"), F.col("h").alias("v"))
    off = windowing.offsets(spark, 1)
    p = samples.probability_scan(toy["states"], toy["unembedding"]).select(F.lit(0).cast("bigint").alias("doc_id"), F.col("row").alias("pos"), F.col("p").alias("v"))
    mean_p = {r["pos"]: np.array(r["v"]) for r in samples.window_states(p, off, "probability").collect()}
    assert np.allclose(mean_p[60], toy["p"][59:62].mean(0))
    h = {r["pos"]: np.array(r["v"]) for r in samples.window_states(line, off).collect()}
    logits = toy["w"] @ h[60]
    geometric = np.exp(logits) / np.exp(logits).sum()
    assert np.abs(geometric - mean_p[60]).max() > 1e-3
    with pytest.raises(ValueError):
        samples.window_states(line, off, "harmonic")


def test_working_sample(spark, tmp_path, toy):
    kept = samples.working_sample(toy["states"], toy["unembedding"], 50, axes=2, path=str(tmp_path / "w"))
    assert kept.count() == 50 and kept.columns == ["row_index", "h", "log_z", "proj"]
    r = samples.load_working_sample(spark, str(tmp_path / "w")).first()
    assert np.isclose(r["log_z"], np.log(np.exp(toy["w"] @ np.array(r["h"])).sum())) and len(r["proj"]) == 2


def test_pair_files(spark, tmp_path):
    with gzip.open(tmp_path / "p.csv.gz", "wt") as f:
        f.write("word1,word2,note\na,b,x\n")
    df = samples.pairs_in(spark, str(tmp_path / "p.csv.gz"))
    assert rows(df) == [("a", "b", "x")]
    samples.pairs_out(df, str(tmp_path / "out"), "gzip")
    assert rows(samples.pairs_in(spark, str(tmp_path / "out"))) == [("a", "b", "x")]
    with pytest.raises(ValueError):
        samples.pairs_in(spark, write(tmp_path / "n.csv", "a,b\n1,2\n"))


def test_stream_of_states_adds_up(spark, tmp_path, toy):
    for k, part in enumerate(("row < 50", "row >= 50")):
        toy["states"].where(part).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    raw = spark.readStream.schema("row bigint, h array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    for _ in range(2):  # a second run has nothing left to add
        sums.accumulate(raw, toy["w"], str(tmp_path / "sums"), str(tmp_path / "check")).awaitTermination()
    got = sums.current(spark, str(tmp_path / "sums"))
    z = {r["j"]: r["value"] for r in got.where("stat = 'z'").collect()}
    assert np.allclose([z[t] for t in range(8)], toy["p"].sum(0))
    assert moments.marginals(toy["states"], toy["unembedding"]).count() == 8


def test_stream_counts(spark, tmp_path):
    rows_in = [(1, 0, 5, "2031-01-01 00:00:00"), (1, 0, 5, "2031-01-01 00:00:00"), (1, 1, 6, "2031-01-01 00:01:00")]
    spark.createDataFrame(rows_in, "doc_id bigint, pos bigint, token int, at string").select("doc_id", "pos", "token", F.to_timestamp("at").alias("loaded_at")).write.parquet(str(tmp_path / "c"))
    raw = spark.readStream.schema("doc_id bigint, pos bigint, token int, loaded_at timestamp").parquet(str(tmp_path / "c"))
    q = sums.token_counts(raw).writeStream.outputMode("complete").format("memory").queryName("gw_counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("gw_counts")) == [(5, 1), (6, 1)]
    w = sums.windowed_counts(raw).writeStream.outputMode("complete").format("memory").queryName("gw_windows").trigger(availableNow=True).start()
    w.awaitTermination()
    assert spark.table("gw_windows").first()["n"] == 3


def test_odd_rows_are_reported(spark, tmp_path, caplog):
    path = write(tmp_path / "odd.csv", "word1,word2,similarity\na,b,1\nc,d,2,9,9\ne,f,3\n")
    with caplog.at_level("WARNING"):
        got = benchmarks.pairs_csv(spark, path)
    assert rows(got) == [("a", "b", 1.0), ("e", "f", 3.0)] and "1 rows do not fit" in caplog.text


def test_extraction_without_states(spark, tmp_path, toy):
    line = toy["states"].select(F.lit(0).cast("bigint").alias("doc_id"), F.col("row").alias("pos"), F.col("h").alias("v"))
    samples.extract(line, toy["unembedding"], windowing.offsets(spark, 1), str(tmp_path), "kept")
    meta = samples.extract(line, toy["unembedding"], windowing.offsets(spark, 1), str(tmp_path), "bare", save_states=False, subsample=10)
    z = [{r["token"]: r["z"] for r in spark.read.parquet(f"{tmp_path}/{n}_Z.parquet").collect()} for n in ("kept", "bare")]
    assert all(np.isclose(z[0][t], z[1][t]) for t in range(8)) and meta.n_valid == 118
    assert spark.read.parquet(f"{tmp_path}/bare_sub.parquet").count() == 10
    with pytest.raises(FileNotFoundError):
        samples.locate(spark, str(tmp_path), "bare")


def test_live_pairs_are_those_of_a_stored_sample(spark, tmp_path, toy):
    line = toy["states"].select(F.lit(0).cast("bigint").alias("doc_id"), F.col("row").alias("pos"), F.col("h").alias("v"))
    pairs_of = spark.createDataFrame([(0, 1), (2, 5)], "t1 int, t2 int")
    off = windowing.offsets(spark, 1)
    samples.extract(line, toy["unembedding"], off, str(tmp_path), "s")
    stored = spark.read.parquet(samples.locate(spark, str(tmp_path), "s")).select(F.col("v").alias("h"))
    live = samples.window_pair_similarities(pairs_of, line, toy["unembedding"], off)
    for a, b in zip(live.orderBy("t1").collect(), similarity.pair_similarities(pairs_of, stored, toy["unembedding"]).orderBy("t1").collect()):
        assert np.allclose(a[2:], b[2:])


def test_windows_and_sessions_of_a_stream(spark, tmp_path):
    at = ["2031-01-01 00:00:00", "2031-01-01 00:10:00", "2031-01-01 02:00:00"]
    spark.createDataFrame([(1, k, 5, t) for k, t in enumerate(at)], "doc_id bigint, pos bigint, token int, at string").select("doc_id", "pos", "token", F.to_timestamp("at").alias("loaded_at")).write.parquet(str(tmp_path / "c"))
    raw = spark.readStream.schema("doc_id bigint, pos bigint, token int, loaded_at timestamp").parquet(str(tmp_path / "c"))
    sums.upsert(sums.windowed_counts(raw, "1 hour"), str(tmp_path / "w"), str(tmp_path / "wc")).awaitTermination()
    assert sorted(r["n"] for r in sums.newest(spark, str(tmp_path / "w"), "window_start").collect()) == [1, 2]
    sums.upsert(sums.windowed_counts(raw, "1 hour", slide="30 minutes"), str(tmp_path / "s"), str(tmp_path / "sc")).awaitTermination()
    assert sorted(r["n"] for r in sums.newest(spark, str(tmp_path / "s"), "window_start").collect()) == [1, 1, 2, 2]
    sessions = sums.session_counts(raw).writeStream.outputMode("append").format("memory").queryName("gw_sessions").trigger(availableNow=True).start()
    sessions.awaitTermination()
    assert [r["n"] for r in spark.table("gw_sessions").collect()] in ([2], [2, 1])
