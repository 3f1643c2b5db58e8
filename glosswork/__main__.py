"""``python -m glosswork COMMAND``: the library's jobs over Parquet tables."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import windowing
from .functions.geometry import EPS
from .operators import embeddings, moments, pairs, similarity, vectorspace
from .operators.density import DensityModel
from .sources import arrays, benchmarks, samples


def _window(p: argparse.ArgumentParser) -> None:
    p.add_argument("--window", type=int, default=0)
    p.add_argument("--weights", choices=windowing.DECAYS, default="none")
    p.add_argument("--alpha", type=float, default=1.0)
    p.add_argument("--direction", choices=windowing.DIRECTIONS, default="symmetric")
    p.add_argument("--no-include-target", action="store_true")
    p.add_argument("--tokens-per-minute", type=float)


def _offsets(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return windowing.offsets(spark, a.window, a.weights, a.alpha, a.direction, not a.no_include_target, a.tokens_per_minute)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="glosswork")
    sub = top.add_subparsers(dest="command", required=True)

    p = sub.add_parser("extract", help="average states over windows; write states, marginals and metadata")
    p.add_argument("states", help="Parquet of doc_id, pos, v")
    p.add_argument("unembedding", help="Parquet of token, w")
    p.add_argument("folder")
    p.add_argument("--name", default="sample")
    p.add_argument("--averaging", choices=("aitchison", "probability"), default="aitchison")
    p.add_argument("--project-degenerate", action="store_true")
    p.add_argument("--min-context", type=int, default=0)
    p.add_argument("--save-subsample", type=int)
    p.add_argument("--no-save-states", action="store_true", help="write marginals, subsample and metadata only")
    _window(p)

    p = sub.add_parser("embeddings", help="static embeddings of the tokens")
    p.add_argument("states", help="Parquet of row, h")
    p.add_argument("unembedding")
    p.add_argument("out", help="Parquet folder, or a file ending in .npz")
    p.add_argument("-k", type=int, default=300)
    p.add_argument("--eig-weight", type=float, default=0.5)
    p.add_argument("--no-ilr", action="store_true")
    p.add_argument("--center", action="store_true")
    p.add_argument("--top-tokens", type=int, help="only the most probable tokens as rows; log-ratio coordinates are then left out")
    p.add_argument("--target-tokens-file", help="text file of token ids, one a line, as rows")
    p.add_argument("--eps", type=float, default=EPS, help="floor of probabilities in logarithms")
    p.add_argument("--neighbors-for", type=int, nargs="+", default=[], help="tokens whose ten nearest are printed")
    p.add_argument("--z-from", help="Parquet of token, z, or a .npy file")

    p = sub.add_parser("similarity", help="enrich word pairs with directed similarities")
    p.add_argument("pairs", help="CSV of word pairs")
    p.add_argument("states", help="Parquet of row, h; with a window, of doc_id, pos, v")
    p.add_argument("unembedding")
    p.add_argument("vocab", help="Parquet of token, str")
    p.add_argument("out")
    p.add_argument("--word1-col", default="word1")
    p.add_argument("--word2-col", default="word2")
    _window(p)
    p.add_argument("--quantities", nargs="+", choices=similarity.QUANTITIES, default=list(similarity.QUANTITIES))

    p = sub.add_parser("marginals", help="mean probability of every token")
    p.add_argument("states")
    p.add_argument("unembedding")
    p.add_argument("out")

    p = sub.add_parser("density", help="fit a density of states")
    p.add_argument("states")
    p.add_argument("out")
    p.add_argument("--components", type=int)
    p.add_argument("--iterations", type=int, default=200)

    p = sub.add_parser("benchmarks", help="rank correlation of an embedding with word-pair benchmarks")
    p.add_argument("embedding", help="Parquet of token, e, or a .npz file")
    p.add_argument("vocab")
    p.add_argument("out")
    p.add_argument("--method", choices=("cosine", "dot"), default="cosine")
    p.add_argument("--files", nargs="+", required=True, metavar="NAME=PATH")
    p.add_argument("--benchmarks", nargs="+", help="names of those to run, all by default")
    return top


def run(spark: SparkSession, argv: list[str]) -> None:
    a = parser().parse_args(argv)
    read = spark.read.parquet
    if a.command == "extract":
        w = read(a.unembedding)
        direction = moments.degenerate_direction(w) if a.project_degenerate else None
        samples.extract(read(a.states), w, _offsets(spark, a), a.folder, a.name, a.averaging, a.min_context, direction, a.save_subsample, not a.no_save_states)
    elif a.command == "embeddings":
        states, w = read(a.states), read(a.unembedding)
        z = arrays.vector_file(spark, a.z_from) if (a.z_from or "").endswith(".npy") else read(a.z_from) if a.z_from else None
        targets = None
        if a.top_tokens:
            known = z or moments.marginals(states, w)
            targets = sorted(r["token"] for r in known.orderBy(F.desc("z"), "token").limit(a.top_tokens).collect())
        if a.target_tokens_file:
            targets = sorted({int(r["value"]) for r in spark.read.text(a.target_tokens_file).where("trim(value) <> ''").collect()})
        made = embeddings.embed(states, w, a.k, a.eig_weight, not a.no_ilr and targets is None, a.center, targets, z, a.eps)
        if a.neighbors_for:
            named = made.vectors.select(F.col("token").alias("id"), "e")
            vectorspace.nearest_tokens(named.where(F.col("id").isin(a.neighbors_for)), named, 10).orderBy("id", "rank").show(10 * len(a.neighbors_for), truncate=False)
        if a.out.endswith(".npz"):
            arrays.save_embedding_archive(made.vectors, a.out, s=made.values)
        else:
            made.vectors.write.mode("overwrite").parquet(a.out)
    elif a.command == "similarity":
        named = pairs.with_tokens(samples.pairs_in(spark, a.pairs, a.word1_col, a.word2_col), read(a.vocab))
        states, w = read(a.states), read(a.unembedding)
        if "v" in states.columns:
            done = samples.window_pair_similarities(named, states, w, _offsets(spark, a), a.quantities)
        else:
            done = similarity.pair_similarities(named, states, w, a.quantities)
        samples.pairs_out(done.drop("t1", "t2").withColumnsRenamed({"word1": a.word1_col, "word2": a.word2_col}), a.out)
    elif a.command == "marginals":
        moments.marginals(read(a.states), read(a.unembedding)).write.mode("overwrite").parquet(a.out)
    elif a.command == "density":
        DensityModel.fit(read(a.states), a.components, iterations=a.iterations).table(spark).write.mode("overwrite").parquet(a.out)
    else:
        vectors = arrays.embedding_archive(spark, a.embedding) if a.embedding.endswith(".npz") else read(a.embedding)
        files = dict(f.split("=", 1) for f in a.files)
        found = benchmarks.load_all(spark, {n: p for n, p in files.items() if not a.benchmarks or n in a.benchmarks})
        samples.pairs_out(pairs.run_benchmarks(found, vectors, read(a.vocab), a.method), a.out)


def main() -> None:
    run(SparkSession.builder.appName("glosswork").getOrCreate(), sys.argv[1:])


if __name__ == "__main__":
    main()
