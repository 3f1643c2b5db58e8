"""Word pairs: vocabulary lookup, enrichment, and rank correlation with human judgements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, doubles, norm
from ..session import materialise, small

# The word-pair benchmarks by name, with title, source and kind of task.
BENCHMARKS = (
    ("ws353", "WordSim353", "Finkelstein et al. (2001)", "Relatedness Judgement"),
    ("mc30", "Miller and Charles (1991)", "Miller and Charles (1991)", "Similarity Judgement"),
    ("rg65", "Rubenstein and Goodenough (1965)", "Rubenstein and Goodenough (1965)", "Similarity Judgement"),
    ("rw", "Rare Word", "Luong et al. (2013)", "Relatedness Judgement"),
    ("semeval17", "SemEval 2017 Task 2", "Camacho-Collados et al. (2017)", "Similarity Judgement"),
    ("simlex999", "SimLex-999", "Hill et al. (2014)", "Similarity Judgement"),
    ("yp130", "Yang and Powers (2006)", "Yang and Powers (2006)", "Similarity Judgement"),
    ("mturk287", "MTurk-287", "Radinsky et al. (2011)", "Relatedness Judgement"),
    ("mturk771", "MTurk-771", "Halawi et al. (2012)", "Relatedness Judgement"),
    ("verb143", "Verb-143", "Yang and Powers (2007)", "Similarity Judgement"),
    ("eat", "Edinburgh Associative Thesaurus", "Kiss et al. (1973)", "Free Association"),
    ("swow", "Small World of Words", "De Deyne et al. (2019)", "Free Association"),
    ("usf", "USF Norms", "Nelson et al. (2004)", "Free Association"),
    ("spaml", "SPAML", "Buchanan et al. (2025)", "Semantic Priming (Lexical Decision)"),
    ("spp", "Semantic Priming Project", "Hutchison et al. (2013)", "Semantic Priming (Lexical Decision)"),
)


def benchmark_table(spark) -> DataFrame:
    """``(name, title, source, task_type)`` of all known benchmarks."""
    return spark.createDataFrame(list(BENCHMARKS), "name string, title string, source string, task_type string")


def words_of(vocab: DataFrame) -> DataFrame:
    """``(str, token)`` with one token for each string, the least where several share it; null strings are left out."""
    return vocab.where("str IS NOT NULL").groupBy("str").agg(F.min("token").alias("token"))


def with_tokens(pairs: DataFrame, vocab: DataFrame) -> DataFrame:
    """``pairs`` with ``t1`` and ``t2``, the tokens of exactly ``word1`` and ``word2``, null where unknown."""
    v = words_of(vocab)
    first = small(v.select(F.col("str").alias("word1"), F.col("token").alias("t1")), 64)
    second = small(v.select(F.col("str").alias("word2"), F.col("token").alias("t2")), 64)
    return pairs.join(first, "word1", "left").join(second, "word2", "left")


def resolve(words: DataFrame, vocab: DataFrame, column: str = "word") -> DataFrame:
    """``(word, token)`` of distinct words by the first of four forms that the vocabulary has.

    The forms are the word, the word after a space, and both in lower case;
    words without a token are left out.
    """
    distinct = words.select(F.col(column).alias("word")).where("word IS NOT NULL").distinct()
    w = F.col("word")
    forms = F.array(w, F.concat(F.lit(" "), w), F.lower(w), F.concat(F.lit(" "), F.lower(w)))
    tried = distinct.select("word", F.posexplode(forms).alias("choice", "str"))
    hit = tried.join(small(words_of(vocab), 64), "str")
    return hit.groupBy("word").agg(F.min_by("token", "choice").alias("token"))


def enrich(pairs: DataFrame, values: DataFrame, vocab: DataFrame) -> DataFrame:
    """``pairs`` with the columns of ``values(t1, t2, ...)``; repeated pairs share them and unknown words have null."""
    return with_tokens(pairs, vocab).join(values, ["t1", "t2"], "left")


def coverage(pairs: DataFrame) -> DataFrame:
    """One row ``(pairs, known, unknown)`` of pairs that went through :func:`with_tokens`."""
    known = F.sum((F.col("t1").isNotNull() & F.col("t2").isNotNull()).cast("long"))
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), known.alias("known")).withColumn("unknown", F.col("pairs") - F.col("known"))


def pair_scores(benchmark: DataFrame, vectors: DataFrame, vocab: DataFrame, method: str = "cosine") -> DataFrame:
    """``benchmark(name, word1, word2, similarity)`` with ``score``, null where a word has no vector.

    ``vectors(token, e)``; a vector shorter than 1e-12 counts as of length one.
    """
    if method not in ("cosine", "dot"):
        raise ValueError("the method is 'cosine' or 'dot'")
    both = benchmark.select(F.col("word1").alias("word")).union(benchmark.select("word2"))
    known = resolve(both, vocab).join(vectors.select("token", doubles("e").alias("e")), "token")
    a = known.select(F.col("word").alias("word1"), F.col("e").alias("a"))
    b = known.select(F.col("word").alias("word2"), F.col("e").alias("b"))
    joined = benchmark.join(a, "word1", "left").join(b, "word2", "left")

    def length(v):
        return F.when(norm(v) < 1e-12, 1.0).otherwise(norm(v))

    value = dot("a", "b")
    return joined.withColumn("score", value / (length("a") * length("b")) if method == "cosine" else value).drop("a", "b")


def mean_ranks(rows: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Ranks within ``by``, equal values sharing their mean rank.

    Distinct values are counted first and lie in ranges over the tasks;
    ranks are sums within a range on top of the sums of the ranges before, so
    that one group of any size is ranked by many tasks.
    """
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    ranged = materialise(counted.repartitionByRange(*by, value).withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*by, "__part").agg(F.sum("__n").alias("__n")).select(*by, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(*by, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("__base") + F.coalesce(F.sum("__n").over(within), F.lit(0)) + (F.col("__n") + 1) / F.lit(2.0)
    ranks = ranged.join(small(parts, 48), [*by, "__part"]).select(*by, value, rank.alias(out))
    return rows.join(small(materialise(ranks, "ranks"), 48), [*by, value])


def spearman(scored: DataFrame) -> DataFrame:
    """``(name, n_pairs, benchmark_size, coverage, spearman_r)`` of ``(name, similarity, score)``.

    ``n_pairs`` counts all pairs, ``benchmark_size`` those with a score;
    fewer than two of them, or a constant side, give a null correlation.
    """
    valid = scored.where("score IS NOT NULL AND similarity IS NOT NULL")
    valid = materialise(valid.select("name", "similarity", "score"), "scored")
    ranked = mean_ranks(mean_ranks(valid, ["name"], "similarity", "ra"), ["name"], "score", "rb")
    r = ranked.groupBy("name").agg(F.count(F.lit(1)).alias("benchmark_size"), (F.covar_pop("ra", "rb") / F.nullif(F.stddev_pop("ra") * F.stddev_pop("rb"), F.lit(0.0))).alias("r"))
    total = scored.groupBy("name").agg(F.count(F.lit(1)).alias("n_pairs"))
    joined = total.join(r, "name", "left").fillna({"benchmark_size": 0})
    good = F.col("benchmark_size") >= 2
    return joined.select("name", "n_pairs", "benchmark_size", (F.col("benchmark_size") / F.col("n_pairs")).alias("coverage"), F.when(good, F.col("r")).alias("spearman_r"))


def run_benchmarks(benchmarks: DataFrame, vectors: DataFrame, vocab: DataFrame, method: str = "cosine") -> DataFrame:
    """Correlations of all benchmarks with their titles and tasks, greatest first."""
    result = spearman(pair_scores(benchmarks, vectors, vocab, method))
    facts = F.broadcast(benchmark_table(benchmarks.sparkSession))
    return result.join(facts, "name", "left").orderBy(F.desc_nulls_last("spearman_r"), "name")
