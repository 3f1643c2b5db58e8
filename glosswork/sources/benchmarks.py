"""Readers of word-pair benchmarks, all to ``(word1, word2, similarity)``."""

from __future__ import annotations

import csv
import logging
from collections.abc import Callable, Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.pairs import BENCHMARKS
from ..session import materialise

logger = logging.getLogger(__name__)

# Header names that the readers know.
FIRST_WORD = ("word1", "word_1")
SECOND_WORD = ("word2", "word_2")
JUDGEMENT = ("similarity", "score", "human (mean)", "sim")


#: Column that holds the text of a row with another number of fields than the header.
CORRUPT = "_corrupt_row"


def _csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Rows of a text file as strings; rows that do not fit the header are counted, reported and left out."""
    options = {"sep": sep, "quote": '"', "escape": '"'}
    names = spark.read.csv(path, header=True, **options).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])
    held = materialise(spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, enforceSchema=True, **options).toDF(*(f"c{k}" for k in range(len(names))), CORRUPT), "rows")
    odd = held.where(F.col(CORRUPT).isNotNull())
    left_out = odd.count()
    if left_out:
        logger.warning("%s: %d rows do not fit the header and are left out, such as %r", path, left_out, odd.first()[CORRUPT])
    df = held.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return df.toDF(*[c.strip().lstrip("\ufeff").strip('"') for c in names])


def _pick(df: DataFrame, names: tuple[str, ...]) -> str:
    found = [c for c in df.columns if c.strip().lower() in names]
    if not found:
        raise ValueError(f"no column of {names} among {df.columns}")
    return found[0]


def _shaped(df: DataFrame, word1: str, word2: str, similarity, lower: tuple[bool, bool] = (True, True)) -> DataFrame:
    value = F.col(f"`{similarity}`").try_cast("double") if isinstance(similarity, str) else similarity
    names = [F.col(f"`{w}`") for w in (word1, word2)]
    words = [F.lower(c) if low else c for c, low in zip(names, lower)]
    return df.select(words[0].alias("word1"), words[1].alias("word2"), value.alias("similarity")).na.drop()


def pairs_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of pairs with a judgement under one of several header names; words in lower case, rows with a gap dropped."""
    df = _csv(spark, path)
    return _shaped(df, _pick(df, FIRST_WORD), _pick(df, SECOND_WORD), _pick(df, JUDGEMENT))


def word_similarity_353(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path)
    return _shaped(df, _pick(df, ("word 1",)), _pick(df, ("word 2",)), _pick(df, ("human (mean)",)))


def association_json(spark: SparkSession, path: str) -> DataFrame:
    """``{cue: {response: count}}`` or a list of such objects: share of a response among all of its cue.

    Shares count all responses, also those of several words, which are then
    left out; cues that do not hold counts, and cues without any, are skipped.
    """
    text = spark.read.text(path, wholetext=True).select("value")
    listed = F.from_json("value", "array<map<string,string>>")
    single = F.from_json("value", "map<string,string>")
    cues = text.select(F.explode(F.when(F.trim("value").startswith("["), listed).otherwise(F.array(single))).alias("m")).select(F.explode("m").alias("cue", "body"))
    counts = cues.select("cue", F.explode(F.from_json("body", "map<string,double>")).alias("response", "n")).where("n IS NOT NULL")
    total = counts.groupBy("cue").agg(F.sum("n").alias("total")).where("total > 0")
    shares = counts.join(total, "cue").where(~F.trim("response").contains(" "))
    return _shaped(shares, "cue", "response", F.col("n") / F.col("total"))


def delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter of a text file by its first line: tab, semicolon or comma."""
    first = spark.read.text(path).first()
    head = first["value"] if first else ""
    try:
        return csv.Sniffer().sniff(head, "\t;,").delimiter
    except csv.Error:
        return max("\t;,", key=head.count)


def small_world(spark: SparkSession, path: str) -> DataFrame:
    """Cue, response and strength of first responses given at least once; responses of several words are left out."""
    df = _csv(spark, path, delimiter(spark, path))
    kept = df.where((F.col("R1").try_cast("double") >= 1) & F.col("response").isNotNull() & ~F.trim("response").contains(" "))
    return _shaped(kept, "cue", "response", "R1.Strength")


def norms(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path, delimiter(spark, path))
    return _shaped(df, _pick(df, ("cues", "cue")), _pick(df, ("targets", "target")), _pick(df, ("forward strength",)))


def _mean_time(df: DataFrame, word1: str, word2: str, time: str, lower: tuple[bool, bool]) -> DataFrame:
    rows = _shaped(df, word1, word2, F.col(f"`{time}`").try_cast("double"), lower)
    return rows.groupBy("word1", "word2").agg((-F.avg("similarity")).alias("similarity"))


def priming_many_languages(spark: SparkSession, path: str) -> DataFrame:
    """Negative mean reaction time of pairs whose target and participant are kept; words as they are."""
    df = _csv(spark, path)
    kept = df.where((F.lower("keep_target") == "keep") & (F.lower("keep_participant") == "keep"))
    return _mean_time(kept, "cue_word", "target_word", "target_Z_RT", (False, False))


def priming_project(spark: SparkSession, path: str) -> DataFrame:
    """Negative mean reaction time of kept trials; a spreadsheet or a text file, only the prime in lower case."""
    if path.endswith(".xlsx"):
        import pandas as pd

        frame = pd.read_excel(path.removeprefix("file://"), dtype=str)
        df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None))
    else:
        df = _csv(spark, path, delimiter(spark, path))
    return _mean_time(df.where(F.col("keep").try_cast("double") == 1), "prime", "target", "target.rt", (True, False))


READERS: Mapping[str, Callable[[SparkSession, str], DataFrame]] = {name: pairs_csv for name, *_ in BENCHMARKS} | {
    "ws353": word_similarity_353, "eat": association_json, "swow": small_world, "usf": norms, "spaml": priming_many_languages, "spp": priming_project,
}


def load(spark: SparkSession, name: str, path: str | None) -> DataFrame:
    """``(name, word1, word2, similarity)`` of one benchmark from a staged file; nothing is downloaded."""
    if name not in READERS:
        raise ValueError(f"unknown benchmark {name!r}; one of {sorted(READERS)}")
    if not path:
        raise ValueError(f"benchmark {name!r} needs a path")
    return READERS[name](spark, path).select(F.lit(name).alias("name"), "word1", "word2", "similarity")


def load_all(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """All benchmarks with a path in one table; one that cannot be read is logged and skipped."""
    result = spark.createDataFrame([], "name string, word1 string, word2 string, similarity double")
    for name, path in paths.items():
        try:
            one = load(spark, name, path)
            one.limit(1).collect()  # a reader that fails must fail here
        except (PySparkException, OSError, ValueError) as e:
            logger.warning("benchmark %s is skipped: %s", name, e)
            continue
        result = result.unionByName(one)
    return result
