"""Running sums over streams of states: marginals, moments and pair sums are additive.

A micro-batch is folded like a table and its sums are appended under the
batch's number; the current value of a statistic is the sum over batches. A
batch that is delivered again replaces its own rows, so sums stay exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.folds import Kernel, fold


def moment_kernel(h: np.ndarray, log_p: np.ndarray) -> dict[str, np.ndarray]:
    """Sums from which marginals, moments and association values follow."""
    p = np.exp(log_p)
    return {"m": p.T @ p, "z": p.sum(0), "n": np.full(1, len(h))}


def accumulate(stream: DataFrame, weights: np.ndarray, path: str, checkpoint: str, kernel: Kernel = moment_kernel, available_now: bool = True) -> StreamingQuery:
    """Start a query that folds the states ``(h)`` of ``stream`` into the table at ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        fold(batch, weights, kernel).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(spark, path: str) -> DataFrame:
    """``(stat, i, j, value)``: the sums over all batches so far."""
    return spark.read.parquet(path).groupBy("stat", "i", "j").agg(F.sum("value").alias("value"))


def token_counts(stream: DataFrame, late: str = "1 hour", time: str = "loaded_at") -> DataFrame:
    """``(token, n)`` of a stream of ``(doc_id, pos, token, time)``; a row delivered again within ``late`` counts once."""
    once = stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["doc_id", "pos", "token"])
    return once.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(stream: DataFrame, width: str = "1 day", late: str = "1 hour", time: str = "loaded_at", slide: str | None = None) -> DataFrame:
    """``(window_start, n, tokens)`` of windows over event time, tumbling or every ``slide``; rows later than ``late`` are left out."""
    per = stream.withWatermark(time, late).groupBy(F.window(time, width, slide) if slide else F.window(time, width))
    return per.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("token").alias("tokens")).select(F.col("window.start").alias("window_start"), "n", "tokens")


def session_counts(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour", time: str = "loaded_at", by: str = "doc_id") -> DataFrame:
    """``(by, session_start, session_end, n)`` of sessions that end after ``gap`` without a row."""
    per = stream.withWatermark(time, late).groupBy(by, F.session_window(time, gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return per.select(by, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def upsert(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the changed rows of every micro-batch of ``changes`` under the batch's number, in update mode, so that state behind the watermark is dropped."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def newest(spark, path: str, key: str) -> DataFrame:
    """The last state of every key of what :func:`upsert` keeps."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(key, *(F.col(f"v.{c}").alias(c) for c in values))
