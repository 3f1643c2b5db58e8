"""Frequency of every term over all records (problem 3).

Heavy-light aggregation: terms that a bounded sketch finds heavy are counted
in exact local arrays, one per task, and only their sums leave the task; all
other terms are shuffled. The union of both is exact, whatever the sketch
took for heavy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, ship
from .corpus import CHUNK_BITS, current, placed

#: Terms counted in local arrays, and records spread over several tasks, at most.
HEAVY_TERMS, HOT_RECORDS = 1024, 1024

#: Counters of the sketches that find them: any value above 1/TRACKED of all rows is found.
TRACKED = 16384

#: Entries of light terms held by a task before they are passed on.
LIGHT_ENTRIES = 1 << 20

PARTIAL = "token int, doc_id bigint, n bigint, docs bigint"


def heavy_hitters(corpus: DataFrame) -> tuple[list[int], list[int]]:
    """Terms and records that may hold a large share of the rows, from one scan with bounded memory."""
    found = (
        placed(corpus)
        .where("token IS NOT NULL")
        .select(
            F.expr(f"approx_top_k(token, {HEAVY_TERMS}, {TRACKED})").alias("terms"),
            F.expr(f"approx_top_k(doc_id, {HOT_RECORDS}, {TRACKED})").alias("records"),
        )
        .first()
    )
    hot = [r["item"] for r in found["records"] or [] if r["count"] > 4 << CHUNK_BITS]
    return sorted(r["item"] for r in found["terms"] or []), sorted(hot)


def _local(heavy: np.ndarray):
    """Counts of one task: rows ``(token, doc_id, n)`` distinct by token and record come in, sums go out.

    A row with ``hot`` set belongs to a record that other tasks share; it
    keeps its ``doc_id`` so that the record counts once.
    """

    def rows(token, doc, n, docs) -> pa.RecordBatch:
        none = np.full(len(n), doc is None)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.zeros(len(n), np.int32) if token is None else token.astype(np.int32), mask=np.full(len(n), token is None)),
                pa.array(np.zeros(len(n), np.int64) if doc is None else doc, mask=none),
                pa.array(n.astype(np.int64)),
                pa.array(docs.astype(np.int64)),
            ],
            names=["token", "doc_id", "n", "docs"],
        )

    def fold(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        token, n, docs = (np.concatenate(x) for x in zip(*parts))
        known, at = np.unique(token, return_inverse=True)
        return known, np.bincount(at, n, len(known)).astype(np.int64), np.bincount(at, docs, len(known)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences, records = np.zeros(len(heavy), np.int64), np.zeros(len(heavy), np.int64)
        light: list = []
        held = 0
        seen: list[np.ndarray] = []
        for batch in batches:
            doc, token, n, hot = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if hot.any():
                yield rows(token[hot], doc[hot], n[hot], np.ones(int(hot.sum())))
                these = np.unique(doc[hot])
                yield rows(None, these, np.zeros(len(these)), np.ones(len(these)))
                doc, token, n = doc[~hot], token[~hot], n[~hot]
            seen.append(np.unique(doc))
            if len(seen) > 64:
                seen = [np.unique(np.concatenate(seen))]
            at = np.searchsorted(heavy, token)
            is_heavy = (heavy[np.minimum(at, len(heavy) - 1)] == token) if len(heavy) else np.zeros(len(token), bool)
            np.add.at(occurrences, at[is_heavy], n[is_heavy])
            records += np.bincount(at[is_heavy], minlength=len(heavy))
            light.append((token[~is_heavy], n[~is_heavy], np.ones(int((~is_heavy).sum()), np.int64)))
            held += len(light[-1][0])
            if held > LIGHT_ENTRIES:
                light = [fold(light)]
                if (held := len(light[0][0])) > LIGHT_ENTRIES // 2:
                    yield rows(light[0][0], None, *light[0][1:])
                    light, held = [], 0
        if light:
            token, n, docs = fold(light)
            yield rows(token, None, n, docs)
        if len(used := np.flatnonzero(occurrences)):
            yield rows(heavy[used], None, occurrences[used], records[used])
        if seen and (total := len(np.unique(np.concatenate(seen)))):
            yield rows(None, None, np.zeros(1), np.array([total]))

    return run


def token_frequency(corpus: DataFrame, vocab: DataFrame, rare_docs: int = 2, common_share: float = 0.5) -> DataFrame:
    """``(token, n, docs, mark)`` for every token that is current somewhere.

    ``n`` is how often it is current, ``docs`` in how many documents. ``mark``
    is ``rare`` if that is at most ``rare_docs``, ``common`` if it is more
    than ``common_share`` of all documents that have a current token, else
    null; a token that would be both is ``rare``. Nulls, repeats and ties
    are treated as in :func:`~.corpus.current`. Empty tables give no rows;
    other columns are not read. All counts are exact over all rows.

    Documents that may hold a large share of the rows are spread over tasks
    by position; every other document lies in one task, where its distinct
    tokens are final.
    """
    ship(corpus.sparkSession)
    terms, hot = heavy_hitters(corpus)
    # never a constant, so that the shuffle on (doc_id, chunk) serves all later steps; what is named hot only moves work
    is_hot = F.col("doc_id").isin(hot or [-(1 << 63)])
    chunk = F.when(is_hot, F.shiftright("pos", CHUNK_BITS)).otherwise(0)
    held = current(corpus, vocab, chunk)
    pairs = held.groupBy("doc_id", "chunk", "token").agg(F.count(F.lit(1)).alias("n"))
    partial = pairs.select("doc_id", "token", "n", is_hot.alias("hot")).mapInArrow(_local(np.array(terms, np.int64)), PARTIAL)
    by_record = partial.groupBy("token", "doc_id").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    once = F.when(F.col("doc_id").isNotNull(), 1).otherwise(F.col("docs"))
    counts = materialise(by_record.groupBy("token").agg(F.sum("n").alias("n"), F.sum(once).alias("docs")), "token-counts")
    total = counts.where("token IS NULL").agg(F.sum("docs")).first()[0] or 0
    mark = F.when(F.col("docs") <= rare_docs, "rare").when(F.col("docs") > common_share * total, "common")
    return counts.where("token IS NOT NULL").withColumn("mark", mark)
