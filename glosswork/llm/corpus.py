"""Current tokens of the token stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small

#: Positions of one document up to this power of two stay in one task.
CHUNK_BITS = 16

#: Bytes a vocabulary entry takes when broadcast.
ENTRY_BYTES = 24

# The kinds of boundary, finest first.
LEVELS = ("sentence", "paragraph", "document")


def boundary_level(column: str = "boundary") -> Column:
    """0 for tokens that end no unit, 1 for a sentence, 2 for a paragraph, 3 for a document."""
    level = F.lit(0)
    for n, name in enumerate(LEVELS, 1):
        level = F.when(F.lower(F.trim(column)) == name, n).otherwise(level)
    return level.cast("int")


def placed(corpus: DataFrame) -> DataFrame:
    """Rows that have a place in a document."""
    return corpus.select("doc_id", "pos", "token", "loaded_at").where("doc_id IS NOT NULL AND pos IS NOT NULL")


def current(rows: DataFrame, vocab: DataFrame, chunk: Column) -> DataFrame:
    """``(doc_id, chunk, pos, token, level)`` of the current tokens.

    Of the rows of one ``(doc_id, pos)`` the one with the greatest
    ``loaded_at`` holds, a null ``loaded_at`` being the earliest; rows that
    tie there agree, and repeated rows count once. Then positions go whose
    token is null or not in ``vocab``. ``chunk`` must be a function of
    ``(doc_id, pos)``: one shuffle on ``(doc_id, chunk)`` serves the choice
    of the row and every later step within a chunk, and a document of any
    length is spread over as many tasks as it has chunks.
    """
    earliest = F.lit("0001-01-01").cast(rows.schema["loaded_at"].dataType)
    latest = F.max_by("token", F.coalesce("loaded_at", earliest))
    held = (
        placed(rows)
        .withColumn("chunk", chunk)
        .repartition("doc_id", "chunk")
        .groupBy("doc_id", "chunk", "pos")
        .agg(latest.alias("token"))
        .where("token IS NOT NULL")
    )
    known = vocab.where("token IS NOT NULL").groupBy("token").agg(F.max(boundary_level()).alias("level"))
    return held.join(small(known, ENTRY_BYTES), "token").select("doc_id", "chunk", "pos", "token", "level")
