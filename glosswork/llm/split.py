"""Splitting long token sequences at natural boundaries (problem 1).

Recursive separator hierarchy: a document is cut into units after tokens
that end a document, a paragraph, then a sentence, each level only where a
unit is still too long, and last between any two tokens. Consecutive units
are packed greedily into pieces, and every piece after the first repeats the
end of the one before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, ship
from .corpus import CHUNK_BITS, LEVELS, current

#: Tokens in a piece at most, and tokens that a piece repeats of the one before.
LIMIT, OVERLAP = 1024, 64

#: Tokens of a document whose pieces are packed in one go, as a power of two.
SEGMENT_BITS = 20

PIECE = "doc_id bigint, segment bigint, first bigint, fresh bigint, last bigint, n_tokens bigint, cut string, n_doc bigint, run bigint"


def _units(ends: np.ndarray, level: np.ndarray, start: int, stop: int, most: int) -> list[tuple[int, int, bool]]:
    """``(end, level, divided)`` of consecutive units of at most ``most`` tokens that cover ``[start, stop)``.

    ``ends`` are the sorted places after boundary tokens, ``level`` their
    levels. The coarsest level whose units fit is kept; level 0 marks ends
    that are no boundary. ``divided`` units are parts of one that had no
    separator left and was cut between tokens.
    """
    done: list[tuple[int, int, bool]] = []
    todo = [(start, stop, len(LEVELS))]
    while todo:
        a, b, depth = todo.pop()
        if b - a <= most or depth == 0:
            cuts = range(a + most, b, most)
            done.extend((c, 0, True) for c in cuts)
            i = np.searchsorted(ends, b)
            done.append((b, int(level[i]) if i < len(ends) and ends[i] == b else 0, len(cuts) > 0))
        else:
            lo, hi = np.searchsorted(ends, [a + 1, b])
            cuts = [a, *ends[lo:hi][level[lo:hi] >= depth].tolist(), b]
            todo.extend((x, y, depth - 1) for x, y in zip(cuts[-2::-1], cuts[:0:-1]))
    return done


def pack(ends: np.ndarray, level: np.ndarray, start: int, stop: int, limit: int, overlap: int, prior: int = 0, onward: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """``(first, fresh, last, level, run)`` of the pieces of ``[start, stop)``; ``last`` is exclusive.

    ``fresh`` is where the piece's own tokens begin; it starts ``overlap``
    tokens before (fewer at the document's start). Units have at most
    ``limit - overlap`` tokens so that each fits a piece. ``run`` is the
    longest stretch without a separator that had to be divided for the
    piece, 0 if none had; ``prior`` and ``onward`` are where a stretch begins
    that reaches ``start`` and ends that goes on beyond ``stop``.
    """
    onward = stop if onward is None else onward
    pieces, fresh, run = [], start, 0
    first = max(0, start - overlap)
    end = kind = None
    for unit_end, unit_level, divided in _units(ends, level, start, stop, limit - overlap):
        if end is not None and unit_end - first > limit:
            pieces.append((first, fresh, end, kind, run))
            fresh, first, run = end, max(0, end - overlap), 0
        end, kind = unit_end, unit_level
        if divided or (unit_end == stop and not unit_level and onward > stop):
            at = int(np.searchsorted(ends, unit_end))
            begin = int(ends[at - 1]) if at else prior
            finish = int(ends[at]) - 1 if at < len(ends) else onward
            run = max(run, finish - max(begin, prior))
    if end is not None:
        pieces.append((first, fresh, end, kind, run))
    return pieces


def _pieces(limit: int, overlap: int):
    names = np.array(["inside", *LEVELS], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            marks = batch.column(batch.num_columns - 1)
            coded_all, at = marks.values.to_numpy(), marks.offsets.to_numpy()
            for i, r in enumerate(batch.drop_columns(["marks"]).to_pylist()):
                coded = coded_all[at[i] : at[i + 1]]
                ends, level = coded >> 2, coded & 3
                for first, fresh, last, kind, stretch in pack(ends, level, r["start"], r["stop"], limit, overlap, r["prior"], r["onward"]):
                    cut = "end" if last == r["n_doc"] else names[kind]
                    out.append((r["doc_id"], r["segment"], first, fresh, last, last - first, cut, r["n_doc"], stretch))
            columns = list(zip(*out)) if out else [[]] * 9
            kinds = [pa.int64()] * 6 + [pa.string()] + [pa.int64()] * 2
            fields = [f.split()[0] for f in PIECE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=fields)

    return run


def numbered(corpus: DataFrame, vocab: DataFrame) -> DataFrame:
    """Current tokens with ``rank``, their number within a chunk of positions, from 1."""
    held = current(corpus, vocab, F.shiftright("pos", CHUNK_BITS))
    return held.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "chunk").orderBy("pos")))


def _chunks(tokens: DataFrame, with_tokens: bool = False) -> DataFrame:
    """A row for each chunk: its number of tokens, its marks (end << 2 | level) and, if asked for, its tokens in order."""
    mark = F.when(F.col("level") > 0, F.shiftleft(F.col("rank").cast("bigint"), 2).bitwiseOR(F.col("level")))
    kept = [F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(mark)).alias("local")]
    if with_tokens:
        kept.append(F.sort_array(F.collect_list(F.struct("rank", "token"))).getField("token").alias("tokens"))
    return tokens.groupBy("doc_id", "chunk").agg(*kept)


def _based(chunks: DataFrame) -> DataFrame:
    """Chunks with ``base``, the tokens before them, and ``n_doc``, those of their document."""
    whole = Window.partitionBy("doc_id")
    before = whole.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumns({"base": F.coalesce(F.sum("n").over(before), F.lit(0)), "n_doc": F.sum("n").over(whole)})


def split(corpus: DataFrame, vocab: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, oversized_only: bool = False) -> DataFrame:
    """Pieces of every document of ``corpus``, at most ``limit`` tokens each.

    A row is one piece: it holds the tokens ``first .. last - 1`` of the
    document's current tokens in order of ``pos`` (counted from 0); from
    ``fresh`` on they are new, before it they repeat the ``overlap`` last
    tokens of the piece before. ``cut`` tells what lies at its end:
    ``document``, ``paragraph`` or ``sentence``, the boundary after which it
    was cut; ``inside`` if there was none in reach; ``end`` of the document.
    ``n_doc`` is the number of current tokens of the document and ``run`` the
    longest stretch of tokens without a boundary that the piece is, or has,
    a part of and that had to be divided between tokens, else 0. A document
    within the limit is one piece; with ``oversized_only`` it is left out.
    Nulls, repeats, ties and unknown tokens are treated as in
    :func:`~.corpus.current`; documents without a current token and empty
    tables give no rows.

    Work is bounded for documents of any length: tokens are numbered within
    chunks of positions, only boundary marks travel on, and pieces are
    packed within segments of 2**20 tokens. A segment ends after its
    last boundary that is at most ``limit - overlap`` tokens from its end,
    else at its end, so packing starts anew there at a natural place.
    """
    ship(corpus.sparkSession)
    return _packed(_chunks(numbered(corpus, vocab)), limit, overlap, oversized_only)


def _packed(chunks: DataFrame, limit: int, overlap: int, oversized_only: bool) -> DataFrame:
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    chunks = _based(chunks)
    if oversized_only:
        chunks = chunks.where(F.col("n_doc") > limit)
    moved = F.transform("local", lambda m: m + F.shiftleft(F.col("base"), 2))
    segments = (
        chunks.select("doc_id", F.shiftright("base", SEGMENT_BITS).alias("segment"), "n_doc", "n", "base", moved.alias("marks"))
        .groupBy("doc_id", "segment")
        .agg(F.first("n_doc").alias("n_doc"), F.min("base").alias("begin"), F.max(F.col("base") + F.col("n")).alias("finish"), F.sort_array(F.flatten(F.collect_list("marks"))).alias("marks"))
    )
    order = Window.partitionBy("doc_id").orderBy("segment")
    end_of = lambda m: F.shiftright(m, 2)
    last_mark = end_of(F.element_at("marks", -1))
    near = F.when((F.size("marks") > 0) & (last_mark > F.col("finish") - (limit - overlap)), last_mark)
    stop = F.when(F.col("finish") == F.col("n_doc"), F.col("finish")).otherwise(F.coalesce(near, F.col("finish")))
    marked = F.size("marks") > 0
    segments = segments.withColumns({"stop": stop, "first_mark": F.when(marked, end_of(F.element_at("marks", 1))), "end_mark": F.when(marked, last_mark)})
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    # where a stretch begins that reaches into the segment, and where one ends that leaves it
    segments = segments.withColumns(
        {
            "start": F.coalesce(F.lag("stop").over(order), F.lit(0)),
            "prior": F.coalesce(F.last("end_mark", True).over(before), F.lit(0)),
            "onward": F.coalesce(F.first("first_mark", True).over(after) - 1, F.col("n_doc")),
        }
    )
    # a piece may start before its segment, so marks of the segment before within reach go along
    carried = F.coalesce(F.lag(F.filter("marks", lambda m: F.shiftright(m, 2) >= F.col("finish") - limit)).over(order), F.array().cast("array<bigint>"))
    ready = segments.select("doc_id", "segment", "start", "stop", "n_doc", "prior", "onward", F.concat(carried, "marks").alias("marks"))
    return ready.mapInArrow(_pieces(limit, overlap), PIECE)


def piece_tokens(corpus: DataFrame, vocab: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(doc_id, first, fresh, last, cut, run, n_doc, tokens)``: the pieces of :func:`split` with their tokens in order.

    A token of the overlap appears in both pieces. The chunks with their
    tokens are written once; pieces are packed from their marks and cut out
    of the chunks, where most lie as a whole.
    """
    ship(corpus.sparkSession)
    chunks = materialise(_chunks(numbered(corpus, vocab), with_tokens=True), "chunks")
    stretch = lambda c: F.shiftright(c, CHUNK_BITS)
    pieces = _packed(chunks.drop("tokens"), limit, overlap, False)
    pieces = pieces.withColumn("stretch", F.explode(F.sequence(stretch(F.col("first")), stretch(F.col("last") - 1))))
    places = _based(chunks.select("doc_id", "chunk", "n")).drop("n_doc")
    places = places.withColumn("stretch", F.explode(F.sequence(stretch(F.col("base")), stretch(F.col("base") + F.col("n") - 1))))
    begin, stop = F.greatest("first", "base"), F.least("last", F.col("base") + F.col("n"))
    met = pieces.join(places, ["doc_id", "stretch"]).where((begin < stop) & (stretch(begin) == F.col("stretch")))
    of_chunk = met.groupBy("doc_id", "chunk").agg(
        F.collect_list(F.struct("first", "fresh", "last", "cut", "run", "n_doc", begin.alias("begin"), (begin - F.col("base") + 1).cast("int").alias("at"), (stop - begin).cast("int").alias("size"))).alias("pieces")
    )
    parts = chunks.select("doc_id", "chunk", "tokens").join(of_chunk, ["doc_id", "chunk"]).select("doc_id", "tokens", F.explode("pieces").alias("p"))
    names = ["first", "fresh", "last", "cut", "run", "n_doc"]
    parts = parts.select("doc_id", *(F.col(f"p.{c}") for c in names), "p.begin", "p.size", F.slice("tokens", F.col("p.at"), F.col("p.size")).alias("tokens"))
    total = F.col("last") - F.col("first")
    whole = parts.where(F.col("size") == total).select("doc_id", *names, "tokens")
    joined = parts.where(F.col("size") < total).groupBy("doc_id", *names).agg(F.sort_array(F.collect_list(F.struct("begin", "tokens"))).alias("held"))
    return whole.unionByName(joined.select("doc_id", *names, F.flatten("held.tokens").alias("tokens")))


def oversized(pieces: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(doc_id, cut)`` of the documents that were split: ``inside`` if a stretch longer than what one piece adds had to be divided, else ``boundary``."""
    by_doc = pieces.where(F.col("n_doc") > limit).groupBy("doc_id").agg(F.max("run").alias("run"))
    return by_doc.select("doc_id", F.when(F.col("run") > limit - overlap, "inside").otherwise("boundary").alias("cut"))


def faults(pieces: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(doc_id, n_tokens, check_sum, wrong)`` of the documents of :func:`piece_tokens`.

    ``n_tokens`` and ``check_sum`` (tokens times their number in the
    document, from 1) are of the tokens that are new in each piece; ``wrong``
    counts pieces that are too long, do not follow the one before, repeat
    another number of tokens than ``overlap`` or were cut between tokens
    where no long stretch is.
    """
    order = Window.partitionBy("doc_id").orderBy("fresh")
    follows = F.col("fresh") == F.coalesce(F.lag("last").over(order), F.lit(0))
    repeats = F.col("first") == F.greatest(F.col("fresh") - overlap, F.lit(0))
    held = (F.size("tokens") == F.col("last") - F.col("first")) & (F.size("tokens") <= limit)
    natural = (F.col("cut") != "inside") | (F.col("run") >= limit - overlap)
    again = F.slice("tokens", 1, (F.col("fresh") - F.col("first")).cast("int"))
    before = F.lag(F.slice("tokens", -F.least(F.size("tokens"), F.lit(overlap)), F.least(F.size("tokens"), F.lit(overlap)))).over(order)
    same = F.coalesce(again == F.slice(before, -F.size(again), F.size(again)), F.size(again) == 0) if overlap else F.lit(True)
    right = follows & repeats & held & natural & same
    fresh = F.slice("tokens", (F.col("fresh") - F.col("first") + 1).cast("int"), limit)
    total = F.aggregate(F.transform(fresh, lambda x, i: x.cast("bigint") * (F.col("fresh") + i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    checked = pieces.select("doc_id", F.size(fresh).alias("n"), total.alias("sum"), right.alias("right"))
    return checked.groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), F.sum("sum").alias("check_sum"), F.count_if(~F.col("right")).alias("wrong"))
