"""Token corpora: current tokens, counts, co-occurrence in windows, next tokens, phrases and snippets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windowing
from ..session import BROADCAST_BYTES, ship, small
from .folds import dense, dense_ints

#: Positions of a document that are sorted together, as a power of two.
STRETCH_BITS = 16

#: Pairs of a window that a task holds before it adds them up, and arrays that are averaged at a time.
HELD_PAIRS, WINDOW_ROWS = 1 << 22, 4096


def latest(corpus: DataFrame) -> DataFrame:
    """``(doc_id, pos, token)``: of the rows of a position the one loaded last, without nulls in any of the three.

    A null ``loaded_at`` is the earliest; rows that tie agree. One shuffle
    on the position.
    """
    rows = corpus.where("doc_id IS NOT NULL AND pos IS NOT NULL")
    earliest = F.lit("0001-01-01").cast(corpus.schema["loaded_at"].dataType)
    return rows.groupBy("doc_id", "pos").agg(F.max_by("token", F.coalesce("loaded_at", earliest)).alias("token")).where("token IS NOT NULL")


def words(documents: DataFrame) -> DataFrame:
    """``(doc_id, pos, word)``: runs of letters of the lower-case text, in order from 1; texts without any give no rows."""
    parts = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: x != "")
    return documents.select("doc_id", F.posexplode(parts).alias("p", "word")).select("doc_id", (F.col("p") + 1).alias("pos"), "word")


def vocabulary_counts(tokens: DataFrame, column: str) -> DataFrame:
    """``(column, n, docs)``: occurrences and documents of every value."""
    by_doc = tokens.groupBy(column, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return by_doc.groupBy(column).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


def top_tokens(counts: DataFrame, column: str, n: int, by: str = "n") -> DataFrame:
    """The ``n`` rows of greatest ``by``, the least value first among equals."""
    return counts.orderBy(F.desc(by), column).limit(n)


def in_stretches(rows: DataFrame, backward: int, forward: int) -> DataFrame:
    """``rows`` with ``stretch``, repeated into the neighbouring stretches of positions that windows reach into.

    The layout of everything that looks at neighbours: one shuffle by
    ``(doc_id, stretch)``, in which a document of any length takes many
    tasks. Rows of a stretch of their own are those with ``stretch`` equal to
    ``pos >> STRETCH_BITS``.
    """
    # most positions are far from an end, so that nothing is repeated for them
    reach = F.sequence(F.shiftright(F.col("pos") - forward, STRETCH_BITS), F.shiftright(F.col("pos") + backward, STRETCH_BITS))
    return rows.withColumn("stretch", F.explode(reach))


def _paired(window: windowing.Window):
    """``(at, other, k)`` by batch: rows whose own stretch it is, rows at their ``k``-th offset, over batches sorted by document, stretch and position."""
    reach = max(window.forward, window.backward)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            fresh = [c.to_numpy() for c in batch.columns]
            old = 0 if held is None else len(held[0])
            columns = fresh if held is None else [np.concatenate(x) for x in zip(held, fresh)]
            doc, stretch, pos = columns[:3]
            new = np.r_[True, (doc[1:] != doc[:-1]) | (stretch[1:] != stretch[:-1])] if len(doc) else np.zeros(0, bool)
            # places on one line, on which groups are further apart than any window reaches
            span = np.where(new, 0, np.diff(pos, prepend=pos[:1]))
            line = np.cumsum(span + np.where(new, 2 * reach + 2, 0))
            own = stretch == pos >> STRETCH_BITS
            for k, (o, _) in enumerate(window.offsets):
                # a pair is found when the later of its two rows comes in
                later = np.arange(old, len(line))
                at = np.searchsorted(line, line[later] - abs(o))
                earlier = np.minimum(at, len(line) - 1)
                hit = line[earlier] == line[later] - abs(o)
                first, second = (earlier[hit], later[hit]) if o > 0 else (later[hit], earlier[hit])
                keep = own[first]
                yield columns, first[keep], second[keep], np.full(int(keep.sum()), k)
            rest = len(line) - np.searchsorted(line, line[-1] - reach) if len(line) else 0
            held = [c[len(c) - rest :] for c in columns]

    return run


def _sorted_stretches(corpus: DataFrame, window: windowing.Window) -> DataFrame:
    spread = in_stretches(corpus.select("doc_id", "pos", "token"), window.backward, window.forward).select("doc_id", "stretch", "pos", "token")
    return spread.repartition("doc_id", "stretch").sortWithinPartitions("doc_id", "stretch", "pos")


def window_pairs(corpus: DataFrame, offsets: DataFrame) -> DataFrame:
    """``(doc_id, pos, token, o, other, wt)``: every position with the tokens of its window.

    One shuffle of the tokens, sorted within stretches; pairs are formed
    where they lie.
    """
    ship(corpus.sparkSession)
    window = windowing.resolve(offsets)
    o, wt = (np.array(x) for x in zip(*window.offsets))
    paired = _paired(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (doc, _, pos, token), at, other, k in paired(batches):
            columns = [doc[at], pos[at], token[at], o[k].astype(np.int32), token[other], wt[k].astype(float)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "pos", "token", "o", "other", "wt"])

    kind = corpus.schema["token"].dataType.simpleString()
    return _sorted_stretches(corpus, window).mapInArrow(run, f"doc_id bigint, pos bigint, token {kind}, o int, other {kind}, wt double")


def window_counts(corpus: DataFrame, offsets: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """``(t, w, f)``: summed weights with which ``w`` stands in the windows of ``t``.

    ``targets(token)`` restricts both sides before. Weights are added up
    within a task, and only sums of distinct pairs are shuffled.
    """
    ship(corpus.sparkSession)
    if targets is not None:
        corpus = corpus.join(small(targets.select("token"), 16), "token", "left_semi").select("doc_id", "pos", "token")
    window = windowing.resolve(offsets)
    wt = np.array([w for _, w in window.offsets])
    paired = _paired(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, f, held = [np.zeros(0, np.int64)], [np.zeros(0)], 0

        def total() -> tuple[np.ndarray, np.ndarray]:
            known, at = np.unique(np.concatenate(key), return_inverse=True)
            return known, np.bincount(at, np.concatenate(f), len(known))

        def out(known: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(known), 65536):
                part = known[a : a + 65536]
                yield pa.RecordBatch.from_arrays([pa.array((part >> 32).astype(np.int32)), pa.array((part & 0xFFFFFFFF).astype(np.uint32).view(np.int32)), pa.array(sums[a : a + 65536])], names=["t", "w", "f"])

        for (_, _, _, token), at, other, k in paired(batches):
            key.append(token[at].astype(np.int64) << 32 | token[other].astype(np.int64) & 0xFFFFFFFF)
            f.append(wt[k])
            held += len(at)
            if held > HELD_PAIRS:
                known, sums = total()
                key, f, held = [known], [sums], len(known)
                if held > HELD_PAIRS // 2:
                    yield from out(known, sums)
                    key, f, held = [np.zeros(0, np.int64)], [np.zeros(0)], 0
        yield from out(*total())

    return _sorted_stretches(corpus, window).mapInArrow(run, "t int, w int, f double").groupBy("t", "w").agg(F.sum("f").alias("f"))


def count_pmi(counts: DataFrame) -> DataFrame:
    """``(t, w, f, pmi)``: association values of summed counts, from their own row and column sums."""
    total = counts.agg(F.sum("f").alias("total"))
    row = counts.groupBy("t").agg(F.sum("f").alias("f_t"))
    column = counts.groupBy("w").agg(F.sum("f").alias("f_w"))
    joined = counts.join(row, "t").join(column, "w").join(F.broadcast(total))
    return joined.select("t", "w", "f", F.log(F.col("f") * F.col("total") / (F.col("f_t") * F.col("f_w"))).alias("pmi"))


def next_token(corpus: DataFrame) -> DataFrame:
    """``(doc_id, pos, token, next)``: tokens with the one at the following position of the document, where there is one."""
    spread = in_stretches(corpus.select("doc_id", "pos", "token"), 0, 1)
    order = Window.partitionBy("doc_id", "stretch").orderBy("pos")
    seen = spread.select("doc_id", "pos", "token", "stretch", F.lead("pos").over(order).alias("at"), F.lead("token").over(order).alias("next"))
    return seen.where((F.col("at") == F.col("pos") + 1) & (F.col("stretch") == F.shiftright("pos", STRETCH_BITS))).select("doc_id", "pos", "token", "next")


def predicting(corpus: DataFrame, token: int) -> DataFrame:
    """``(doc_id, pos, token)`` of the positions that are followed by ``token``."""
    return next_token(corpus).where(F.col("next") == token).select("doc_id", "pos", "token")


def phrase_ends(corpus: DataFrame, phrase: Sequence[int]) -> DataFrame:
    """``(doc_id, pos)`` of the state before the last token of each occurrence of ``phrase``.

    The state at ``pos`` predicts the token at ``pos + 1``, where the phrase
    ends. Tokens that stand in the phrase are counted at the place where the
    phrase would end, so that no window over whole documents is sorted.
    """
    if not phrase:
        raise ValueError("the phrase is empty")
    last = len(phrase) - 1
    parts = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(last - k).alias("ahead")) for k, t in enumerate(phrase)]))
    hits = corpus.where(F.col("token").isin(sorted(set(phrase)))).select("doc_id", "pos", "token", parts.alias("s")).where("token = s.t")
    ends = hits.groupBy("doc_id", (F.col("pos") + F.col("s.ahead")).alias("end")).agg(F.count(F.lit(1)).alias("n"))
    return ends.where(F.col("n") == len(phrase)).select("doc_id", (F.col("end") - 1).alias("pos"))


def phrase_state(corpus: DataFrame, states: DataFrame, phrase: Sequence[int], most: int | None = None) -> DataFrame:
    """``(j, x)``: mean state before the end of a phrase, over its first ``most`` occurrences (by document and position)."""
    found = phrase_ends(corpus, phrase)
    if most is not None:
        found = found.orderBy("doc_id", "pos").limit(most)
    long = states.join(found, ["doc_id", "pos"]).select(F.posexplode("h").alias("j", "x"))
    return long.groupBy("j").agg(F.avg("x").alias("x"))


def snippets(corpus: DataFrame, places: DataFrame, vocab: DataFrame, before: int, after: int) -> DataFrame:
    """``(doc_id, pos, context_before, focus, context_after)`` for ``places(doc_id, pos)``.

    Focus is the token at ``pos + 1``; before it stand the tokens
    ``pos + 1 - before .. pos``, after it ``pos + 2 .. pos + 1 + after``, as
    far as the document has them. Tokens without a string in ``vocab`` are
    left out.
    """
    wanted = places.select("doc_id", "pos").distinct()
    spread = wanted.select("doc_id", "pos", F.explode(F.sequence(F.lit(1 - before), F.lit(1 + after))).alias("o")).withColumn("at", F.col("pos") + F.col("o"))
    tokens = corpus.select("doc_id", F.col("pos").alias("at"), "token")
    named = spread.join(tokens, ["doc_id", "at"]).join(small(vocab.select("token", "str").where("str IS NOT NULL"), 64), "token")
    part = F.when(F.col("o") < 1, 0).when(F.col("o") == 1, 1).otherwise(2)

    def text(which: int):
        inside = F.sort_array(F.collect_list(F.when(part == which, F.struct("o", "str"))))
        return F.array_join(F.transform(inside, lambda s: s["str"]), " ")

    found = named.groupBy("doc_id", "pos").agg(text(0).alias("context_before"), text(1).alias("focus"), text(2).alias("context_after"))
    return wanted.join(found, ["doc_id", "pos"], "left").fillna("", ["context_before", "focus", "context_after"])


def labelled_places(corpus: DataFrame, places: DataFrame, vocab: DataFrame, context: int) -> DataFrame:
    """``(doc_id, pos, label)``: the ``context`` tokens that end with the predicted one, as text."""
    found = snippets(corpus, places, vocab, context - 1, 0)
    return found.select("doc_id", "pos", F.trim(F.concat_ws(" ", "context_before", "focus")).alias("label"))


def sampled(rows: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """A uniform sample of ``n`` rows without replacement: those of lowest hash of ``key``, in order of ``key``.

    The same for every partitioning; of fewer rows all are taken. The
    place of the last one is found among the hashes alone; rows are then
    filtered where they lie.
    """
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
    last = rows.select(digest.alias("__d"), *key).orderBy("__d", *key).offset(max(0, n - 1)).limit(1).select("__d").collect() if n > 0 else []
    if n <= 0:
        return rows.limit(0)
    if not last:
        return rows.orderBy(*key)
    near = rows.withColumn("__d", digest).where(F.col("__d") <= last[0]["__d"])
    # rows of the same key share a hash; more than n are left only if they tie with the last
    return near.orderBy("__d", *key).limit(n).drop("__d").orderBy(*key)


def valid_positions(lengths: DataFrame, least: int, forward: int) -> DataFrame:
    """``(doc_id, row, pos)`` of the positions whose window is whole: ``least <= pos < length - forward``; row 0 is the first."""
    span = F.sequence(F.lit(least).cast("bigint"), F.col("length") - forward - 1)
    inside = lengths.where(F.col("length") - forward - 1 >= least)
    return inside.select("doc_id", F.explode(span).alias("pos")).select("doc_id", (F.col("pos") - least).alias("row"), "pos")


def training_blocks(corpus: DataFrame, block: int, n: int) -> DataFrame:
    """``(doc_id, start, x, y)``: ``n`` blocks of ``block`` tokens, ``y`` one position further than ``x``.

    Starts are drawn uniformly by hash; blocks with a gap are left out.
    """
    ends = corpus.groupBy("doc_id").agg((F.max("pos") + 1).alias("length")).where(F.col("length") > block)
    starts = ends.select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - block - 1)).alias("start"))
    chosen = sampled(starts, ["doc_id", "start"], n)
    spread = chosen.select("doc_id", "start", F.explode(F.sequence(F.lit(0), F.lit(block))).alias("k")).withColumn("pos", F.col("start") + F.col("k"))
    held = spread.join(corpus.select("doc_id", "pos", "token"), ["doc_id", "pos"]).groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("k", "token"))).alias("l"))
    whole = held.where(F.size("l") == block + 1)
    return whole.select("doc_id", "start", F.slice("l.token", 1, block).alias("x"), F.slice("l.token", 2, block).alias("y"))


def in_windows(corpus: DataFrame, window: windowing.Window, column: str = "token") -> DataFrame:
    """``(doc_id, pos, tokens)``: what stands at the window's offsets of every whole position, in order of the offsets.

    Documents are cut into stretches of positions that overlap by the
    window, so that a document of any length takes many tasks, and each
    stretch is sorted once. Positions of which a neighbour is missing are
    left out.
    """
    stretch = F.shiftright("pos", STRETCH_BITS)
    spread = in_stretches(corpus.select("doc_id", "pos", F.col(column).alias("v")), window.backward, window.forward)
    order = Window.partitionBy("doc_id", "stretch").orderBy("pos")
    steps = [(k, o) for k, (o, _) in enumerate(window.offsets)]
    seen = spread.select(
        "doc_id", "pos", "stretch",
        *[(F.lead("pos", o).over(order) if o else F.col("pos")).alias(f"p{k}") for k, o in steps],
        *[(F.lead("v", o).over(order) if o else F.col("v")).alias(f"v{k}") for k, o in steps],
    )
    whole = F.col("stretch") == stretch
    for k, o in steps:
        whole = whole & (F.col(f"p{k}") == F.col("pos") + o)
    return seen.where(whole).select("doc_id", "pos", F.array(*[F.col(f"v{k}") for k, _ in steps]).alias("tokens"))


def window_average(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """``(doc_id, pos, v)``: weighted mean of the arrays ``rows(doc_id, pos, v)`` over the window of every whole position.

    Serves states and distributions. Sums divide by the total weight of the
    table; positions of which a neighbour is missing, or null, are left out,
    nothing is padded. Arrays are shuffled once and averaged by the batch.
    """
    ship(rows.sparkSession)
    window = windowing.resolve(offsets)
    weight = np.array([w for _, w in window.offsets]) / window.total
    # a window of n places holds n arrays a row, so that batches are cut by what they hold
    step = max(1, WINDOW_ROWS // len(weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                arrays = batch.column(2).flatten()
                n, d = batch.num_rows, len(arrays.flatten()) // max(1, len(arrays))
                x = arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, len(weight), d)
                mean = np.einsum("nkd,k->nd", x, weight)
                values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(mean.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values], names=["doc_id", "pos", "v"])

    seen = in_windows(rows.where("v IS NOT NULL"), window, "v")
    return seen.mapInArrow(run, "doc_id bigint, pos bigint, v array<double>")


def window_predictions(corpus: DataFrame, offsets: DataFrame, model: DataFrame) -> tuple[DataFrame, list[int]]:
    """``(doc_id, pos, p)`` and the tokens that ``p`` is about: predictions averaged over the window of every whole position.

    ``model(prev, token, p)`` predicts from the token at a position, so only
    tokens are brought together, and their distributions are looked up where
    they meet. The model is a row for each context; its size is checked, and
    above the bound distributions are joined to their positions and averaged
    by :func:`window_average` instead. Positions with a neighbour that has no
    prediction are left out.
    """
    ship(corpus.sparkSession)
    window = windowing.resolve(offsets)
    names = [r["token"] for r in model.select("token").distinct().orderBy("token").collect()]
    lists = model.groupBy("prev").agg(F.sort_array(F.collect_list(F.struct("token", "p"))).alias("l")).select("prev", F.col("l.p").alias("p"))
    most = BROADCAST_BYTES // (8 * max(1, len(names)))
    held = lists.limit(most + 1).toArrow()
    if held.num_rows > most:
        rows = corpus.select("doc_id", "pos", F.col("token").alias("prev")).join(lists, "prev").select("doc_id", "pos", F.col("p").alias("v"))
        return window_average(rows, offsets).withColumnRenamed("v", "p"), names
    context = held.column("prev").to_numpy()
    order = np.argsort(context)
    context, table = context[order], dense(held.column("p"))[order]
    weight = np.array([w for _, w in window.offsets]) / window.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token = dense_ints(batch.column(2), len(weight))
            at = np.minimum(np.searchsorted(context, token), max(0, len(context) - 1))
            good = (context[at] == token).all(1) if len(context) else np.zeros(len(token), bool)
            p = np.einsum("nko,k->no", table[at[good]], weight) if good.any() else np.zeros((0, len(names)))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * len(names)), pa.array(p.ravel()))
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), values], names=["doc_id", "pos", "p"])

    return in_windows(corpus, window).mapInArrow(run, "doc_id bigint, pos bigint, p array<double>"), names


def perplexity(probability: DataFrame) -> DataFrame:
    """One row ``(n, loss, perplexity)`` of ``(p, weight)``: mean negative logarithm of the probabilities of what came next."""
    mean = F.sum(-F.log(F.greatest("p", F.lit(1e-30))) * F.col("weight")) / F.sum("weight")
    return probability.agg(F.sum("weight").alias("n"), mean.alias("loss")).withColumn("perplexity", F.exp("loss"))
