"""Encoding of texts with a public byte-level BPE tokenizer (problem 6).

Batched numpy merge rounds: the symbols of many words stand in one flat
array; a round looks every neighbouring pair up by binary search over the
sorted pair keys, finds the lowest rank within each word and merges all
places of that pair, until no word has a pair left.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

# The pattern that splits text before the merges of byte_bpe_50k.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Where the vocabulary files lie unless the caller names another place.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

#: Words kept by a worker between batches; beyond it the store starts anew.
STORE_WORDS = 1_000_000

#: Characters of text encoded at once by a worker.
SLICE_CHARS = 4 << 20

_NONE = np.iinfo(np.int64).max


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table = {b: chr(b) for b in shown}
    extra = 256
    for b in range(256):
        if b not in table:
            table[b] = chr(extra)
            extra += 1
    return [table[b] for b in range(256)]


class Vocabulary:
    """The merge rules as sorted pair keys with their rank and merged id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, merges = model["vocab"], model["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        key = (left << 32) | right
        order = np.argsort(key, kind="stable")
        self.keys, self.rank, self.merged = key[order], order.astype(np.int64), merged[order]
        self.first = np.array([ids[c] for c in byte_characters()], np.int32)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each word has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols) > 1:
            key = (symbols[:-1].astype(np.int64) << 32) | symbols[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.rank[at], _NONE)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            spans = np.diff(np.r_[starts, len(word)])
            rank = np.append(rank, _NONE)
            lowest = np.minimum.reduceat(rank, starts)
            active = lowest != _NONE
            if not active.any():
                break
            chosen = (rank == np.repeat(np.where(active, lowest, -1), spans)).nonzero()[0]
            if len(chosen) > 1:  # of overlapping places every second one merges, from the left
                fresh = np.r_[True, np.diff(chosen) != 1]
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(chosen)), 0))
                chosen = chosen[(np.arange(len(chosen)) - run) % 2 == 0]
            symbols = symbols.copy()
            symbols[chosen] = self.merged[at[chosen]]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            live = np.repeat(active, spans)
            if not active.all():  # words without a pair leave the rounds
                done.append((word[~live], symbols[~live]))
                keep &= live
            symbols, word = symbols[keep], word[keep]
        done.append((word, symbols))
        words_of = np.concatenate([w for w, _ in done])
        flat = np.concatenate([s for _, s in done])
        order = np.argsort(words_of, kind="stable")
        return flat[order], np.bincount(words_of, minlength=len(words))


class _Index(dict):
    """Numbers words in the order they are first met."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class Encoder:
    """Encodes lists of texts; repeated words are encoded once per worker."""

    def __init__(self, path: str, store_words: int = STORE_WORDS):
        import regex

        self.vocabulary = Vocabulary(path)
        self.find = regex.compile(SPLIT).findall
        self.store_words = store_words
        self._reset()

    def _reset(self) -> None:
        self.index = _Index()
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self) -> None:
        if not (fresh := self.index.fresh):
            return
        ids, size = self.vocabulary.encode_words([w.encode("utf-8", "replace") for w in fresh])
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, ids])
        self.index.fresh = []

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offset of each text in it (one more than texts)."""
        if len(self.index) > self.store_words:
            self._reset()
        counts, words = np.zeros(len(texts), np.int64), []
        for i, text in enumerate(texts):
            if text:
                found = self.find(text)
                counts[i] = len(found)
                words.extend(found)
        code = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        self._learn()
        size = self.size[code]
        ends = np.r_[0, np.cumsum(size)]
        at = np.repeat(self.start[code] - ends[:-1], size) + np.arange(ends[-1])
        return self.flat[at], ends[np.r_[0, np.cumsum(counts)]]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin = chars = 0
    for i, text in enumerate(texts):
        chars += len(text or "")
        if chars >= SLICE_CHARS:
            yield begin, i + 1
            begin, chars = i + 1, 0
    if begin < len(texts) or not texts:
        yield begin, len(texts)


@lru_cache(maxsize=2)
def _encoder(vocabulary: str) -> Encoder:
    """The encoder of a Python worker: read once, its store of words serves all tasks of the worker."""
    return Encoder(vocabulary)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, counts_only: bool = False) -> DataFrame:
    """One row ``(id, ids)`` for each row of ``df``: the token ids of its text.

    No special tokens are added and strings that look like one are ordinary
    text; nothing is trimmed. A null and an empty text both give the empty
    list. A null id stays null, repeated rows stay repeated, an empty table
    gives none; columns other than the two named are not read, whatever
    their names. With ``counts_only`` the column is ``n_ids`` (BIGINT)
    instead, the length of the list. One pass without a shuffle; a text of
    any length is encoded whole.
    """
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    name = "n_ids" if counts_only else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                ids, offsets = encoder.encode(texts[a:b])
                if counts_only:
                    value = pa.array(np.diff(offsets))
                else:
                    value = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), value], names=[id_col, name])

    chosen = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    out = f"`{id_col}` {kind}, {name} {'bigint' if counts_only else 'array<int>'}"
    return chosen.mapInArrow(run, out)


def vocabulary_path(folder: str | None = None, name: str = "byte_bpe_50k.json") -> str:
    """The path of a vocabulary file in ``folder``, by default the folder of :data:`VOCABULARY`."""
    return os.path.join(folder or os.path.dirname(VOCABULARY), name)
