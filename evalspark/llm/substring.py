"""Substring dedup: an FM-index per shard finds word windows that stand earlier elsewhere.

Documents are not run against an index of everything: ``repeats`` brings windows that can
be equal to one shard, by content, so each shard has its own bounded index and the work
grows with the input. In a shard all windows are searched backwards in step; the rows of a
full-length match are the equal windows, and the earliest place among them stays.

Defined cases: null and empty texts have no words and keep nothing; texts under ``width``
words lose nothing; a null ``doc_id`` is after all others; rows that repeat an id and text
are judged alike; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from evalspark.llm import repeats
from evalspark.llm.fmindex import FMIndex, matching
from evalspark.llm.words import split_words

WIDTH = 20
GRAM = 6
SHARD_WORDS = 1_000_000

_HASHES: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A number per word; equal words have equal numbers (kept per worker, emptied when large)."""
    if len(_HASHES) > 500_000:
        _HASHES.clear()
    known = _HASHES.get
    out = [known(w) for w in words]
    if None in out:
        for i, x in enumerate(out):
            if x is None:
                out[i] = _HASHES[words[i]] = xxhash.xxh64_intdigest(words[i])
    return np.array(out, np.uint64)


def kind(width: int = WIDTH, gram: int = GRAM) -> repeats.Kind:
    return repeats.Kind(width, min(gram, width), split_words, word_hashes, b" ".join)


def earlier_windows(segments: list[list[bytes]], sizes: np.ndarray, order: np.ndarray, width: int) -> list[np.ndarray]:
    """For each window of each segment: does an equal one have a smaller place?"""
    numbers: dict[bytes, int] = {}
    text = [0]
    at = np.zeros(len(segments), np.int64)
    for i, words in enumerate(segments):
        at[i] = len(text)
        text += [numbers.setdefault(w, len(numbers) + 1) for w in words]
        text.append(0)
    text = np.array(text, np.int64)
    index = FMIndex(text, 2 * width)
    which = np.repeat(np.arange(len(segments)), sizes)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    start = at[which] + offset
    place = np.full(len(text), np.iinfo(np.int64).max)
    place[start] = order[which] + offset
    ends, low, high = matching(index, text, start + width - 1, width)
    gone = np.zeros(len(text), bool)
    if len(ends):
        lows, own = np.unique(low, return_inverse=True)
        highs = np.zeros_like(lows)
        highs[own] = high
        bounds = np.stack((lows, highs), 1).ravel()
        by_row = np.append(place[index.order], np.iinfo(np.int64).max)
        first = np.minimum.reduceat(by_row, bounds)[::2]
        begin = ends - width + 1
        gone[begin] = place[begin] > first[own]
    return [gone[a : a + k] for a, k in zip(at, sizes)]


def substring_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc_id, n_words, n_removed, n_spans, kept_sha256`` for each row of ``docs``."""
    decided, _ = repeats.find(
        kind(width, gram), docs, lambda s, k, o, _: earlier_windows(s, k, o, width), shard_words
    )
    return decided.selectExpr("doc_id", "n AS n_words", "n_removed", "n_spans", "sha AS kept_sha256")
