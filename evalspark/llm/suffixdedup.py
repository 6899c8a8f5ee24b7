"""Suffix-array dedup of bytes: the suffix order of a shard puts equal windows side by side.

``repeats`` brings the byte windows that can be equal to one shard, by content; ``lyndon``
orders the suffixes of the shard in linear time, with phrases (a word and the space behind
it) as symbols where they are short, else with bytes. Neighbours in that order are compared
byte by byte, and of equal windows the earliest place stays.

Defined cases: null texts are empty; texts under ``width`` bytes lose nothing; a null
``doc_id`` is after all others; rows that repeat an id and text are judged alike; other
columns, whatever their names, are not read, and carried by ``without_repeats``. Where a cut splits a character of several
bytes, ``text`` loses the rest of that character; digests are of the bytes.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm import repeats
from evalspark.llm.lyndon import suffix_array
from evalspark.llm.words import LAST, carrying

WIDTH = 100
GRAM = 40
# Bytes of a shard; some 500 bytes of memory each while it is ordered.
SHARD_BYTES = 400_000
# Windows that are compared at once.
BLOCK = 1 << 15

# A number for each byte value, from a rule.
_TABLE = repeats.mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_hashes(data: bytes) -> np.ndarray:
    return _TABLE[np.frombuffer(data, np.uint8)]


def kind(width: int = WIDTH, gram: int = GRAM) -> repeats.Kind:
    return repeats.Kind(width, min(gram, width), bytes, byte_hashes, bytes)


_PHRASE = re.compile(rb"[^ \t-\r]*[ \t-\r]|[^ \t-\r]+")
# Bytes of a phrase at most; segments with longer ones are ordered byte by byte.
PHRASE = 48


def first_of_each(classes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each element, the smallest place of its class."""
    order = np.argsort(classes, kind="stable")
    row = classes[order]
    new = np.concatenate(([True], row[1:] != row[:-1]))
    first = np.minimum.reduceat(place[order], np.flatnonzero(new))
    out = np.empty_like(place)
    out[order] = first[np.cumsum(new) - 1]
    return out


def neighbours(view: np.ndarray, row: np.ndarray, width: int) -> np.ndarray:
    """Symbols that each ``view[row[i]]`` shares with the one before it, at most ``width``; first: 0."""
    out = np.zeros(len(row), np.int16)
    for a in range(1, len(row), BLOCK):
        b = min(a + BLOCK, len(row))
        other = view[row[a:b]] != view[row[a - 1 : b - 1]]
        out[a:b] = np.where(other.any(1), other.argmax(1), width)
    return out


def by_bytes(segments: list[bytes], sizes: np.ndarray, order: np.ndarray, width: int) -> list[np.ndarray]:
    """For each window of each segment: does an equal one have a smaller place? Any bytes."""
    at, body, start, place = laid_out(segments, sizes, order)
    windows = np.zeros(len(body) + 1, bool)
    windows[start] = True
    row = suffix_array(np.append(body, 0))
    row = row[windows[row]]
    shared = neighbours(np.lib.stride_tricks.sliding_window_view(body, width), row, width)
    own = np.empty(len(body), np.int64)
    own[start] = place
    first = first_of_each(np.cumsum(shared < width), own[row])
    gone = np.zeros(len(body), bool)
    gone[row] = own[row] > first
    return [gone[a : a + k] for a, k in zip(at, sizes)]


def laid_out(segments: list[bytes], sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(begin of each segment, symbols with 1 between, start and place of each window)``."""
    lengths = np.array([len(x) for x in segments])
    at = np.cumsum(lengths + 1) - lengths - 1
    body = np.frombuffer(b"\0".join(segments), np.uint8).astype(np.int16) + 2
    body[at[1:] - 1] = 1
    which = np.repeat(np.arange(len(segments)), sizes)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return at, body, at[which] + offset, order[which] + offset


def by_phrases(segments: list[bytes], sizes: np.ndarray, order: np.ndarray, width: int) -> list[np.ndarray]:
    """The same for segments of short phrases, each non-spaces and the space behind them.

    No phrase begins another, so the order of phrase numbers is the order of the bytes. A
    window is the end of a phrase and ``width`` less that many bytes from the next phrase
    on. Windows are equal if suffixes at that next phrase share those bytes, which the
    suffix order of the phrases tells, and the ends of the phrases before are equal, which
    the order of the phrases by their reversed bytes tells.
    """
    at, body, start, place = laid_out(segments, sizes, order)
    parts = [_PHRASE.findall(x) for x in segments]
    names = sorted(set().union(*parts))
    number = {p: i for i, p in enumerate(names, 2)}
    sequence: list[int] = []
    for x in parts:
        sequence += [number[p] for p in x]
        sequence.append(1)
    sequence[-1] = 0
    sequence = np.array(sequence)
    length = np.append(np.array([0, 0] + [len(p) for p in names]), 0)
    begin = np.cumsum(np.where(sequence > 1, length[sequence], 1))
    begin = np.concatenate(([0], begin[:-1]))
    phrases = np.flatnonzero(sequence > 1)
    row = suffix_array(sequence)
    row = row[sequence[row] > 1]
    padded = np.concatenate((body, np.zeros(width, np.int16)))
    shared = neighbours(np.lib.stride_tricks.sliding_window_view(padded, width), begin[row], width)
    rank = np.empty(len(sequence), np.int64)
    rank[row] = np.arange(len(row))
    backward = np.array([p[::-1] for p in names], f"S{PHRASE}")
    by_end = np.argsort(backward, kind="stable")
    ends = neighbours(backward.view(np.uint8).reshape(len(names), PHRASE), by_end, PHRASE)
    end_rank = np.empty(len(names) + 2, np.int64)
    end_rank[by_end + 2] = np.arange(len(names))
    # The next phrase behind the start of each window, and the bytes up to it.
    following = phrases[np.searchsorted(begin[phrases], start, side="right")]
    left = begin[following] - start
    gone = np.zeros(len(body), bool)
    for size in np.unique(left).tolist():
        mine = np.flatnonzero(left == size)
        right_class = np.cumsum(shared < width - size)[rank[following[mine]]]
        left_class = np.cumsum(ends < size)[end_rank[sequence[following[mine] - 1]]]
        first = first_of_each(right_class * (len(names) + 1) + left_class, place[mine])
        gone[start[mine]] = place[mine] > first
    return [gone[a : a + k] for a, k in zip(at, sizes)]


def earlier_windows(segments: list[bytes], sizes: np.ndarray, order: np.ndarray, keys: list[int], width: int) -> list[np.ndarray]:
    """Equal windows have one key, so each key is ordered one way or the other."""
    if width <= 2 * PHRASE:
        return by_bytes(segments, sizes, order, width)
    long = {k for k, x in zip(keys, segments) if max(map(len, _PHRASE.findall(x)), default=0) > PHRASE}
    answer: list[np.ndarray] = [np.zeros(0, bool)] * len(segments)
    for method, wanted in ((by_bytes, True), (by_phrases, False)):
        mine = [i for i, k in enumerate(keys) if (k in long) == wanted]
        if mine:
            for i, mask in zip(mine, method([segments[i] for i in mine], sizes[mine], order[mine], width)):
                answer[i] = mask
    return answer


def find(docs: DataFrame, width: int, gram: int, shard_bytes: int, with_text: bool = False) -> tuple[DataFrame, DataFrame]:
    return repeats.find(kind(width, gram), docs, lambda s, k, o, keys: earlier_windows(s, k, o, keys, width), shard_bytes, with_text)


def suffix_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of ``docs``."""
    decided, _ = find(docs, width, gram, shard_bytes)
    return decided.selectExpr("doc_id", "n AS n_bytes", "n_removed", "n_spans", "sha AS kept_sha256")


@carrying("doc_id", "text", "n_chars")
def without_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with what is left of each ``text``; documents of which no byte is left go.

    All columns stay; ``n_chars``, where there is one, is counted anew.
    """
    decided, lost = find(docs, width, gram, shard_bytes, True)
    changed = decided.filter("n_removed > 0").select(
        F.col("did").alias("_did"), F.col("cid").alias("_cid"), F.col("n_removed").alias("_gone"), F.col("n").alias("_n")
    ).distinct()
    texts = lost.filter("n_removed > 0").select(F.col("cid").alias("_cid"), "kept").dropDuplicates(["_cid"])
    changed = changed.filter("_gone < _n").join(texts, "_cid").unionByName(
        changed.filter("_gone = _n").withColumn("kept", F.lit(None).cast("binary"))
    )
    did, cid = F.coalesce(docs["doc_id"], F.lit(LAST)), F.unhex(F.md5(F.coalesce(docs["text"], F.lit(""))))
    met = docs.join(changed, (did == changed["_did"]) & (cid == changed["_cid"]), "left")
    met = met.filter("_gone IS NULL OR _gone < _n")
    kept, untouched = F.col("kept").cast("string"), F.col("_gone").isNull()
    out = {"text": F.when(untouched, docs["text"]).otherwise(kept)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(untouched, docs["n_chars"]).otherwise(F.length(kept))
    return met.select(*(out.get(c, docs[c]).alias(c) for c in docs.columns))
