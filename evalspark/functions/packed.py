"""Words of many texts as one Arrow array, without a Python object per word.

Tables keep the words of a chunk packed: ``terms``, its distinct words with a blank between them, and
``counts``, how often each occurs, in the same order. No word is empty or holds a blank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _marks(characters: bytes) -> np.ndarray:
    marks = np.zeros(256, bool)
    marks[list(characters)] = True
    return marks


# The characters of ``text.TOKEN_BREAK``. All are ASCII, so no byte of a longer character is one.
BREAKS = _marks(b" \t\n\x0b\f\r.,;:!?")
BLANK = _marks(b" ")


def split_words(texts: pa.Array, breaks: np.ndarray = BLANK) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and all words in their order; a null has none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    if ends[0] == ends[-1]:
        return np.zeros(len(texts), np.int64), pa.array([], pa.string())
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends.astype(np.int64) - ends[0]
    outside = breaks[data]
    inside = ~outside
    first, last = inside.copy(), inside.copy()
    first[1:] &= outside[:-1]
    last[:-1] &= outside[1:]
    # A word ends with its text, whatever the next one begins with.
    full = ends[:-1] < ends[1:]
    first[ends[:-1][full]] = inside[ends[:-1][full]]
    last[ends[1:][full] - 1] = inside[ends[1:][full] - 1]
    starts = np.flatnonzero(first)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(np.flatnonzero(last) + 1 - starts, out=offsets[1:])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    return np.diff(np.searchsorted(starts, ends)), words


def joined(lengths: np.ndarray, words: pa.Array) -> pa.Array:
    """The texts whose words are the next ``lengths`` of ``words`` each, with a blank between them."""
    ends = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(ends, words), " ")


def numbers(counts: pa.Array) -> np.ndarray:
    return split_words(counts)[1].cast(pa.int64()).to_numpy()


def pack(words: Column) -> list[Column]:
    """``terms`` and ``counts`` of an ``array<struct<term,tf>>``."""
    counts = F.transform(words["tf"], lambda n: n.cast("string"))
    return [F.array_join(words["term"], " ").alias("terms"), F.array_join(counts, " ").alias("counts")]


def unpack(name: str, value) -> Column:
    """``array<struct<term, name>>`` of packed words, with ``value(count)`` as the second."""
    values = F.transform(F.split("counts", " "), lambda n: value(n.cast("long")))
    return F.arrays_zip(F.split("terms", " ").alias("term"), values.alias(name))
