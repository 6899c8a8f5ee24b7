"""Documents to chunks, and the numbering of chunks across documents.

A chunk table has ``experiment, doc_id, pos, chunk_text, char_count`` and the
columns its document carried. ``(doc_id, pos)`` orders chunks as the global
``chunk_index`` does, so no step needs the index before the result is shown.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from evalspark.session import stage
from evalspark.settings import SEPARATORS

BASE = "base"
# Buckets of the two-level running sum in chunk_offsets.
BUCKETS = 256
# Characters of the slices in which chunks leave a task.
SLICE = 1_000_000


def window_texts(text: Column, size: int, overlap: int) -> Column:
    """Array of character windows of ``size`` that start ``size - overlap`` apart.

    One regex pass: each match consumes a step and captures the window by looking
    ahead, where ``substring`` per window would rescan the text from its start.
    A rest no longer than the overlap already lies inside the window before it.
    """
    step = size - overlap
    if step < 1:
        raise ValueError(f"overlap {overlap} must be smaller than size {size}")
    pattern = rf"(?s)(?:\A|(?=.{{{overlap + 1}}}))(?=(.{{1,{size}}})).{{1,{step}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def window_count(text: Column, size: int, overlap: int) -> Column:
    """How many windows ``window_texts`` cuts, from the length alone: a further window starts
    while more than the overlap is left."""
    step = size - overlap
    if step < 1:
        raise ValueError(f"overlap {overlap} must be smaller than size {size}")
    length = F.coalesce(F.char_length(text), F.lit(0))
    more = F.greatest(F.lit(1), F.ceil((length - overlap) / step))
    return F.when(length == 0, 0).otherwise(more).cast("int")


def window_counts(
    docs: DataFrame, sizes: Sequence[tuple[str, int, int]] = ((BASE, 512, 64),), text: str = "text"
) -> DataFrame:
    """``experiment, doc_id, n`` for each ``(experiment, size, overlap)``, without cutting a window."""
    counts = F.array(
        *[
            F.struct(F.lit(name).alias("experiment"), window_count(F.col("text"), size, overlap).alias("n"))
            for name, size, overlap in sizes
        ]
    )
    return docs.select("doc_id", F.col(text).alias("text")).select("doc_id", F.inline(counts)).select("experiment", "doc_id", "n")


def chunk_windows(
    docs: DataFrame,
    sizes: Sequence[tuple[str, int, int]] = ((BASE, 512, 64),),
    text: str = "text",
) -> DataFrame:
    """Character windows for every ``(experiment, size, overlap)``, in one scan."""
    settings = F.array(
        *[
            F.struct(
                F.lit(name).alias("experiment"),
                window_texts(F.col(text), size, overlap).alias("texts"),
            )
            for name, size, overlap in sizes
        ]
    )
    kept = [c for c in docs.columns if c not in (text, "char_count")]
    # An empty text has no windows, so it needs no filter (which would move below
    # the spread of documents and clean every text there a second time).
    return (
        docs.select(*kept, F.explode(settings).alias("s"))
        .select("s.experiment", *kept, F.posexplode("s.texts").alias("pos", "chunk_text"))
        .withColumn("char_count", F.char_length("chunk_text"))
    )


def recursive_chunks(text: str, size: int, overlap: int, separators: Sequence[str]) -> Iterator[str]:
    """Chunks of one text, one by one: coarse separators first, finer ones where pieces stay too long."""
    found = next((i for i, s in enumerate(separators) if s in text), None)
    if found is None:
        if text.strip():
            yield text.strip()
        return
    finer, packer = separators[found + 1 :], _Packer(size, overlap)
    for piece in _pieces(text, separators[found]):
        if len(piece) < size:
            yield from packer.add(piece)
            continue
        yield from packer.rest()
        if finer:
            yield from recursive_chunks(piece, size, overlap, finer)
        elif piece.strip():
            yield piece.strip()
    yield from packer.rest()


def recursive_texts(text: str, size: int, overlap: int, separators: Sequence[str]) -> list[str]:
    return list(recursive_chunks(text, size, overlap, separators))


def _pieces(text: str, separator: str) -> Iterator[str]:
    """What lies between separators, each piece with the one before it; characters without one."""
    if not separator:
        yield from text
        return
    start, found = 0, text.find(separator)
    while found >= 0:
        if found > start:
            yield text[start:found]
        start, found = found, text.find(separator, found + len(separator))
    yield text[start:]


class _Packer:
    """Joins neighbouring pieces into chunks of at most ``size`` that share up to ``overlap``."""

    def __init__(self, size: int, overlap: int):
        self.size, self.overlap = size, overlap
        self.pieces: deque[str] = deque()
        self.total = 0

    def add(self, piece: str) -> Iterator[str]:
        if self.pieces and self.total + len(piece) > self.size:
            yield from self._joined()
            while self.pieces and (self.total > self.overlap or self.total + len(piece) > self.size):
                self.total -= len(self.pieces.popleft())
        self.pieces.append(piece)
        self.total += len(piece)

    def rest(self) -> Iterator[str]:
        yield from self._joined()
        self.pieces.clear()
        self.total = 0

    def _joined(self) -> Iterator[str]:
        chunk = "".join(self.pieces).strip()
        if chunk:
            yield chunk


def bounded(rows: Iterable, length: Callable) -> Iterator[list]:
    """Lists of neighbouring rows, each ended once it holds ``SLICE`` characters."""
    part, total = [], 0
    for row in rows:
        part.append(row)
        total += length(row)
        if total >= SLICE:
            yield part
            part, total = [], 0
    if part:
        yield part


def chunk_recursive(
    docs: DataFrame,
    sizes: Sequence[tuple[str, int, int]] = ((BASE, 512, 64),),
    separators: Sequence[str] = SEPARATORS,
    text: str = "text",
) -> DataFrame:
    """Recursive split for every ``(experiment, size, overlap)``.

    Only a document's text and its other columns cross into Python, in Arrow
    batches; each document is split on its own, so no shuffle is needed. Chunks leave in slices of
    some ``SLICE`` characters, so a task holds its texts and one slice. In SQL:
    ``functions.tables``.
    """
    for _, size, overlap in sizes:
        if overlap > size:
            raise ValueError(f"overlap {overlap} is larger than size {size}")
    kept = [f for f in docs.schema.fields if f.name not in (text, "char_count")]
    names = [f.name for f in kept]

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[int, str, int, str]]:
        for name, size, overlap in sizes:
            for row, value in enumerate(batch[text]):
                for pos, chunk in enumerate(recursive_chunks(value.as_py() or "", size, overlap, separators)):
                    yield row, name, pos, chunk

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            carried = batch.select(names)
            for part in bounded(rows(batch), lambda row: len(row[3])):
                row, name, pos, chunk = zip(*part)
                columns = [pa.array(name), *carried.take(pa.array(row)).columns, pa.array(pos, pa.int32()), pa.array(chunk)]
                yield pa.RecordBatch.from_arrays(columns, names=["experiment", *names, "pos", "chunk_text"])

    schema = T.StructType(
        [
            T.StructField("experiment", T.StringType()),
            *kept,
            T.StructField("pos", T.IntegerType()),
            T.StructField("chunk_text", T.StringType()),
        ]
    )
    return (
        docs.select(*names, text)
        .mapInArrow(split, schema)
        .withColumn("char_count", F.char_length("chunk_text"))
    )


def chunk_offsets(chunks: DataFrame, order: str = "doc_id") -> DataFrame:
    """``experiment, doc_id, first_index``: chunks that precede each document.

    A running sum in two levels. Documents fall into ordered buckets, cut at up
    to BUCKETS keys picked by hash; each bucket sums on its own, and the sums of
    the few buckets give each one its start. No task sees all documents, and any
    choice of cuts gives the same result.
    """
    return offsets_of_counts(chunks.groupBy("experiment", order).agg(F.count("*").alias("n")), order)


def offsets_of_counts(counts: DataFrame, order: str = "doc_id") -> DataFrame:
    """The same from ``experiment, <order>, n``."""
    counts = stage(counts, counts.sparkSession)
    # At most BUCKETS keys in one row.
    cuts = (
        counts.groupBy(F.pmod(F.xxhash64(order), F.lit(BUCKETS)).alias("h"))
        .agg(F.min(F.struct(F.xxhash64(order, F.lit(1)), order)).alias("pick"))
        .agg(F.array_sort(F.collect_set(f"pick.{order}")).alias("cuts"))
    )
    bucketed = counts.withColumn("cuts", cuts.scalar()).select(
        "experiment",
        order,
        "n",
        F.size(F.filter("cuts", lambda cut: cut <= F.col(order))).alias("bucket"),
    )
    starts = (
        bucketed.groupBy("experiment", "bucket")
        .agg(F.sum("n").alias("total"))
        .withColumn(
            "start",
            F.sum("total").over(W.partitionBy("experiment").orderBy("bucket")) - F.col("total"),
        )
        .select("experiment", "bucket", "start")
    )
    inside = W.partitionBy("experiment", "bucket").orderBy(order)
    return (
        bucketed.withColumn("before", F.sum("n").over(inside) - F.col("n"))
        .join(F.broadcast(starts), ["experiment", "bucket"])
        .select("experiment", order, (F.col("start") + F.col("before")).alias("first_index"))
    )


def with_chunk_index(chunks: DataFrame, offsets: DataFrame) -> DataFrame:
    """Add the global ``chunk_index``, from 0 in document order."""
    return chunks.join(offsets, ["experiment", "doc_id"]).withColumn(
        "chunk_index", F.col("first_index") + F.col("pos")
    ).drop("first_index")


def overlap_with_next(chunks: DataFrame, overlap: int) -> DataFrame:
    """Characters that each chunk shares with the next one of its document.

    Each chunk gives its last characters to its own position and its first ones to the
    position before; neighbours meet where both fall together. Texts are cut once, only their ends
    are shuffled, and a document with very many chunks is spread over tasks, as a window over
    it would not be.
    """
    own = F.struct("pos", F.right("chunk_text", F.lit(overlap)).alias("tail"), F.lit(None).cast("string").alias("head"))
    before = F.struct(
        (F.col("pos") - 1).alias("pos"), F.lit(None).cast("string").alias("tail"), F.left("chunk_text", F.lit(overlap)).alias("head")
    )
    ends = (
        chunks.select("experiment", "doc_id", F.inline(F.array(own, before)))
        .groupBy("experiment", "doc_id", "pos")
        .agg(F.max("tail").alias("tail"), F.max("head").alias("head"))
        .filter(F.col("tail").isNotNull() & F.col("head").isNotNull())
    )
    # Most neighbours share all of it; only the others are tried length by length.
    lengths = F.filter(
        F.sequence(F.lit(0), F.lit(overlap)), lambda n: F.right("tail", n) == F.left("head", n)
    )
    whole = (F.char_length("tail") == overlap) & (F.col("tail") == F.col("head"))
    return ends.select(
        "experiment",
        "doc_id",
        "pos",
        F.when(whole, overlap).otherwise(F.array_max(lengths)).alias("shared_chars"),
    )
