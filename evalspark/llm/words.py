"""Words and row helpers that several operators share."""

from __future__ import annotations

import ctypes
import functools
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.session import stage

# ASCII white space parts words, the rest is left as it is.
SPACES = " \t\n\x0b\x0c\r"
SPACE_WORD = r"[^\x20\x09-\x0D]+"

# Stands for a document without an id wherever documents are put in order: after all others.
LAST = 2**63 - 1

EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def split_words(data: bytes) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes (``bytes.split`` parts at exactly these)."""
    return data.split()


def n_words(text: str) -> Column:
    """Number of such words in a text column, null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of each text of an Arrow batch, null as empty."""
    data = batch.column(column)
    if not pa.types.is_binary(data.type) and not pa.types.is_large_binary(data.type):
        data = data.cast(pa.large_binary() if pa.types.is_large_string(data.type) else pa.binary())
    return [x or b"" for x in data.to_pylist()]


def in_slices(rows: Iterator[tuple], schema: pa.Schema, big: int | None = None, count: int = 2000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of the tuples, cut by rows and by the bytes held in column ``big``, so that
    memory stays bounded."""
    kept: list[tuple] = []
    held = 0
    for row in rows:
        kept.append(row)
        if big is not None:
            held += len(row[big])
        if len(kept) >= count or held >= size:
            yield to_batch(kept, schema)
            kept, held = [], 0
    if kept:
        yield to_batch(kept, schema)
    kept.clear()
    give_back()


def give_back() -> None:
    """Return unused memory to the system: workers live on between stages, and what they no
    longer use should not count against the executor."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_tidy(table: DataFrame, spark: SparkSession) -> DataFrame:
    """``stage``, and the shuffle files of that write go when it ends, not some time later:
    what follows reads the table."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return stage(table, spark)
    finally:
        spark.conf.set(CLEANUP, before)


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Arrow batches of this session hold at most so many rows and bytes or one row.

    By default they hold 10,000 rows however long, which for whole documents is tens of
    megabytes in each task, on both sides of the pipe.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def carrying(*needed: str, results: tuple[str, ...] = ()) -> Callable:
    """For an operator that gives its input back: it sees the columns ``needed`` only, the others
    are packed into one, so their names cannot meet those it uses. Input columns named as
    ``results`` give way to these."""

    def wrapped(operator: Callable) -> Callable:
        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            columns = [c for c in docs.columns if c not in results]
            others = [c for c in columns if c not in needed]
            packed = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(None)
            mine = [c for c in columns if c in needed]
            out = operator(docs.select(*mine, packed.alias("_carried")), *args, **kwargs)
            made = [F.col(c) for c in out.columns if c not in (*mine, "_carried")]
            back = (F.col(c) if c in mine else F.col("_carried").getField(c).alias(c) for c in columns)
            return out.select(*back, *made)

        return run

    return wrapped
