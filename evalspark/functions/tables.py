"""Table functions for SQL.

    register(spark)
    SELECT doc_id, c.* FROM documents, LATERAL recursive_chunks(text, 512, 64) AS c

Rows cross one by one: Spark 4.1 takes no Arrow table function in a lateral join. For whole
tables ``operators.chunking.chunk_recursive`` moves the same chunks in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from evalspark.operators.chunking import recursive_chunks
from evalspark.settings import SEPARATORS

CHUNKS = "pos int, chunk_text string, char_count int"


class RecursiveChunks:
    """The recursive split of a text, with the default separators. A null text has no chunks."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str, int]]:
        if not 0 <= overlap <= size:
            raise ValueError(f"overlap {overlap} must lie in 0..size {size}")
        for pos, chunk in enumerate(recursive_chunks(text or "", size, overlap, SEPARATORS)):
            yield pos, chunk, len(chunk)


def register(spark: SparkSession) -> None:
    spark.udtf.register("recursive_chunks", udtf(RecursiveChunks, returnType=CHUNKS, useArrow=False))
