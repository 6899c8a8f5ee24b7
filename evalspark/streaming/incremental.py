"""New documents as they arrive: into the embedding cache, or into a whole index."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evalspark.functions.text import clean_text
from evalspark.operators.cache import cache_misses, keyed
from evalspark.operators.chunking import chunk_recursive
from evalspark.settings import Settings
from evalspark.sources.tables import append_cache, load_cache, update_index


def embed_stream(
    docs: DataFrame,
    embedder: Callable[[DataFrame], DataFrame],
    model: str,
    cache_path: str,
    checkpoint: str,
    settings: Settings | None = None,
) -> StreamingQuery:
    """Process what has arrived in ``docs(doc_id, text, ...)`` and stop.

    A batch that is run again after a failure finds its rows in the cache, so
    nothing is embedded or stored twice.
    """
    settings = settings or Settings()
    cleaned = docs.withColumn("text", clean_text(F.col("text")))
    size = [("base", settings.chunk_size, settings.chunk_overlap)]

    def add(batch: DataFrame, _: int) -> None:
        chunks = chunk_recursive(batch, size, settings.separators)
        cache = load_cache(batch.sparkSession, cache_path)
        misses = cache_misses(keyed(chunks, model, "chunk_text"), cache, "chunk_text")
        append_cache(embedder(misses), cache_path)

    return (
        cleaned.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def index_stream(
    docs: DataFrame, runs: Sequence[tuple[str, Settings]], root: str, checkpoint: str
) -> StreamingQuery:
    """Put what has arrived in ``docs(doc_id, text, filename, ...)`` into the index of ``root`` and stop.

    A document that comes again in a later batch takes the place of its earlier form; one whose text
    is null or blank has no chunks left. Rows of one id in one batch are all kept. Each batch is one index, named by the stream and its number, so a
    batch that is run again after a failure finds what it made. ``newest_index`` reads the last.
    """
    cleaned = docs.withColumn("text", clean_text(F.col("text")))

    def add(batch: DataFrame, number: int) -> None:
        update_index(batch, runs, root, f"{checkpoint} {number}")

    return (
        cleaned.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
