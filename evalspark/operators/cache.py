"""Embedding cache: a table ``model, text_sha, embedding``.

The model is part of the key, so that one model never gets another one's vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.text import text_sha

KEY = ["model", "text_sha"]
SCHEMA = "model string, text_sha string, embedding array<float>"


def keyed(texts: DataFrame, model: str, text: str = "text") -> DataFrame:
    return texts.withColumns({"model": F.lit(model), "text_sha": text_sha(F.col(text))})


def cache_hits(texts: DataFrame, cache: DataFrame) -> DataFrame:
    return texts.join(cache.select(*KEY), KEY, "left_semi")


def cache_misses(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """Every text that must be embedded, once: copies go before the shuffle of the join."""
    return (
        texts.select(*KEY, text).dropDuplicates(KEY).join(cache.select(*KEY), KEY, "left_anti")
    )


def embed_with_cache(
    texts: DataFrame,
    cache: DataFrame,
    embedder: Callable[[DataFrame], DataFrame],
    model: str,
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """All texts with their ``embedding``, and the new cache rows.

    ``embedder`` adds an ``embedding`` column. One text may make up a large part
    of the rows: the vectors have one row per text, so AQE can split the big side.
    """
    texts = keyed(texts, model, text)
    new = embedder(cache_misses(texts, cache, text)).select(
        *KEY, F.col("embedding").cast("array<float>").alias("embedding")
    )
    known = cache.select(*KEY, "embedding").unionByName(new)
    return texts.join(known, KEY, "left"), new
