"""Vectors of texts: built-in TF-IDF, or a registered model behind the cache."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark import hooks
from evalspark.functions.vectors import as_double, normalize
from evalspark.operators.cache import KEY, keyed
from evalspark.operators.textsearch import text_vectors
from evalspark.session import stage
from evalspark.settings import Settings

TFIDF = "tfidf"
# (texts, keys, text column) -> experiment, *keys, vector
Embed = Callable[[DataFrame, list[str], str], DataFrame]


def embed_with(
    settings: Settings, terms: DataFrame, experiments: Sequence[str], cached: Callable[[DataFrame], DataFrame] | None = None
) -> Embed:
    """How texts of a run become vectors, under each of its experiments.

    ``cached`` gives ``model, text_sha, embedding`` of a table of texts, and embeds only those it lacks.
    """
    if settings.embedding_provider == TFIDF:
        return lambda texts, keys, text: text_vectors(texts, keys, text, terms)
    embed = hooks.embedder(settings.embedding_provider, model=settings.embedding_model)

    def dense(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
        if "experiment" not in texts.columns:
            texts = texts.withColumn("experiment", F.explode(F.array(*map(F.lit, experiments))))
        marked = keyed(texts, settings.embedding_model, text)
        once = marked.select(*KEY, F.col(text).alias("text")).dropDuplicates(KEY)
        vectors = cached(stage(once, once.sparkSession)) if cached else embed(once)
        return marked.join(vectors.select(*KEY, "embedding"), KEY).select(
            "experiment", *keys, normalize(as_double(F.col("embedding"))).alias("vector")
        )

    return dense
