"""Experiments that vary one setting, as rows of one job."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import time
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark import hooks
from evalspark.functions.scores import fixed, metric_label
from evalspark.operators import metrics
from evalspark.operators.answering import QUESTION
from evalspark.operators.embedding import embed_with
from evalspark.plans.rag import answer_all, retrieve, score, with_text
from evalspark.session import stage
from evalspark.settings import CHUNK_SIZES, K_VALUES, Settings, sweep_overlap
from evalspark.sources.tables import exists, load_or_build_index, text_mark, through_cache

SCORES = (*QUESTION, "metric", "score")
LEDGER = "run string, experiment string, finished double"
SWEPT = ("chunk_size", "chunk_overlap", "k", "search_type", "fetch_k", "lambda_mult")


def sweep_settings(spark: SparkSession, base: Settings, variants: Sequence[dict]) -> DataFrame:
    """``experiment, param_name, param_value`` and the settings each experiment runs with.

    A variant is ``{"experiment", "param_name", "param_value", "overrides"}``.
    """
    rows = []
    for v in variants:
        settings = base.variant(v["overrides"])
        rows.append(
            (v["experiment"], v["param_name"], str(v["param_value"]), *[getattr(settings, n) for n in SWEPT])
        )
    return spark.createDataFrame(
        rows,
        "experiment string, param_name string, param_value string, chunk_size int, chunk_overlap int, "
        "k int, search_type string, fetch_k int, lambda_mult double",
    )


def chunk_size_variants(sizes: Sequence[int] = CHUNK_SIZES) -> list[dict]:
    return [
        {
            "experiment": f"chunk_size_{size}",
            "param_name": "chunk_size",
            "param_value": size,
            "overrides": {"chunking.chunk_size": size, "chunking.chunk_overlap": sweep_overlap(size)},
        }
        for size in sizes
    ]


def k_variants(values: Sequence[int] = K_VALUES) -> list[dict]:
    return [
        {
            "experiment": f"retrieval_k_{k}",
            "param_name": "retrieval_k",
            "param_value": k,
            "overrides": {"retriever.k": k},
        }
        for k in values
    ]


def labelled(table: DataFrame, variants: Sequence[dict]) -> DataFrame:
    """Add ``param_name`` and ``param_value`` by experiment."""
    value = F.create_map(*[F.lit(x) for v in variants for x in (v["experiment"], str(v["param_value"]))])
    name = F.create_map(*[F.lit(x) for v in variants for x in (v["experiment"], v["param_name"])])
    return table.withColumns(
        {"param_name": name[F.col("experiment")], "param_value": value[F.col("experiment")]}
    )


def chunk_size_scores(
    docs: DataFrame, items: DataFrame, base: Settings, sizes: Sequence[int] = CHUNK_SIZES, root: str | None = None, corpus: str | None = None,
    judge: str | None = None,
) -> DataFrame:
    """Scores of every chunk size. All sizes are cut in one scan and searched in one job."""
    variants = chunk_size_variants(sizes)
    runs = [(v["experiment"], base.variant(v["overrides"])) for v in variants]
    index = load_or_build_index(docs, runs, root, corpus=corpus)
    hits = with_text(retrieve(items, index, base), index)
    return score(answer_all(items, hits, [name for name, _ in runs], base), index, base, judge)


def hits_by_k(hits: DataFrame, k_column: Column) -> DataFrame:
    """Each hit under every k that its rank is within; one search serves all."""
    return (
        hits.withColumn("k", F.explode(k_column))
        .filter(F.col("rank") <= F.col("k"))
        .withColumn("experiment", F.concat(F.lit("retrieval_k_"), F.col("k")))
        .drop("k")
    )


def k_scores(
    docs: DataFrame, items: DataFrame, base: Settings, values: Sequence[int] = K_VALUES, root: str | None = None, corpus: str | None = None,
    judge: str | None = None,
) -> DataFrame:
    """Scores of every k, from one index and one search at the largest k.

    MMR is greedy, so its first picks for a large k are its picks for a small one.
    """
    index = load_or_build_index(docs, [("base", base)], root, corpus=corpus)
    most = base.variant({"retriever.k": max(values)})
    hits = stage(with_text(retrieve(items, index, most), index), docs.sparkSession)
    by_k = hits_by_k(hits, F.array(*map(F.lit, values)))
    names = [v["experiment"] for v in k_variants(values)]
    # Words are weighed as in the one index that all experiments share.
    shared = index.terms.drop("experiment").withColumn(
        "experiment", F.explode(F.array(*map(F.lit, names)))
    )
    records = stage(answer_all(items, by_k, names, base), docs.sparkSession)
    cached = (lambda texts: through_cache(texts, "text", base, index.cache)) if index.cache else None
    embed = embed_with(base, shared, names, cached)
    return metrics.score_long(records, embed, base.metrics, hooks.judge(judge) if judge else None, base.support_threshold)


def embedding_variants(models: Sequence[dict]) -> list[dict]:
    """``models`` are dicts with ``name``, ``provider`` and ``model_name``."""
    return [
        {
            "experiment": f"embedding_{m['name']}",
            "param_name": "embedding_model",
            "param_value": m["model_name"],
            "overrides": {"embedding.provider": m["provider"], "embedding.model_name": m["model_name"]},
        }
        for m in models
    ]


def embedding_scores(
    docs: DataFrame, items: DataFrame, base: Settings, models: Sequence[dict], root: str | None = None, corpus: str | None = None,
    judge: str | None = None,
) -> DataFrame:
    """Scores of every embedding model; each model has an index of its own."""
    scores = [experiment_scores(docs, items, base, v, root, corpus, judge) for v in embedding_variants(models)]
    return reduce(DataFrame.unionByName, scores)


def experiment_scores(
    docs: DataFrame, items: DataFrame, base: Settings, variant: dict, root: str | None = None, corpus: str | None = None,
    judge: str | None = None,
) -> DataFrame:
    """Scores of one experiment, with an index of its own."""
    settings = base.variant(variant["overrides"])
    index = load_or_build_index(docs, [(variant["experiment"], settings)], root, corpus=corpus)
    hits = with_text(retrieve(items, index, settings), index)
    return score(answer_all(items, hits, index.experiments, settings), index, settings, judge)


def resumable_scores(
    docs: DataFrame, items: DataFrame, base: Settings, variants: Sequence[dict], folder: str, root: str | None = None,
    corpus: str | None = None, judge: str | None = None,
) -> DataFrame:
    """Scores of all ``variants``, one after the other, each kept in ``folder`` as soon as it is made.

    For sweeps whose answers or judges cost money or hours. A sweep that failed, called again with
    the same folder, starts at the experiment it failed in; an experiment counts as the same if
    corpus, questions, all its settings and the judge are the same. ``folder/scores`` has a partition
    per run, replaced as a whole if a run is made again; ``folder/ledger`` names the finished
    runs, written after their scores, so half a run is never read. Sweeps that share a folder
    have to follow one another.
    """
    spark = docs.sparkSession
    corpus = corpus or text_mark(docs)
    asked = text_mark(items)
    runs = {}
    for v in variants:
        named = [corpus, asked, v["experiment"], dataclasses.asdict(base.variant(v["overrides"])), judge]
        runs[hashlib.sha256(json.dumps(named).encode()).hexdigest()] = v
    finished = finished_runs(spark, folder)
    for run, v in runs.items():
        if run in finished:
            continue
        scores = experiment_scores(docs, items, base, v, root, corpus, judge)
        (
            scores.select(*SCORES)
            .withColumn("run", F.lit(run))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run")
            .parquet(f"{folder}/scores")
        )
        done = spark.createDataFrame([(run, v["experiment"], time.time())], LEDGER)
        done.coalesce(1).write.mode("append").parquet(f"{folder}/ledger")
    return spark.read.parquet(f"{folder}/scores").filter(F.col("run").isin(*runs)).select(*SCORES)


def finished_runs(spark: SparkSession, folder: str) -> set[str]:
    """A row per experiment ever finished here, a handful."""
    if not exists(spark, f"{folder}/ledger"):
        return set()
    return {row.run for row in spark.read.schema(LEDGER).parquet(f"{folder}/ledger").select("run").distinct().collect()}


def experiment_summary(scores: DataFrame, variants: Sequence[dict]) -> DataFrame:
    """One row per experiment: its parameter and all ``<metric>_<stat>``."""
    wide = scores.groupBy(*QUESTION).pivot("metric", list(metrics.REGISTRY)).agg(F.first("score"))
    return labelled(metrics.aggregate_scores(wide), variants)


def stack_summaries(summaries: Sequence[DataFrame]) -> DataFrame:
    """Summaries below each other; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), summaries)


def param_series(summary: DataFrame) -> DataFrame:
    """Numbers behind the comparison charts; what is missing counts as 0."""
    keys = ["param_name", "param_value", "experiment"]
    return metrics.metric_statistics(summary, keys).select(
        *keys,
        metric_label(F.col("metric")).alias("label"),
        "metric",
        F.coalesce("mean", F.lit(0.0)).alias("mean"),
        F.coalesce("std", F.lit(0.0)).alias("std"),
        fixed(F.coalesce("mean", F.lit(0.0)), 3).alias("mean_label"),
    )


def metric_matrix(summary: DataFrame) -> DataFrame:
    """Numbers behind the heat map: experiment by metric; what is missing stays null."""
    return (
        metrics.metric_statistics(summary, ["experiment"])
        .groupBy("experiment")
        .pivot("metric", list(metrics.REGISTRY))
        .agg(F.first("mean"))
    )
