"""Documents to a training mix: five stages, each written as Parquet and read by the next.

1. ``toxicity``: documents with a toxicity score of 0.3 or more go.
2. ``near_dedup``: of documents that hang together by a Jaccard similarity of five-word shingles
   of 0.8 or more, found by their fingerprints, the one with the smallest id stays.
3. ``repeats``: bytes covered by a 100-byte string that stands earlier are cut; a text of which nothing is left goes.
4. ``decontamination``: stretches covered by 10-word windows of benchmark items are cut; a
   document that is leaked for over half of its words goes.
5. ``mix``: the rest, with the words taken of each document for the target mix, its shards
   and its place in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalspark.llm import decontaminate, mixing, similar, suffixdedup, toxicity
from evalspark.session import ship, stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return similar.one_of_each_group(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return suffixdedup.without_repeats(docs)


def cut_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.cut_spans(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("repeats", cut_repeats),
    ("decontamination", cut_leaks),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), spark)
    return STAGES[-1][1](spark, docs, sf_dir)


# Learned weights and XXH64 fingerprints are not expressible; brute force in tests/llm instead.
ORACLE_SQL = None
