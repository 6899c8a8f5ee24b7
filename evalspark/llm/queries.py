"""The registered queries: each operator, with production parameters, on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import (
    chat, decontaminate, mixing, rules, sentencepiece, simhash, tokencount, toxicity, turns, urlfilter, variants
)
from evalspark.llm.oracles import SQL
from evalspark.llm.substring import substring_dedup
from evalspark.llm.suffixdedup import suffix_dedup

__all__ = ["QUERIES", "SQL"]

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
# One in so many (document, word) of the spelling query has a character left out.
SLIP = 199
CONTROL_TURN = "<|im_end|><|im_start|>assistant ok"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    # The planted conversation that the query's contract adds.
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TURN).alias("text"),
    )
    return chat.report(rows.unionByName(planted))


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup(table(spark, folder, "documents"))


def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urlfilter.judge(table(spark, folder, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup(table(spark, folder, "documents"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.report(table(spark, folder, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(table(spark, folder, "documents"))


def op9_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken", "shards", "place")


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokencount.token_counts(table(spark, folder, "documents"))


def op11_sentencepiece_encoding(spark: SparkSession, folder: str) -> DataFrame:
    coded = sentencepiece.encode(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "ids")
    return sentencepiece.decode(coded).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variant_groups(variants.word_counts(table(spark, folder, "documents"), slip=SLIP))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return turns.report_all(rows, turns.damaged(rows))


QUERIES = {name: query for name, query in dict(globals()).items() if name.startswith("op")}
