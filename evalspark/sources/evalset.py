"""Evaluation questions with their ground truth."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Keys that every item must have.
REQUIRED = ("question", "ground_truth")


def load_eval_dataset(spark: SparkSession, path: str) -> DataFrame:
    """``qid, question, ground_truth, extra`` from a JSON array of objects."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"Evaluation dataset not found: {path}") from error
        raise
    items = raw.select(
        F.posexplode(F.from_json("value", "array<map<string,string>>", {"mode": "FAILFAST"})).alias(
            "item_id", "item"
        )
    )
    return check_items(items)


def check_items(items: DataFrame) -> DataFrame:
    """Fail on the first ``item_id, item`` map that lacks a required key."""
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), F.map_keys("item"))
    checked = items.withColumn("missing", missing)
    bad = checked.filter(F.size("missing") > 0).orderBy("item_id").select("item_id", "missing").head()
    if bad:
        raise ValueError(f"Item {bad.item_id} is missing required keys: {bad.missing}")
    return items.select(
        F.col("item_id").cast("bigint").alias("qid"),
        *[F.col("item")[key].alias(key) for key in REQUIRED],
        F.map_filter("item", lambda key, _: ~key.isin(*REQUIRED)).alias("extra"),
    )


def question_answer_pairs(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, question, ground_truth``: user turns and the assistant turn after.

    Turns meet on conversation and number, so a very long conversation is spread
    over tasks.
    """
    asked = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    replies = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ground_truth")
    )
    return asked.join(replies, ["conv_id", "turn"])
