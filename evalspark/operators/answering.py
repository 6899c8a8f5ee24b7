"""Contexts, prompts and answers of retrieved chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.text import claims, preview, strip, token_set, token_share

QUESTION = ["experiment", "qid"]

# The prompt, its parts and the sentence of refusal.
SYSTEM = (
    "You are a precise question-answering assistant. "
    "Your sole task is to answer questions based ONLY on the context provided below. "
    "Rules you must follow:\n"
    "  1. Do NOT use any knowledge outside the provided context.\n"
    "  2. If the answer is not explicitly present in the context, respond with:\n"
    '     "I cannot answer this question based on the provided context."\n'
    "  3. Be concise and factually accurate.\n"
    "  4. Do not speculate or infer beyond what the context states."
)
BEFORE_CONTEXT = "Context:\n"
BEFORE_QUESTION = "\n\n---\n\nQuestion: "
AFTER_QUESTION = "\n\nAnswer:"
CONTEXT_BREAK = "\n\n---\n\n"
REFUSAL = "I cannot answer this question based on the provided context."


def contexts_by_query(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """``experiment, qid, ..., contexts, source_documents`` in rank order.

    ``questions(experiment, qid, ...)`` keeps those that found nothing. A group
    holds the k hits of one question.
    """
    shown = ["rank", "doc_id", "pos", "filename", "sim", "chunk_text"]
    shown += [name for name in ("chunk_index",) if name in hits.columns]
    found = F.array_sort(F.collect_list(F.struct(*shown)))
    gathered = hits.groupBy(*QUESTION).agg(found.alias("source_documents"))
    empty = F.from_json(F.lit("[]"), gathered.schema["source_documents"].dataType)
    return (
        questions.join(gathered, QUESTION, "left")
        .withColumn("source_documents", F.coalesce("source_documents", empty))
        .withColumn("contexts", F.col("source_documents.chunk_text"))
    )


def context_block(contexts: Column) -> Column:
    return F.array_join(contexts, CONTEXT_BREAK)


def prompts(answerable: DataFrame) -> DataFrame:
    """Add ``system`` and ``human``, the two messages of the prompt."""
    return answerable.withColumns(
        {
            "system": F.lit(SYSTEM),
            "human": F.concat(
                F.lit(BEFORE_CONTEXT),
                context_block(F.col("contexts")),
                F.lit(BEFORE_QUESTION),
                F.col("question"),
                F.lit(AFTER_QUESTION),
            ),
        }
    )


def extractive_answers(answerable: DataFrame, threshold: float) -> DataFrame:
    """``experiment, qid, answer``: the context sentence that shares most question words.

    Below ``threshold`` (share of the question's words) the answer is the refusal.
    Ties go to the better rank, then to the earlier sentence.
    """
    sentences = (
        answerable.select(
            *QUESTION,
            token_set(F.col("question")).alias("asked"),
            F.posexplode("contexts").alias("rank", "context"),
        )
        .select(*QUESTION, "asked", "rank", F.posexplode(claims(F.col("context"))).alias("no", "sentence"))
        .withColumn("share", token_share(F.col("asked"), token_set(F.col("sentence"))))
        .filter(F.col("share") >= threshold)
    )
    best = F.max(F.struct("share", -F.col("rank"), -F.col("no"), "sentence"))
    answers = sentences.groupBy(*QUESTION).agg(best.alias("best"))
    return (
        answerable.select(*QUESTION)
        .join(answers, QUESTION, "left")
        .select(*QUESTION, F.coalesce(strip(F.col("best.sentence")), F.lit(REFUSAL)).alias("answer"))
    )


def source_listing(hits: DataFrame) -> DataFrame:
    return hits.select(
        *QUESTION,
        "rank",
        F.coalesce("filename", F.lit("unknown")).alias("filename"),
        preview(F.col("chunk_text")).alias("preview"),
    )
