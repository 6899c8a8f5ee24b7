"""Scores of answered questions.

Records are ``experiment, qid, question, answer, contexts, ground_truth``; a score
table is ``experiment, qid, metric, score`` (long) or one column per metric (wide).
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from evalspark.functions.scores import band, bar, fixed, numeric
from evalspark.functions.text import claims, token_set, token_share, tokens
from evalspark.functions.vectors import dot
from evalspark.operators.answering import CONTEXT_BREAK, QUESTION
from evalspark.operators.embedding import Embed
from evalspark.settings import METRICS

SUPPORT = 0.8
STATISTICS = ("mean", "std", "min", "max")

# Scores that count as passed.
THRESHOLDS = {
    "faithfulness": 0.8,
    "answer_relevancy": 0.75,
    "context_precision": 0.7,
    "context_recall": 0.8,
}
# What to look at first when a mean is low.
ADVICE = {
    "faithfulness": "Answers say things that their contexts do not: look at the prompt and the writer first",
    "answer_relevancy": "Answers drift from the question: ask for shorter ones and pass on fewer contexts",
    "context_precision": "Contexts without use rank high: try other vectors, shorter chunks or more diversity",
    "context_recall": "The contexts lack needed facts: retrieve more or longer chunks, or add documents",
}
# What two metrics say together, as (metric, is low) pairs.
PATTERNS = (
    (("faithfulness", True), ("context_precision", False), "Good contexts are found and not used"),
    (("faithfulness", False), ("context_recall", True), "Answers keep to contexts that hold too little"),
    (("context_precision", True), ("context_recall", True), "The search finds neither enough nor the right chunks"),
)


def eval_records(records: DataFrame) -> DataFrame:
    """Records under the names that scorers of retrieval-based answers expect."""
    return records.select(
        *QUESTION,
        F.col("question").alias("user_input"),
        F.col("answer").alias("response"),
        F.col("contexts").alias("retrieved_contexts"),
        F.col("ground_truth").alias("reference"),
    )


def claim_table(records: DataFrame, sides: Sequence[str] = ("answer", "ground_truth")) -> DataFrame:
    """``experiment, qid, side, claim_no, claim, contexts``."""
    sided = F.explode(
        F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("text")) for s in sides])
    )
    return (
        records.select(*QUESTION, "contexts", sided.alias("s"))
        .select(*QUESTION, "contexts", "s.side", F.posexplode(claims(F.col("s.text"))).alias("claim_no", "claim"))
    )


def supported(claim: Column, context_words: Column, share: float = SUPPORT) -> Column:
    """Whether enough of the claim's words occur in the context; a claim of no words has none."""
    return F.coalesce(token_share(token_set(claim), context_words) >= share, F.lit(False))


def claim_verdicts(records: DataFrame, judge: Callable | None = None, share: float = SUPPORT) -> DataFrame:
    """``experiment, qid, side, claim_no, claim, supported``.

    ``judge(claim, context)`` is a column function; the words decide without one.
    """
    words = F.array_distinct(F.flatten(F.transform("contexts", tokens)))
    table = claim_table(records.withColumn("contexts", F.array_join("contexts", CONTEXT_BREAK) if judge else words))
    verdict = (
        judge(F.col("claim"), F.col("contexts"))
        if judge
        else supported(F.col("claim"), F.col("contexts"), share)
    )
    return table.select(*QUESTION, "side", "claim_no", "claim", verdict.alias("supported"))


def supported_share(verdicts: DataFrame, side: str, metric: str) -> DataFrame:
    return (
        verdicts.filter(F.col("side") == side)
        .groupBy(*QUESTION)
        .agg((F.sum(F.col("supported").cast("int")) / F.count("*")).alias("score"))
        .select(*QUESTION, F.lit(metric).alias("metric"), "score")
    )


def faithfulness(verdicts: DataFrame) -> DataFrame:
    """Supported claims of the answer / all its claims."""
    return supported_share(verdicts, "answer", "faithfulness")


def context_recall(verdicts: DataFrame) -> DataFrame:
    """Supported claims of the ground truth / all its claims."""
    return supported_share(verdicts, "ground_truth", "context_recall")


def relevance(records: DataFrame, judge: Callable | None = None, share: float = SUPPORT) -> DataFrame:
    """``experiment, qid, rank, relevant``: a context that supports a ground-truth claim.

    A question without contexts has one row, rank 1, that is not relevant.
    """
    rows = records.select(
        *QUESTION, "ground_truth", F.posexplode_outer("contexts").alias("at", "context")
    ).select(
        *QUESTION,
        F.coalesce(F.col("at") + 1, F.lit(1)).alias("rank"),
        F.col("at").isNotNull().alias("found"),
        F.col("context") if judge else token_set(F.col("context")).alias("context"),
        F.explode_outer(claims(F.col("ground_truth"))).alias("claim"),
    )
    verdict = (
        F.coalesce(judge(F.col("claim"), F.col("context")), F.lit(False))
        if judge
        else supported(F.col("claim"), F.col("context"), share)
    )
    return rows.groupBy(*QUESTION, "rank").agg(F.max(F.col("found") & verdict).alias("relevant"))


def context_precision(relevant: DataFrame) -> DataFrame:
    """Mean of precision@rank over the ranks that hold a relevant context; 0 without any.

    A window holds the k contexts of one question.
    """
    so_far = W.partitionBy(*QUESTION).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    hit = F.col("relevant").cast("int")
    return (
        relevant.withColumn("precision", F.sum(hit).over(so_far) / F.col("rank"))
        .groupBy(*QUESTION)
        .agg(F.coalesce(F.avg(F.when(F.col("relevant"), F.col("precision"))), F.lit(0.0)).alias("score"))
        .select(*QUESTION, F.lit("context_precision").alias("metric"), "score")
    )


def answer_relevancy(records: DataFrame, embed: Embed) -> DataFrame:
    """Mean cosine of the answer's claims, taken as questions, with the question."""
    candidates = claim_table(records.withColumn("contexts", F.lit(None)), ["answer"]).drop("contexts", "side")
    asked = embed(records.select(*QUESTION, "question"), ["qid"], "question")
    offered = embed(candidates, ["qid", "claim_no"], "claim")
    if isinstance(asked.schema["vector"].dataType.elementType, T.StructType):
        pairs = offered.select(*QUESTION, F.inline("vector").alias("term", "weight")).join(
            asked.select(*QUESTION, F.inline("vector").alias("term", "asked")), [*QUESTION, "term"]
        )
        cosine = F.col("weight") * F.col("asked")
    else:
        pairs = offered.join(asked.withColumnRenamed("vector", "asked"), QUESTION)
        cosine = dot(F.col("vector"), F.col("asked"))
    cosines = pairs.groupBy(*QUESTION).agg(F.sum(cosine).alias("total"))
    return (
        candidates.groupBy(*QUESTION)
        .agg(F.count("*").alias("n"))
        .join(cosines, QUESTION, "left")
        .select(
            *QUESTION,
            F.lit("answer_relevancy").alias("metric"),
            (F.coalesce("total", F.lit(0.0)) / F.col("n")).alias("score"),
        )
    )


# Metric name to its scorer of (records, embed, judge, share).
REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "faithfulness": lambda r, e, j, s: faithfulness(claim_verdicts(r, j, s)),
    "answer_relevancy": lambda r, e, j, s: answer_relevancy(r, e),
    "context_precision": lambda r, e, j, s: context_precision(relevance(r, j, s)),
    "context_recall": lambda r, e, j, s: context_recall(claim_verdicts(r, j, s)),
}


def known_metrics(names: Sequence[str]) -> list[str]:
    """Names that have a scorer; the others give a warning."""
    for name in names:
        if name not in REGISTRY:
            warnings.warn(f"Unknown metric '{name}', skipping it", stacklevel=2)
    return [name for name in names if name in REGISTRY]


def score_long(
    records: DataFrame,
    embed: Embed,
    metrics: Sequence[str] = METRICS,
    judge: Callable | None = None,
    share: float = SUPPORT,
) -> DataFrame:
    scored = [REGISTRY[m](records, embed, judge, share) for m in known_metrics(metrics)]
    if not scored:
        return records.select(
            *QUESTION, F.lit("").alias("metric"), F.lit(0.0).alias("score")
        ).filter(F.lit(False))
    return reduce(DataFrame.unionByName, scored)


def score_wide(records: DataFrame, scores: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row per question; a metric that could not be scored is null."""
    columns = known_metrics(metrics)
    pivoted = scores.groupBy(*QUESTION).pivot("metric", columns).agg(F.first("score"))
    return records.select(*QUESTION).join(pivoted, QUESTION, "left")


def aggregate_scores(wide: DataFrame, keys: Sequence[str] = ("experiment",)) -> DataFrame:
    """``<metric>_{mean,std,min,max}`` per key, over the score columns present.

    Text that is no number and NaN count as missing.
    """
    columns = [c for c in wide.columns if c in REGISTRY]
    values = wide.select(*keys, *[numeric(F.col(c)).alias(c) for c in columns])
    makers = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    statistics = [
        make(c).alias(f"{c}_{name}") for c in columns for name, make in makers.items()
    ]
    return values.groupBy(*keys).agg(*statistics)


def metric_statistics(aggregates: DataFrame, keys: Sequence[str] = ("experiment",)) -> DataFrame:
    """Aggregates as rows: ``*keys, metric, mean, std, min, max``; no row without a mean column."""
    present = [m for m in REGISTRY if f"{m}_mean" in aggregates.columns]
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                *[
                    (F.col(f"{m}_{s}") if f"{m}_{s}" in aggregates.columns else F.lit(None))
                    .cast(T.DoubleType())
                    .alias(s)
                    for s in STATISTICS
                ],
            )
            for m in present
        ]
    )
    return aggregates.select(*keys, F.inline(rows))


def score_report(statistics: DataFrame, keys: Sequence[str] = ("experiment",)) -> DataFrame:
    """The summary of a run: a bar and ``mean ± std`` per metric."""
    return statistics.select(
        *keys,
        "metric",
        bar(F.coalesce("mean", F.lit(0.0))).alias("bar"),
        F.concat(
            fixed(F.coalesce("mean", F.lit(0.0)), 4), F.lit(" ± "), fixed(F.coalesce("std", F.lit(0.0)), 4)
        ).alias("summary"),
    )


def score_bands(statistics: DataFrame, keys: Sequence[str] = ("experiment",)) -> DataFrame:
    """Band and pass mark of each mean."""
    limits = F.create_map(*[F.lit(x) for pair in THRESHOLDS.items() for x in pair])
    return statistics.select(
        *keys,
        "metric",
        "mean",
        band(F.col("mean")).alias("band"),
        (F.col("mean") >= limits[F.col("metric")]).alias("passed"),
    )


def diagnosis(aggregates: DataFrame, keys: Sequence[str] = ("experiment",)) -> DataFrame:
    """``*keys, finding, advice``: each low metric, and each pattern of two metrics."""

    def low(metric: str, wanted: bool) -> Column:
        mean = F.col(f"{metric}_mean")
        return mean < THRESHOLDS[metric] if wanted else mean >= THRESHOLDS[metric]

    findings = [
        F.when(low(m, True), F.struct(F.lit(f"low {m}").alias("finding"), F.lit(ADVICE[m]).alias("advice")))
        for m in METRICS
    ]
    for (a, a_low), (b, b_low), cause in PATTERNS:
        name = " + ".join(f"{'low' if is_low else 'high'} {m}" for m, is_low in ((a, a_low), (b, b_low)))
        findings.append(
            F.when(
                low(a, a_low) & low(b, b_low),
                F.struct(F.lit(name).alias("finding"), F.lit(cause).alias("advice")),
            )
        )
    return aggregates.select(*keys, F.explode(F.array_compact(F.array(*findings))).alias("f")).select(*keys, "f.*")
