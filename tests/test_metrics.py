import math
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalspark import hooks
from evalspark.operators import answering, metrics

RECORD = "experiment string, qid bigint, question string, answer string, contexts array<string>, ground_truth string"


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        # One of two answer claims and both truth claims are in the contexts; ranks 1 and 3 are relevant.
        ("e", 0, "q", "Cats purr. Moons sing loudly.", ["cats purr", "nothing here", "dogs bark"], "Cats purr. Dogs bark."),
        ("e", 1, "q", "Stones fall.", ["other words"], "Truth differs."),
        ("e", 2, "q", "", ["a b"], "A b."),
    ]
    return spark.createDataFrame(rows, RECORD)


def by_qid(frame):
    return {r.qid: r.score for r in frame.collect()}


def test_claim_shares(records):
    verdicts = metrics.claim_verdicts(records)
    assert by_qid(metrics.faithfulness(verdicts)) == {0: 0.5, 1: 0.0}
    assert by_qid(metrics.context_recall(verdicts)) == {0: 1.0, 1: 0.0, 2: 1.0}


def test_context_precision(records):
    got = by_qid(metrics.context_precision(metrics.relevance(records)))
    assert got[0] == pytest.approx((1 / 1 + 2 / 3) / 2)
    assert got[1] == 0.0 and got[2] == 1.0


def test_context_precision_rewards_early_hits(spark):
    rows = [("e", q, r, flag) for q, flags in enumerate(["110", "011", "000"]) for r, flag in enumerate(map(int, flags), 1)]
    table = spark.createDataFrame(rows, "experiment string, qid bigint, rank int, f int").withColumn(
        "relevant", F.col("f") == 1
    )
    got = by_qid(metrics.context_precision(table))
    assert got == {0: 1.0, 1: pytest.approx((1 / 2 + 2 / 3) / 2), 2: 0.0}


def test_answer_relevancy_dense(spark, records):
    def letters(texts, keys, text):
        vector = F.array(F.lit(1.0), F.when(F.lower(F.col(text)).contains("cats"), 0.0).otherwise(1.0))
        from evalspark.functions.vectors import normalize

        return texts.select("experiment", *keys, normalize(vector).alias("vector"))

    got = by_qid(metrics.answer_relevancy(records, letters))
    assert got == {0: pytest.approx((math.sqrt(0.5) + 1) / 2), 1: pytest.approx(1.0)}


def test_judge_hook(records):
    hooks.register_judge("yes", lambda claim, context: pd.Series([True] * len(claim)))
    verdicts = metrics.claim_verdicts(records, hooks.judge("yes"))
    assert by_qid(metrics.faithfulness(verdicts)) == {0: 1.0, 1: 1.0}
    assert by_qid(metrics.context_precision(metrics.relevance(records, hooks.judge("yes"))))[1] == 1.0


def test_wide_and_aggregates(spark):
    rows = [("e", 0, "0.5", "n/a"), ("e", 1, "0.7", "NaN"), ("e", 2, None, "0.2")]
    wide = spark.createDataFrame(rows, "experiment string, qid bigint, faithfulness string, context_recall string")
    got = metrics.aggregate_scores(wide).head().asDict()
    assert got["faithfulness_mean"] == pytest.approx(0.6)
    assert got["faithfulness_std"] == pytest.approx(statistics.stdev([0.5, 0.7]))
    assert (got["faithfulness_min"], got["faithfulness_max"]) == (0.5, 0.7)
    assert got["context_recall_mean"] == 0.2 and got["context_recall_std"] is None
    assert "answer_relevancy_mean" not in got


def test_unknown_metrics_are_skipped():
    with pytest.warns(UserWarning, match="Unknown metric 'fluency'"):
        assert metrics.known_metrics(["faithfulness", "fluency"]) == ["faithfulness"]


def test_missing_scores_stay_null(records):
    scores = metrics.score_long(records, None, ["faithfulness"])
    wide = {r.qid: r.faithfulness for r in metrics.score_wide(records, scores, ["faithfulness"]).collect()}
    assert wide == {0: 0.5, 1: 0.0, 2: None}
    assert metrics.score_long(records, None, []).count() == 0


def test_reports(spark):
    row = {"experiment": "e"}
    for m, mean in zip(metrics.METRICS, (0.5, 0.9, 0.8, 0.2)):
        row |= {f"{m}_mean": mean, f"{m}_std": 0.1, f"{m}_min": 0.0, f"{m}_max": 1.0}
    aggregates = spark.createDataFrame([row])
    stats = metrics.metric_statistics(aggregates)
    report = {r.metric: (r.bar, r.summary) for r in metrics.score_report(stats).collect()}
    assert report["faithfulness"] == ("█" * 10 + "░" * 10, "0.5000 ± 0.1000")
    bands = {r.metric: (r.band, r.passed) for r in metrics.score_bands(stats).collect()}
    assert bands["answer_relevancy"] == ("Excellent", True) and bands["context_recall"] == ("Very poor", False)
    findings = {r.finding for r in metrics.diagnosis(aggregates).collect()}
    assert findings == {"low faithfulness", "low context_recall", "low faithfulness + high context_precision"}


def test_extractive_answer(spark):
    schema = "experiment string, qid bigint, question string, contexts array<string>"
    rows = [
        ("e", 0, "why do cats purr", ["Dogs bark. Cats purr", "Cats do purr. x"]),
        ("e", 1, "cats purr", ["cats sleep. purr on", "cats purr"]),
        ("e", 2, "zebra", ["cats purr"]),
        ("e", 3, "cats", []),
    ]
    got = {r.qid: r.answer for r in answering.extractive_answers(spark.createDataFrame(rows, schema), 0.1).collect()}
    assert got == {0: "Cats do purr", 1: "cats purr", 2: answering.REFUSAL, 3: answering.REFUSAL}


def test_prompt(spark):
    frame = spark.createDataFrame([("e", 0, "Q?", ["a", "b"])], "experiment string, qid bigint, question string, contexts array<string>")
    row = answering.prompts(frame).head()
    assert row.human == "Context:\na\n\n---\n\nb\n\n---\n\nQuestion: Q?\n\nAnswer:"
    assert answering.REFUSAL in row.system
