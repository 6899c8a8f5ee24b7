"""Sweeps that go on where they failed, and metrics that are added."""

import pytest
from pyspark.sql import functions as F

from evalspark.operators import metrics
from evalspark.operators.chunking import chunk_windows, window_counts
from evalspark.plans import sweeps
from evalspark.settings import Settings

BASE = Settings(splitter="windows", chunk_size=64, chunk_overlap=16, k=2)
VARIANTS = sweeps.k_variants((1, 2, 3))


@pytest.fixture
def made(monkeypatch):
    """Names of the experiments that were run, and which one fails."""
    state = {"names": [], "fails": None}
    true = sweeps.experiment_scores

    def run(docs, items, base, variant, *rest):
        if variant["experiment"] == state["fails"]:
            raise OSError("out of credit")
        state["names"].append(variant["experiment"])
        return true(docs, items, base, variant, *rest)

    monkeypatch.setattr(sweeps, "experiment_scores", run)
    return state


def test_resumes_where_it_failed(spark, corpus, questions, tmp_path, made):
    def sweep(items=questions, variants=VARIANTS, base=BASE):
        return sweeps.resumable_scores(corpus, items, base, variants, str(tmp_path / "sweep"), str(tmp_path / "index"))

    made["fails"] = "retrieval_k_2"
    with pytest.raises(OSError):
        sweep()
    assert made["names"] == ["retrieval_k_1"]
    # Scores without a line in the ledger, as of a driver that died in between, are replaced.
    half = spark.read.parquet(str(tmp_path / "sweep/scores"))
    made.update(names=[], fails=None)
    scores = sweep()
    assert made["names"] == ["retrieval_k_2", "retrieval_k_3"]
    assert half.count() == 12
    rows = sorted(scores.collect())
    assert len(rows) == 3 * 3 * 4 and len({(r.experiment, r.qid, r.metric) for r in rows}) == len(rows)
    alone = sweeps.experiment_scores(corpus, questions, BASE, VARIANTS[1], str(tmp_path / "index")).collect()
    expected = {(r.experiment, r.qid, r.metric): r.score for r in alone}
    found = {(r.experiment, r.qid, r.metric): r.score for r in rows if r.experiment == "retrieval_k_2"}
    assert found == pytest.approx(expected)

    made["names"] = []
    assert sorted(sweep().collect()) == rows and made["names"] == []
    # Other questions or settings are other runs; a smaller sweep gives its own rows only.
    assert sweep(items=questions.filter("qid < 2"), variants=VARIANTS[:1]).count() == 8
    assert made["names"] == ["retrieval_k_1"]
    assert sweep(variants=VARIANTS[:1]).count() == 12
    sweep(variants=VARIANTS[:1], base=BASE.variant({"eval.metrics": ("faithfulness",)}))
    assert made["names"] == ["retrieval_k_1"] * 2


def test_scores_without_ledger_are_made_again(spark, corpus, questions, tmp_path, made):
    folder = str(tmp_path / "sweep")
    for _ in range(2):
        first = sweeps.resumable_scores(corpus, questions, BASE, VARIANTS[:1], folder, str(tmp_path / "index"))
        assert first.count() == 12
        spark.createDataFrame([], sweeps.LEDGER).write.mode("overwrite").parquet(f"{folder}/ledger")
    assert made["names"] == ["retrieval_k_1"] * 2


def test_added_metric_reaches_the_summary(spark, monkeypatch):
    monkeypatch.setitem(metrics.REGISTRY, "brevity", lambda r, e, j, s: r)
    scores = spark.createDataFrame(
        [("retrieval_k_1", q, m, 0.5 + q / 10) for q in range(2) for m in ("brevity", "faithfulness")],
        "experiment string, qid bigint, metric string, score double",
    )
    summary = sweeps.experiment_summary(scores, VARIANTS)
    assert summary.head()["brevity_mean"] == pytest.approx(0.55)
    assert "brevity" in {r.metric for r in sweeps.param_series(summary).collect()}
    assert sweeps.metric_matrix(summary).head()["brevity"] == pytest.approx(0.55)


def test_window_counts_are_those_of_the_windows(spark):
    texts = ["", *("a" * n for n in range(1, 40)), "🙂é" * 9, "a\n\r" * 11]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sizes = [("a", 7, 3), ("b", 5, 0), ("c", 8, 7), ("d", 50, 10)]
    counted = {(r.experiment, r.doc_id): r.n for r in window_counts(docs, sizes).collect()}
    cut = chunk_windows(docs, sizes).groupBy("experiment", "doc_id").agg(F.count("*").alias("n")).collect()
    assert {key: n for key, n in counted.items() if n} == {(r.experiment, r.doc_id): r.n for r in cut}
    assert window_counts(docs.select("doc_id", F.lit(None).cast("string").alias("text")), sizes).agg(F.sum("n")).head()[0] == 0
