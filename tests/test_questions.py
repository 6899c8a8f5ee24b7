"""What the queries on questions ask."""

import pytest

import __spark_entry__ as entry

WHOLE = (
    "topk_text mmr_text contexts_by_query source_preview prompt_table extractive_answer rag_end_to_end eval_records "
    "claim_verdicts scores_wide metric_aggregates score_bands k_sweep chunk_size_sweep benchmark_summary param_series "
    "metric_matrix faithfulness context_recall"
).split()


def test_a_question_is_the_whole_item(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(40))
    spark.createDataFrame([(1, text), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    asked = {r.qid: r.question for r in entry.items(spark, str(tmp_path)).collect()}
    assert asked == {1: text, 2: None}


@pytest.mark.parametrize("name", WHOLE)
def test_its_twin_asks_for_the_whole_item(name):
    assert entry.oracles.ASKED not in entry.oracles.sql()[name]


def test_postings_are_asked_for_the_whole_item(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(40))
    spark.createDataFrame([(1, text), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    asked = {r.qid: r.question for r in entry.odd_items(spark, str(tmp_path)).collect()}
    assert asked == {1: text, 1_000_001: text.replace("o", "q"), 2: None, 1_000_002: None}
    assert entry.oracles.ASKED not in entry.oracles.sql()["topk_text_postings"]
