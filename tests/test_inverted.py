"""The inverted file against brute force."""

import numpy as np
import pytest

from evalspark.operators import densesearch, inverted


def vectors(spark, points, start=0):
    points = points / np.linalg.norm(points, axis=1, keepdims=True)
    return spark.createDataFrame(
        [(i + start, p.tolist()) for i, p in enumerate(points)], "vec_id bigint, vector array<double>"
    ).selectExpr("'' as cell", "*")


@pytest.fixture(scope="module")
def clustered(spark):
    """Many small clusters, and one that holds a third of the vectors, copies among them."""
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(60, 18))
    small = middle[rng.integers(0, 60, 2000)] + rng.normal(size=(2000, 18)) * 0.25
    hot = middle[0] + np.repeat(rng.normal(size=(250, 18)) * 0.05, 4, axis=0)
    corpus = vectors(spark, np.concatenate([small, hot])).cache()
    return corpus, corpus.filter("vec_id % 50 = 0").selectExpr("cell", "vec_id as qid", "vector")


def sims(found):
    """Scores by rank: copies make the ids of equal scores a matter of order."""
    return {(r.qid, r["rank"]): r.sim for r in found.collect()}


def test_recall_and_work(clustered):
    corpus, queries = clustered
    index = inverted.build(corpus, "vec_id")
    assert index.codes.count() == index.sizes.sum() == 3000
    assert len(index.centers.upper) == 8 and 40 <= len(index.sizes) <= 64
    found = sims(inverted.search(index, queries, 10, exclude_self=True))
    true = sims(densesearch.topk_dense(corpus, queries, 10, exclude_self=True))
    assert found.keys() == true.keys()
    # A row is a true neighbour if it is as near as the last of them.
    assert sum(found[qid, r] >= true[qid, 10] - 2e-6 for qid, r in found) >= 0.9 * len(true)
    # Small clusters: a query sees a part of the lists.
    assert index.visits < len(index.sizes) / 2
    everything = sims(inverted.search(index, queries, 10, True, visits=len(index.sizes), depth=300))
    assert everything == pytest.approx(true, abs=2e-6)


def test_codes_are_small_and_near(clustered):
    corpus, _ = clustered
    index = inverted.build(corpus, "vec_id")
    rows = corpus.drop("cell").join(index.codes.withColumnRenamed("vector", "code"), "vec_id").limit(300).collect()
    assert {len(r.code) for r in rows} == {5}
    for r in rows:
        code = np.frombuffer(r.code, np.uint8)[None, :]
        assert index.centers.decode(code, r.cell)[0] @ np.array(r.vector) > 0.8


def test_same_index_again(clustered):
    corpus, queries = clustered
    first, second = (inverted.search(inverted.build(corpus, "vec_id"), queries, 3) for _ in range(2))
    assert sorted(first.collect()) == sorted(second.collect())


@pytest.mark.parametrize("n", [1, 3, 30])
def test_few_vectors(spark, n):
    points = np.random.default_rng(n).normal(size=(n, 6))
    corpus = vectors(spark, points)
    queries = corpus.selectExpr("cell", "vec_id as qid", "vector")
    found = densesearch.topk_dense(corpus, queries, 4, backend="inverted").collect()
    assert len(found) == n * min(n, 4)
    assert {(r.qid, r.vec_id) for r in found if r["rank"] == 1} == {(i, i) for i in range(n)}


def test_copies_only(spark):
    corpus = vectors(spark, np.ones((40, 5)))
    found = densesearch.topk_dense(corpus, corpus.selectExpr("cell", "vec_id as qid", "vector"), 3, backend="inverted")
    assert sorted((r.qid, r.vec_id) for r in found.collect()) == [(q, i) for q in range(40) for i in range(3)]


def test_empty(spark):
    corpus = vectors(spark, np.ones((2, 3)))
    queries = corpus.selectExpr("cell", "vec_id as qid", "vector")
    assert densesearch.topk_dense(corpus.filter("false"), queries, 4, backend="inverted").count() == 0
    assert densesearch.topk_dense(corpus, queries.filter("false"), 4, backend="inverted").count() == 0
