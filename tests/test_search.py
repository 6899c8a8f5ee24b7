import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark import hooks
from evalspark.operators import blocks, cache, densesearch, textsearch
from evalspark.operators.mmr import mmr, pick

WORDS = [f"w{i}" for i in range(60)]


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(7)
    rows = []
    for doc in range(80):
        for pos in range(3):
            words = rng.choices(WORDS, [1 / (i + 1) for i in range(60)], k=20)
            rows.append(("base", doc, pos, " ".join(["hot", *words])))
    # A third of all chunks are copies of one.
    rows += [("base", 100 + i, 0, "hot w1 w2 w3") for i in range(120)]
    return spark.createDataFrame(rows, "experiment string, doc_id bigint, pos int, chunk_text string").cache()


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(8)
    rows = [(q, " ".join(rng.choices(WORDS, k=6))) for q in range(30)] + [(30, "w1 w2 w3"), (31, "hot"), (32, "none of these")]
    return spark.createDataFrame(rows, "qid bigint, question string")


def brute(chunks, asked, k):
    texts = {(r.doc_id, r.pos): Counter(r.chunk_text.split()) for r in chunks.collect()}
    df = Counter(w for c in texts.values() for w in c)
    idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items()}

    def unit(counts):
        v = {w: n * idf[w] for w, n in counts.items() if w in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    vectors = {key: unit(c) for key, c in texts.items()}
    out = {}
    for r in asked.collect():
        q = unit(Counter(r.question.split()))
        scored = [
            (-round(sum(q[w] * v.get(w, 0) for w in q), 6), key) for key, v in vectors.items() if q.keys() & v.keys()
        ]
        for rank, (score, key) in enumerate(sorted(scored)[:k], 1):
            out[(r.qid, rank)] = (*key, -score)
    return out


def build(chunks, n_terms=None):
    terms = textsearch.term_table(chunks)
    weighed = textsearch.weigh(textsearch.term_counts(chunks), terms, n_terms or terms.count())
    return terms, textsearch.unit_vectors(weighed, ["doc_id", "pos"])


def found(chunks, asked, k, n_terms=None):
    terms, vectors = build(chunks, n_terms)
    hits = textsearch.topk_chunks(textsearch.text_vectors(asked, ["qid"], "question", terms), vectors, k)
    return {(r.qid, r["rank"]): (r.doc_id, r.pos, r.sim) for r in hits.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for key in want:
        assert got[key][:2] == want[key][:2] and abs(got[key][2] - want[key][2]) < 2e-6, key


def test_text_search_equals_brute_force(chunks, asked):
    want = brute(chunks, asked, 5)
    same(found(chunks, asked, 5), want)


def test_large_vocabulary_takes_the_shuffle(chunks, asked):
    same(found(chunks, asked, 5, n_terms=10**9), brute(chunks, asked, 5))


def test_many_questions_take_the_grid(chunks, asked, monkeypatch):
    monkeypatch.setattr(blocks, "BROADCAST_QUERIES", 3)
    monkeypatch.setattr(blocks, "ROWS_PER_BLOCK", 50)
    monkeypatch.setattr(blocks, "QUERIES_PER_BLOCK", 7)
    same(found(chunks, asked, 5), brute(chunks, asked, 5))


def test_small_steps_give_the_same(chunks, asked, monkeypatch):
    want = found(chunks, asked, 5)
    monkeypatch.setattr(blocks, "SCORES_PER_STEP", 64)
    assert found(chunks, asked, 5) == want


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 8))
    vectors = centers[rng.integers(0, 6, 400)] + 0.1 * rng.normal(size=(400, 8))
    vectors[100:230] = vectors[100]  # a third are copies
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    return densesearch.prepare(frame, "vec_id").cache(), vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


@pytest.mark.parametrize("backend", ["scan", "cells"])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_dense_backends_equal_brute_force(points, backend, exclude_self):
    corpus, vectors = points
    queries = corpus.select("cell", F.col("vec_id").alias("qid"), "vector")
    rows = densesearch.topk_dense(corpus, queries, 4, backend=backend, exclude_self=exclude_self).collect()
    got = {(r.qid, r["rank"]): (r.vec_id, r.sim) for r in rows}
    sims = np.round(vectors @ vectors.T, 6)
    for q in range(len(vectors)):
        order = sorted((-s, i) for i, s in enumerate(sims[q]) if not (exclude_self and i == q))[:4]
        assert [got[(q, r + 1)][0] for r in range(4)] == [i for _, i in order], q
    assert len(got) == 4 * len(vectors)


def test_cells_with_fewer_vectors_than_k(points):
    corpus, _ = points
    few = corpus.filter("vec_id < 3")
    queries = few.select("cell", F.col("vec_id").alias("qid"), "vector")
    assert densesearch.topk_dense(few, queries, 5, backend="cells").count() == 9
    assert densesearch.topk_dense(corpus.filter("false"), queries, 5, backend="cells").count() == 0


def test_unknown_backend(points):
    with pytest.raises(ValueError, match="Unknown vector store backend"):
        densesearch.topk_dense(points[0], points[0], 4, backend="other")


def test_pick_by_hand():
    sims = np.array([0.9, 0.85, 0.3])
    between = np.array([[1, 0.99, 0.1], [0.99, 1, 0.1], [0.1, 0.1, 1]])
    assert pick(sims, between, 2, 0.5) == [0, 2]
    assert pick(sims, between, 2, 1.0) == [0, 1]
    assert pick(sims, between, 9, 0.5) == [0, 2, 1]
    assert pick(np.empty(0), np.empty((0, 0)), 2, 0.5) == []


def test_mmr_of_dense_and_sparse(points, chunks, asked):
    corpus, vectors = points
    queries = corpus.filter("vec_id in (0, 5)").select("cell", F.col("vec_id").alias("qid"), "vector")
    pool = densesearch.topk_dense(corpus, queries, 20)
    rows = mmr(pool, corpus, ["vec_id"], 4, 0.5).collect()
    held = {(r.qid, r["rank"]): (r.vec_id, r.sim) for r in pool.collect()}
    for q in (0, 5):
        ids, sims = zip(*[held[(q, r)] for r in range(1, 21)])
        between = np.round(vectors[list(ids)] @ vectors[list(ids)].T, 6)
        want = [ids[i] for i in pick(np.array(sims), between, 4, 0.5)]
        assert [r.vec_id for r in sorted(rows, key=lambda r: r["rank"]) if r.qid == q] == want
    terms, sparse = build(chunks)
    asked = textsearch.text_vectors(asked, ["qid"], "question", terms)
    pool = textsearch.topk_chunks(asked, sparse, 160).withColumnRenamed("experiment", "cell")
    picked = mmr(pool, sparse.withColumnRenamed("experiment", "cell"), ["doc_id", "pos"], 4, 0.5)
    # Copies of a chunk that is chosen gain nothing, so the second pick differs from the first.
    firsts = {r["rank"]: r.doc_id for r in picked.filter("qid = 30").collect()}
    assert firsts[1] == 100 and len(firsts) == 4 and not {101, 102, 103} & set(firsts.values())


def lengths():
    return lambda texts: np.array([[float(len(t)), 1.0] for t in texts], np.float32)


def test_cache(spark, tmp_path):
    from evalspark.sources.tables import append_cache, load_cache

    hooks.register_embedder("lengths", lengths)
    path = str(tmp_path / "cache")
    texts = spark.createDataFrame([(0, "aa"), (1, "b"), (2, "aa"), (3, "cccc")], "i int, text string")
    assert load_cache(spark, path).count() == 0
    merged, new = cache.embed_with_cache(
        texts.filter("i < 3"), load_cache(spark, path), hooks.embedder("lengths"), "m1"
    )
    assert [r.embedding for r in merged.orderBy("i").collect()] == [[2.0, 1.0], [1.0, 1.0], [2.0, 1.0]]
    append_cache(new, path)
    known = load_cache(spark, path)
    assert known.count() == 2
    keyed = cache.keyed(texts, "m1")
    assert [r.i for r in cache.cache_hits(keyed, known).orderBy("i").collect()] == [0, 1, 2]
    assert [r.text for r in cache.cache_misses(keyed, known).collect()] == ["cccc"]
    # Another model does not get these vectors.
    assert cache.cache_hits(cache.keyed(texts, "m2"), known).count() == 0
    with pytest.raises(ValueError, match="Unknown embedding provider"):
        hooks.embedder("nobody")
