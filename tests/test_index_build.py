"""Building an index moves words and numbers, not texts; scoring is bounded by products."""

import dataclasses
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalspark import Settings
from evalspark.functions import text as tx
from evalspark.operators import blocks, densesearch, textsearch
from evalspark.operators.chunking import BASE
from evalspark.sources import tables

CHUNKS = "experiment string, doc_id bigint, pos int, chunk_text string"


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(3)
    words = ["Zoë", "zoë", "a", "b.c", "x y", "ß", "日本", "\x0b", "🙂"]
    rows = [(BASE, i // 3, i % 3, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(90)]
    rows += [(BASE, 40, 0, None), (BASE, 41, 0, " .. "), (BASE, 2, 0, "twice a a"), (BASE, None, 0, "no id"), (BASE, None, 0, "no id b")]
    return spark.createDataFrame(rows, CHUNKS).cache()


def rows(table):
    return sorted(map(repr, table.collect()))


def test_words_counted_in_place_are_those_gathered(spark, chunks, monkeypatch):
    monkeypatch.setattr(textsearch, "ROWS_PER_STEP", 7)
    repeated = chunks.groupBy("experiment", "doc_id", "pos").count().filter("count > 1").select("doc_id").distinct()
    assert rows(textsearch.chunk_words(chunks, repeated)) == rows(textsearch.chunk_words(chunks))


def test_no_text_is_moved_to_count_words(spark, chunks):
    once = chunks.filter("doc_id > 2")
    found = textsearch.chunk_words(once, once.select("doc_id").filter("false"))
    assert found.count() == textsearch.chunk_words(once).count()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan


def test_chunks_stay_where_few_ids_repeat(spark, chunks, tmp_path, monkeypatch):
    """The repeated ids come as a table of their own size, so no chunk is moved to meet them."""
    docs = chunks.select("doc_id", F.col("chunk_text").alias("text"), F.lit("f").alias("filename"))
    given = []
    real = tables.chunk_words
    monkeypatch.setattr(tables, "chunk_words", lambda table, repeated: given.append(repeated) or real(table, repeated))
    tables.load_or_build_index(docs, [(BASE, Settings(splitter="windows"))], str(tmp_path))
    plan = given[0]._jdf.queryExecution().optimizedPlan().toString()
    assert given[0].columns == ["doc_id"] and "Filter" not in plan


def test_common_terms_are_bounded_by_number(spark, chunks):
    terms = textsearch.term_table(chunks).cache()
    counts = textsearch.term_counts(chunks)
    n = terms.count()
    for most in (0, 1, 3, n):
        at = textsearch.lowest_common(terms, most)
        assert terms.filter(F.col("df") >= at).count() <= most
        assert rows(textsearch.weigh(counts, terms, n, most)) == rows(textsearch.weigh(counts, terms, n))


def test_vectors_of_an_index_are_scaled_counts(spark, chunks, tmp_path):
    docs = chunks.select("doc_id", F.col("chunk_text").alias("text"), F.lit("f").alias("filename"))
    settings = dataclasses.replace(Settings(splitter="windows"))
    index = tables.load_or_build_index(docs, [(BASE, settings)], str(tmp_path))
    again = index.chunks.select(*textsearch.CHUNK, "chunk_text")
    weighed = textsearch.weigh(textsearch.term_counts(again), index.terms, 10)
    want = {(r.doc_id, r.pos): sorted((t, round(w, 9)) for t, w in r.vector) for r in textsearch.unit_vectors(weighed, ["doc_id", "pos"]).collect()}
    got = textsearch.with_idf_of_chunks(index.vectors, ["doc_id", "pos"], index.terms)
    assert {(r.doc_id, r.pos): sorted((t, round(w, 9)) for t, w in r.vector) for r in got.collect()} == want


def test_products_are_bounded(monkeypatch):
    rng = np.random.default_rng(1)
    kind = pa.list_(pa.struct([("term", pa.string()), ("weight", pa.float64())]))

    def some(n):
        return pa.array([[{"term": f"w{t}", "weight": float(rng.random())} for t in rng.choice(30, rng.integers(0, 9), False)] for _ in range(n)], kind)

    asked, vectors = blocks.SparseQueries(np.arange(20), some(20)), some(50)
    want, _ = asked.score(vectors)
    largest = []
    real = blocks.SparseQueries._meet

    def noted(self, row, weights, code, times, scores):
        largest.append((int(times.sum()), len(set(row))))
        real(self, row, weights, code, times, scores)

    monkeypatch.setattr(blocks.SparseQueries, "_meet", noted)
    monkeypatch.setattr(blocks, "PRODUCTS_PER_STEP", 40)
    got, allowed = asked.score(vectors)
    assert np.array_equal(got, want) and np.array_equal(allowed, want > 0)
    assert len(largest) > 3 and all(n <= 80 or count == 1 for n, count in largest)


def test_clean_texts_are_told_apart(spark):
    rng = random.Random(5)
    parts = ["a", "b", " ", "\n", "\t", "\r", "\x00", " ", "\x85", "\x1c"]
    texts = ["".join(rng.choices(parts, weights=[9, 9, 3, 3, 1, 1, 1, 1, 1, 1], k=rng.randint(0, 9))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    assert df.filter(~tx.clean_text(F.col("text")).eqNullSafe(tx._cleaned(F.col("text")))).count() == 0


def test_visits_leave_in_bounded_slices(monkeypatch):
    monkeypatch.setattr(densesearch, "VISITS_PER_STEP", 20)
    vectors = np.random.default_rng(2).random((50, 4))
    pivots, every = vectors[:8], lambda far, part: np.ones(far.shape, bool)
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(vectors.tolist())], names=["qid", "vector"])
    parts = list(densesearch.visited(batch.slice(3), every, pivots))
    assert max(map(len, parts)) <= 20
    got = [(q, c) for part in parts for q, c in zip(part["qid"].to_pylist(), part["cell"].to_pylist())]
    assert got == [(q, c) for q in range(3, 50) for c in range(8)]
    assert parts[-1]["vector"][-1].as_py() == vectors[49].tolist()


def test_words_are_split_as_spark_splits_them(spark):
    from evalspark.functions import packed

    rng = random.Random(11)
    parts = ["a", "É", "日本", "🙂", " ", "\t", "\x0b", "\x0c", "\r", "\n", "\x1c", "\x85", "\u00a0", ".", ",", ";", ":", "!", "?", "-", ""]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 15))) for _ in range(500)] + [None, "", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    want = {r.i: r.words or [] for r in df.select("i", tx.tokens(F.col("text")).alias("words")).collect()}
    lower = {r.i: r.text for r in df.select("i", F.lower("text").alias("text")).collect()}
    given = pa.array(["x."] + [lower[i] for i in range(len(texts))] + ["y"])
    for part, first in ((given.slice(1, len(texts)), 0), (given.slice(101, 50), 100)):
        length, words = packed.split_words(part, packed.BREAKS)
        at = np.concatenate(([0], np.cumsum(length)))
        words = words.to_pylist()
        assert [words[a:b] for a, b in zip(at[:-1], at[1:])] == [want[first + i] for i in range(len(part))]


def test_words_of_an_index_are_packed(spark, chunks, tmp_path):
    """One text per chunk instead of a nested value per word, and no second copy as vectors."""
    docs = chunks.select("doc_id", F.col("chunk_text").alias("text"), F.lit("f").alias("filename"))
    index = tables.load_or_build_index(docs, [(BASE, Settings(splitter="windows"))], str(tmp_path))
    assert {"terms", "counts", "length"} <= set(index.vectors.columns)
    assert dict(index.vectors.dtypes)["terms"] == "string"


def test_rare_words_weigh_as_common_ones(spark, chunks):
    """Lengths with all terms sent around, with some and with none."""
    terms = textsearch.term_table(chunks).cache()
    words = textsearch.chunk_words(chunks)
    n = terms.count()
    plain = lambda df: sorted(repr((*r[:3], round(r.length, 9))) for r in df.collect())
    want = plain(textsearch.chunk_lengths(words, terms, n))
    assert len(want) == words.count()
    for most in (0, 3, n - 1):
        assert plain(textsearch.chunk_lengths(words, terms, n, most)) == want


def test_terms_stay_where_questions_are_few(spark, chunks, monkeypatch):
    terms = textsearch.term_table(chunks).cache()
    asked = spark.createDataFrame([(1, "Zoë a b ß"), (2, "nowhere")], "qid bigint, question string")
    few = textsearch.text_vectors(asked, ["qid"], "question", terms)
    assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(textsearch, "BROADCAST_WORDS", 1)
    many = textsearch.text_vectors(asked, ["qid"], "question", terms)
    plain = lambda df: [(r.qid, sorted((t, round(w, 9)) for t, w in r.vector)) for r in df.collect()]
    assert plain(few) == plain(many) != []


def test_best_rows_are_those_of_whole_steps(monkeypatch):
    """Once each query has k rows, only scores that reach its k-th are looked at; ties stay exact."""
    rng = np.random.default_rng(4)
    vectors = pa.array(rng.integers(0, 3, (300, 4)).astype(float).tolist())
    asked = pa.array(rng.integers(0, 3, (20, 4)).astype(float).tolist())
    found = []
    for step in (20 * 300, 20 * 7):
        monkeypatch.setattr(blocks, "SCORES_PER_STEP", step)
        for own in (False, True):
            best = blocks.Best(blocks.query_block(np.arange(20), asked), 5, 1, own)
            best.add(vectors, [np.arange(300)])
            found.append(sorted(zip(*(c.tolist() for c in best.columns()))))
    assert found[0] == found[2] and found[1] == found[3] and len(found[0]) == 100
