"""The inverted index with skipped blocks: same rows as the scan, few blocks read, always k rows."""

import random

import pytest
from pyspark.sql import functions as F

from evalspark import Settings
from evalspark.operators import postings as ps
from evalspark.operators.chunking import BASE, chunk_offsets
from evalspark.operators.textsearch import term_counts, term_table, text_vectors, topk_chunks, unit_vectors, weigh
from evalspark.plans import rag

KEY = ["qid", "rank", "doc_id", "pos", "sim"]


@pytest.fixture(scope="module")
def searched(spark):
    """Documents of 40 topics, one after the other, with common words in all; copies tie."""
    rng = random.Random(7)
    common = [f"common{i}" for i in range(20)]
    docs = []
    for topic in range(40):
        own = [f"topic{topic}word{i}" for i in range(60)]
        for _ in range(10):
            words = [rng.choice(own if rng.random() < 0.5 else common) for _ in range(30)]
            docs.append((len(docs), 0, " ".join(words)))
    docs += [(len(docs), 0, docs[5][2]), (len(docs) + 1, 0, docs[5][2]), (len(docs) + 2, 0, "")]
    chunks = spark.createDataFrame(docs, "doc_id bigint, pos int, chunk_text string").withColumn("experiment", F.lit(BASE)).cache()
    terms = term_table(chunks).cache()
    vectors = unit_vectors(weigh(term_counts(chunks), terms, 10_000), ["doc_id", "pos"]).cache()
    offsets = chunk_offsets(chunks).cache()
    asked = [(t, f"topic{t}word1 topic{t}word2 topic{t}word3 common3") for t in range(40)]
    asked += [(100, docs[5][2]), (101, "common1 common2"), (102, "topic0word1 topic39word2"), (103, "nowhere at all"), (104, "")]
    questions = spark.createDataFrame(asked, "qid bigint, question string")
    return chunks, terms, vectors, offsets, questions, text_vectors(questions, ["qid"], "question", terms).cache()


def rows(table) -> list[tuple]:
    return sorted(tuple(r) for r in table.select(*KEY).collect())


@pytest.mark.parametrize("block, first, k", [(4, 1, 3), (16, 4, 7), (1000, 2, 5), (16, 1, 60)])
def test_same_rows_as_the_scan(spark, searched, block, first, k):
    _, _, vectors, offsets, _, asked = searched
    index = ps.build_postings(vectors, offsets, block).cache()
    assert rows(ps.topk_postings(asked, index, k, first)) == rows(topk_chunks(asked, vectors, k))
    assert index.agg(F.max(F.size("postings"))).first()[0] <= block


def test_postings_do_not_move_one_by_one(spark, searched):
    """Vectors are dealt by block once, and a block lies in one file."""
    _, _, vectors, offsets, _, _ = searched
    # Else all of a small table is one partition.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = ps.build_postings(vectors, offsets, 8).select("block", F.spark_partition_id().alias("at")).distinct().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r["at"] for r in index}) > 1 and len(index) == len({r.block for r in index})


def test_few_blocks_are_read(spark, searched):
    _, _, vectors, offsets, _, asked = searched
    index = ps.build_postings(vectors, offsets, 8).cache()
    words = ps.question_words(asked.filter("qid < 40")).cache()
    bounds = ps.block_bounds(words, index).cache()
    begin = bounds.join(bounds.groupBy("qid").agg(F.max("bound").alias("m")), "qid").filter("bound = m").select("experiment", "qid", "block").cache()
    found = ps.ranked(ps.block_scores(begin, words, index), 3)
    more = ps.blocks_to_read(bounds, begin, found, 3)
    assert bounds.count() > 40 * 40
    assert begin.count() + more.count() < bounds.count() / 8


def test_bounds_hold(spark, searched):
    _, _, vectors, offsets, _, asked = searched
    index = ps.build_postings(vectors, offsets, 16)
    words = ps.question_words(asked)
    bounds = ps.block_bounds(words, index)
    scores = ps.block_scores(bounds, words, index).join(offsets, ["experiment", "doc_id"])
    block = F.floor((F.col("first_index") + F.col("pos")) / 16)
    over = scores.withColumn("block", block).join(bounds, [*ps.ASKED, "block"]).filter(F.col("sim") > F.col("bound") + ps.SLACK)
    assert over.count() == 0


def test_always_k_rows(spark, searched):
    """Chunks that share no word have score 0 and come in document order."""
    chunks, _, vectors, offsets, questions, asked = searched
    every = questions.select(F.lit(BASE).alias("experiment"), "qid")
    found = topk_chunks(asked, vectors, 5)
    filled = ps.fill_up(found, every, chunks, offsets, 5).collect()
    by_qid = {}
    for r in sorted(filled, key=lambda r: r["rank"]):
        by_qid.setdefault(r.qid, []).append(r)
    assert set(by_qid) == {r.qid for r in questions.collect()}
    assert all([r["rank"] for r in found] == [1, 2, 3, 4, 5] for found in by_qid.values())
    for qid in (103, 104):
        assert [(r.doc_id, r.sim) for r in by_qid[qid]] == [(i, 0.0) for i in range(5)]
    # A corpus of fewer chunks gives them all, each once.
    few = chunks.filter("doc_id < 3")
    small = ps.fill_up(found.filter("doc_id < 3"), every, few, chunk_offsets(few), 5).collect()
    assert len(small) == 3 * questions.count() == len({(r.qid, r.doc_id) for r in small})
    assert ps.fill_up(found.limit(0), every, few.limit(0), offsets.limit(0), 5).collect() == []


def test_backend_of_the_settings(spark, corpus, questions, tmp_path):
    base = Settings(splitter="windows", chunk_size=40, chunk_overlap=0)
    scan = rag.Rag(base).build(corpus, str(tmp_path / "a"))
    other = rag.Rag(base.variant({"retriever.backend": "postings"})).build(corpus, str(tmp_path / "a"))
    assert scan.index.postings is None and other.index.postings is not None
    loaded = rag.Rag(other.settings).build(corpus, str(tmp_path / "a"))
    assert rows(rag.retrieve(questions, loaded.index, loaded.settings)) == rows(rag.retrieve(questions, scan.index, base))
    with pytest.raises(ValueError, match="without postings"):
        rag.retrieve(questions, scan.index, other.settings)
    with pytest.raises(ValueError, match="backend"):
        Settings(search_backend="nearby")


def test_whole_postings_do_not_move_to_questions(spark, searched):
    """What is shuffled is a row per question and block, and rows of the result."""
    _, _, vectors, offsets, _, asked = searched
    index = ps.build_postings(vectors, offsets, 8).cache()
    found = ps.topk_postings(asked, index, 3)
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    exchanges = [part for part in plan.split("\n\n") if ") Exchange" in part]
    assert exchanges and not any("postings" in part for part in exchanges)


def test_a_block_that_two_tasks_read_is_summed(spark, searched):
    """Rows of a block in two partitions, as a split of a file between them leaves them."""
    _, _, vectors, offsets, _, asked = searched
    index = ps.build_postings(vectors, offsets, 64)
    rows_of = index.orderBy("experiment", "block", "term").collect()
    cut = spark.createDataFrame(spark.sparkContext.parallelize(rows_of, 7), index.schema).cache()
    lying = cut.select("block", F.spark_partition_id().alias("at")).distinct().collect()
    assert len(lying) > len({r.block for r in lying})
    assert rows(ps.topk_postings(asked, cut, 5)) == rows(topk_chunks(asked, vectors, 5))


def test_shares_make_up_the_whole(spark, searched):
    _, _, vectors, offsets, _, _ = searched
    plain = lambda df: sorted(map(repr, df.collect()))
    parts = [ps.build_postings(vectors, offsets, 16, share, 3) for share in range(3)]
    assert plain(parts[0].unionByName(parts[1]).unionByName(parts[2])) == plain(ps.build_postings(vectors, offsets, 16))
