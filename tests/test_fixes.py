"""Cases that once lost rows or ended a job."""

import numpy as np
import pytest

from evalspark import hooks
from evalspark.operators import cache as cache_ops
from evalspark.operators import chunking, metrics
from evalspark.plans.rag import Rag
from evalspark.settings import Settings
from evalspark.sources.files import load_files
from evalspark.sources.tables import append_cache, load_cache, text_mark


def named_model(model):
    return lambda texts: np.full((len(texts), 2), float(len(model)), np.float32)


def test_question_without_contexts_counts_as_zero(spark):
    rows = [("base", 1, "Cats purr.", ["Cats purr."]), ("base", 2, "Cats purr.", [])]
    records = spark.createDataFrame(rows, "experiment string, qid bigint, ground_truth string, contexts array<string>")
    got = {r.qid: r.score for r in metrics.context_precision(metrics.relevance(records)).collect()}
    assert got == {1: 1.0, 2: 0.0}


def test_null_text_has_no_chunks(spark):
    docs = spark.createDataFrame([(1, None), (2, "one two")], "doc_id bigint, text string")
    assert [r.doc_id for r in chunking.chunk_recursive(docs, [("base", 20, 2)]).collect()] == [2]


def test_mark_covers_every_column(spark):
    one, two = (spark.createDataFrame([(1, "t", name)], "doc_id bigint, text string, filename string") for name in "ab")
    assert text_mark(one) != text_mark(two)


def test_cache_keeps_names_and_keys(spark, tmp_path):
    path = str(tmp_path / "cache")
    for model in ("007", "007", "m1"):
        append_cache(spark.createDataFrame([(model, "s", [1.0])], cache_ops.SCHEMA), path)
    assert sorted(r.model for r in load_cache(spark, path).collect()) == ["007", "m1"]


def test_model_name_reaches_the_model(spark):
    hooks.register_embedder("named", named_model)
    texts = spark.createDataFrame([("a",)], "text string")
    got = [hooks.embedder("named", model=m)(texts).head().embedding for m in ("m", "mmm")]
    assert got == [[1.0, 1.0], [3.0, 3.0]]


def test_ids_are_whole_numbers(spark):
    with pytest.raises(ValueError, match="doc_id"):
        Rag(Settings()).build(spark.createDataFrame([("x", "t")], "doc_id string, text string"))


def test_bytes_of_other_files_are_not_read(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("some text")
    (tmp_path / "v.mp4").write_bytes(b"x" * 5000)
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
    try:
        documents, rejects = load_files(spark, str(tmp_path))
        assert [r.text for r in documents.collect()] == ["some text"]
        assert [r.reason for r in rejects.collect()] == ["unsupported"]
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)


def test_files_that_cannot_be_read_are_named(spark, tmp_path):
    (tmp_path / "a.txt").write_text("some text")
    (tmp_path / "b.txt").write_text(" ")
    (tmp_path / "c.txt").write_text("damaged")
    # A checksum that does not fit: header, bytes per sum, sum.
    (tmp_path / ".c.txt.crc").write_bytes(b"crc\0" + (512).to_bytes(4, "big") + b"\1\2\3\4")
    (tmp_path / "d.txt").write_text("x" * 5000)
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
    try:
        documents, rejects = load_files(spark, str(tmp_path))
        assert [r.text for r in documents.collect()] == ["some text"]
        got = {r.path.rsplit("/", 1)[1]: r.reason for r in rejects.collect()}
        assert got == {"b.txt": "empty", "c.txt": "unreadable", "d.txt": "too large"}
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)
