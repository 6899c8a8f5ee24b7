"""The splitter as a table function, and its slices."""

import tracemalloc

import pytest

from evalspark.functions import tables
from evalspark.operators import chunking
from evalspark.settings import SEPARATORS


def test_lateral(spark):
    texts = ["one two three. four five\n\nsix " * 9, "", None, "  ", "word " * 400]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    docs.createOrReplaceTempView("split_docs")
    tables.register(spark)
    query = "SELECT d.doc_id, c.* FROM split_docs d, LATERAL recursive_chunks(d.text, {}, {}) c"
    rows = spark.sql(query.format(40, 10)).collect()
    assert all(r.char_count == len(r.chunk_text) <= 40 for r in rows)
    by_operator = chunking.chunk_recursive(docs, [("base", 40, 10)]).collect()
    assert sorted((r.doc_id, r.pos, r.chunk_text) for r in rows) == sorted(
        (r.doc_id, r.pos, r.chunk_text) for r in by_operator
    )
    assert {r.doc_id for r in rows} == {0, 4}
    # Sizes of each row's own.
    own = spark.sql("SELECT d.doc_id, c.* FROM split_docs d, LATERAL recursive_chunks(d.text, CAST(20 + doc_id AS INT), 5) c")
    assert max(r.char_count for r in own.filter("doc_id = 0").collect()) <= 20
    with pytest.raises(Exception, match="overlap 50"):
        spark.sql(query.format(40, 50)).collect()


def test_slices_keep_rows_together(spark, monkeypatch):
    """Small slices give the same rows; the carried columns stay with their chunks."""
    docs = spark.createDataFrame(
        [(i, "alpha beta gamma. " * (i * 7 % 5), {"n": i}, [i, None]) for i in range(20)],
        "doc_id bigint, text string, extra map<string,int>, list array<int>",
    )
    sizes = [("a", 30, 5), ("b", 12, 0)]
    whole = chunking.chunk_recursive(docs, sizes).collect()
    parts = list(chunking.bounded([(0, "x" * 400_000)] * 7, lambda row: len(row[1])))
    assert [len(p) for p in parts] == [3, 3, 1] and list(chunking.bounded([], len)) == []
    assert all(r.extra == {"n": r.doc_id} and r.list == [r.doc_id, None] for r in whole)
    for name, size, overlap in sizes:
        for row in docs.collect():
            expected = list(chunking.recursive_chunks(row.text, size, overlap, SEPARATORS))
            got = sorted((r.pos, r.chunk_text) for r in whole if (r.experiment, r.doc_id) == (name, row.doc_id))
            assert [c for _, c in got] == expected


def test_long_text_is_not_held_twice():
    text = "some words of a sentence. " * 400_000
    tracemalloc.start()
    total = 0
    for part in chunking.bounded(enumerate(chunking.recursive_chunks(text, 512, 64, SEPARATORS)), lambda row: len(row[1])):
        total += sum(len(chunk) for _, chunk in part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total > 0.9 * len(text) and peak < len(text) / 2
