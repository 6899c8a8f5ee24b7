import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalspark.operators import chunking as C
from evalspark.settings import SEPARATORS
from evalspark.sources.tables import load_chunks, save_chunks


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


def naive_windows(text, size, overlap):
    step = size - overlap
    return [text[s : s + size] for s in range(0, max(len(text) - overlap, 1), step)] if text else []


@pytest.mark.parametrize("size,overlap", [(512, 64), (10, 3), (10, 7), (5, 0), (1, 0)])
def test_windows_equal_slicing(spark, size, overlap):
    texts = ["", "a", "x" * 9, "ab\ncd😀é" * 40, "0123456789" * 60, "y" * (2 * size - overlap), "z" * (size + 1)]
    rows = C.chunk_windows(docs_of(spark, texts), [("base", size, overlap)]).collect()
    for i, t in enumerate(texts):
        got = [r.chunk_text for r in sorted(rows, key=lambda r: r.pos) if r.doc_id == i]
        assert got == naive_windows(t, size, overlap), (i, size, overlap)
    assert all(r.char_count == len(r.chunk_text) for r in rows)


def test_windows_of_several_settings(spark):
    rows = C.chunk_windows(docs_of(spark, ["abcdefghij"]), [("a", 4, 1), ("b", 6, 2)]).collect()
    got = {n: [r.chunk_text for r in sorted(rows, key=lambda r: r.pos) if r.experiment == n] for n in "ab"}
    assert got == {"a": ["abcd", "defg", "ghij"], "b": ["abcdef", "efghij"]}


def test_hand_worked_splits():
    split = C.recursive_texts
    assert split("", 10, 0, SEPARATORS) == []
    assert split("short text", 100, 10, SEPARATORS) == ["short text"]
    assert split("aa\n\nbb\n\ncc", 7, 0, SEPARATORS) == ["aa\n\nbb", "cc"]
    # A separator belongs to the piece after it and counts: " three four" has 11 characters.
    assert split("one two three four", 10, 0, SEPARATORS) == ["one two", "three", "four"]
    assert split("one two three four", 11, 0, SEPARATORS) == ["one two", "three four"]
    assert split("one two three four", 10, 4, SEPARATORS) == ["one two", "two three", "four"]
    assert split("abcdefghij", 4, 2, SEPARATORS) == ["abcd", "cdef", "efgh", "ghij"]
    assert split("unbroken text", 4, 0, ["\n"]) == ["unbroken text"]
    assert split("Hi there. Bye now", 10, 0, SEPARATORS) == ["Hi there", ". Bye now"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=200), st.integers(1, 30), st.integers(0, 30))
def test_split_invariants(text, size, overlap):
    overlap = min(overlap, size)
    chunks = C.recursive_texts(text, size, overlap, SEPARATORS)
    for chunk in chunks:
        assert 0 < len(chunk) <= size and chunk == chunk.strip() and chunk in text
    kept = set("".join(chunks))
    assert set(text) - set(" \n") <= kept
    for letter in "ab":
        assert sum(c.count(letter) for c in chunks) >= text.count(letter)


def test_recursive_on_spark_equals_python(spark):
    texts = ["A " * 300, "word " * 500, "", "para one\n\npara two. And more. " * 30]
    docs = docs_of(spark, texts).withColumn("source", F.lit("s"))
    rows = C.chunk_recursive(docs, [("base", 100, 30)]).collect()
    for i, t in enumerate(texts):
        got = [r.chunk_text for r in sorted(rows, key=lambda r: r.pos) if r.doc_id == i]
        assert got == C.recursive_texts(t, 100, 30, SEPARATORS)
    assert {r.source for r in rows} == {"s"}
    smaller = C.chunk_recursive(docs, [("base", 50, 10)]).count()
    assert smaller >= len(rows)


def test_overlap_larger_than_size_is_an_error(spark):
    with pytest.raises(ValueError):
        C.chunk_recursive(docs_of(spark, ["a"]), [("base", 10, 11)])
    with pytest.raises(ValueError):
        C.window_texts(F.col("x"), 10, 10)


def test_chunk_index_is_global_and_sequential(spark):
    docs = docs_of(spark, ["x" * (1 + 37 * i % 400) for i in range(600)])
    chunks = C.chunk_windows(docs, [("a", 20, 5), ("b", 30, 5)])
    rows = C.with_chunk_index(chunks, C.chunk_offsets(chunks)).collect()
    for name in "ab":
        ordered = sorted((r for r in rows if r.experiment == name), key=lambda r: (r.doc_id, r.pos))
        assert [r.chunk_index for r in ordered] == list(range(len(ordered)))


def test_shared_text_of_neighbours(spark):
    rows = [("base", 0, 0, "abcdef"), ("base", 0, 1, "efgh"), ("base", 0, 2, "xy"), ("base", 1, 0, "gh")]
    chunks = spark.createDataFrame(rows, "experiment string, doc_id bigint, pos int, chunk_text string")
    got = {(r.doc_id, r.pos): r.shared_chars for r in C.overlap_with_next(chunks, 3).collect()}
    assert got == {(0, 0): 2, (0, 1): 0}


def test_chunks_round_trip(spark, tmp_path):
    docs = docs_of(spark, ["hello é\nworld " * 20]).withColumns(
        {"source": F.lit("/a/b.txt"), "filename": F.lit("b.txt"), "file_type": F.lit("txt")}
    )
    chunks = C.chunk_recursive(docs, [("base", 50, 10)])
    chunks = C.with_chunk_index(chunks, C.chunk_offsets(chunks))
    path = str(tmp_path / "deep" / "chunks")
    save_chunks(chunks, path)
    names = ["chunk_text", "source", "filename", "file_type", "char_count", "chunk_index"]
    got = load_chunks(spark, path).select(names).orderBy("chunk_index").collect()
    assert got == chunks.select(names).orderBy("chunk_index").collect()
