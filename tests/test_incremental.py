"""An index after a change equals a fresh one; unchanged documents are not cut again."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark import hooks
from evalspark.operators import changes
from evalspark.operators.lookups import RANGES, covering_ranges, narrowed
from evalspark.plans import rag
from evalspark.settings import Settings
from evalspark.sources import tables
from evalspark.streaming.incremental import index_stream


def letters():
    return lambda texts: np.array([[t.lower().count(c) for c in "aeiourst"] for t in texts], np.float32)


hooks.register_embedder("letters_counted", letters)
SMALL = Settings(chunk_size=40, chunk_overlap=8, k=3, search_backend="postings")
DENSE = Settings(chunk_size=40, chunk_overlap=8, k=3, embedding_provider="letters_counted", embedding_model="l")
DOCS = "doc_id bigint, text string, filename string"


def runs(settings):
    return [("base", settings), ("wide", settings.variant({"chunking.chunk_size": 90}))]


def changed(spark, corpus):
    """One document other, one only renamed, one gone, one new, one null, one without an id."""
    rows = [
        (1, "Dogs bark at cats. Dogs fetch sticks and balls in the garden.", "file1.txt"),
        (2, None, "file2.txt"),
        (4, "Whales sing in the sea. Whales are not fish.", "file4.txt"),
        (None, "A text that lost its number.", "file5.txt"),
    ]
    renamed = corpus.filter("doc_id = 0").withColumn("filename", F.lit("other.txt"))
    return renamed.unionByName(spark.createDataFrame(rows, DOCS))


def content(table, digits=9):
    """Rows as sorted text, with numbers rounded: sums of doubles depend on their order."""

    def plain(value):
        if isinstance(value, float):
            return round(value, digits)
        if isinstance(value, (list, tuple)):
            parts = [plain(x) for x in value]
            return sorted(parts, key=repr) if isinstance(value, list) and value and isinstance(value[0], tuple) else parts
        return value

    columns = sorted(table.columns)
    return sorted(repr([plain(r[c]) for c in columns]) for r in table.select(*columns).collect())


def same_index(mine, fresh):
    for name in ("chunks", "terms", "vectors", "offsets", "postings"):
        a, b = getattr(mine, name), getattr(fresh, name)
        assert (a is None) == (b is None)
        if a is not None:
            assert content(a) == content(b), name


@pytest.mark.parametrize("settings", [SMALL, DENSE], ids=["words", "model"])
@pytest.mark.parametrize("splitter", ["recursive", "windows"])
def test_change_equals_fresh(spark, corpus, tmp_path, settings, splitter):
    settings = dataclasses.replace(settings, splitter=splitter)
    after = changed(spark, corpus)
    tables.load_or_build_index(corpus, runs(settings), f"{tmp_path}/a")
    mine = tables.load_or_build_index(after, runs(settings), f"{tmp_path}/a")
    same_index(mine, tables.load_or_build_index(after, runs(settings), f"{tmp_path}/b"))
    back = tables.load_or_build_index(corpus.filter("doc_id != 3"), runs(settings), f"{tmp_path}/a")
    same_index(back, tables.load_or_build_index(corpus.filter("doc_id != 3"), runs(settings), f"{tmp_path}/c"))


def test_only_changed_documents_are_cut(spark, corpus, tmp_path, monkeypatch):
    cut = []
    real = tables.chunk_recursive

    def noted(docs, *rest):
        cut.append(docs)
        return real(docs, *rest)

    monkeypatch.setattr(tables, "chunk_recursive", noted)
    root = str(tmp_path)
    tables.load_or_build_index(corpus, runs(SMALL), root)
    more = corpus.unionByName(spark.createDataFrame([(9, "Geese fly south.", "f")], DOCS))
    tables.load_or_build_index(more, runs(SMALL), root)
    assert [r.doc_id for r in cut[-1].collect()] == [9]
    tables.load_or_build_index(more, runs(SMALL), root, rebuild=True)
    assert cut[-1].count() == 5


def test_other_columns_build_anew(spark, corpus, tmp_path):
    root = str(tmp_path)
    tables.load_or_build_index(corpus, runs(SMALL), root)
    wider = corpus.withColumn("_touched_id", F.lit(1)).withColumn("digest", F.lit("x"))
    mine = tables.load_or_build_index(wider, runs(SMALL), root)
    assert {"_touched_id", "digest"} <= set(mine.chunks.columns)
    # The same columns again, now by difference.
    less = tables.load_or_build_index(wider.filter("doc_id > 0"), runs(SMALL), root)
    same_index(less, tables.load_or_build_index(wider.filter("doc_id > 0"), runs(SMALL), f"{root}/b"))
    with pytest.raises(ValueError, match="the index holds chunks"):
        tables.update_index(corpus, runs(SMALL), root, "narrow")


def test_empty_states(spark, corpus, tmp_path):
    root = str(tmp_path)
    none = spark.createDataFrame([], DOCS)
    assert tables.load_or_build_index(none, runs(SMALL), root).chunks.count() == 0
    full = tables.load_or_build_index(corpus, runs(SMALL), root)
    same_index(full, tables.load_or_build_index(corpus, runs(SMALL), f"{root}/b"))
    assert tables.load_or_build_index(none, runs(SMALL), root, corpus="again none").terms.count() == 0


def test_update_by_ids(spark, corpus, tmp_path):
    root = str(tmp_path)
    tables.load_or_build_index(corpus, runs(SMALL), root)
    change = spark.createDataFrame([(1, "Dogs sleep.", "file1.txt"), (7, "Owls hunt mice at night.", "file7.txt")], DOCS)
    gone = spark.createDataFrame([(2,), (7,)], "doc_id bigint")
    mine = tables.update_index(change, runs(SMALL), root, "one", gone)
    want = corpus.filter("doc_id in (0, 3)").unionByName(change.filter("doc_id = 1"))
    same_index(mine, tables.load_or_build_index(want, runs(SMALL), f"{root}/b"))
    # Under its key a change is made once.
    again = tables.update_index(change.filter("doc_id = 1").withColumn("text", F.lit("x")), runs(SMALL), root, "one")
    same_index(again, mine)
    same_index(tables.newest_index(spark, root, runs(SMALL)), mine)
    assert tables.newest_index(spark, root, [("base", SMALL)]) is None


def test_unfinished_build_is_no_start(spark, corpus, tmp_path, monkeypatch):
    root = str(tmp_path)
    first = tables.load_or_build_index(corpus, runs(SMALL), root)
    with monkeypatch.context() as broken:
        broken.setattr(tables, "chunk_offsets", lambda chunks: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            tables.load_or_build_index(corpus.filter("doc_id = 1"), runs(SMALL), root)
    same_index(tables.newest_index(spark, root, runs(SMALL)), first)
    mine = tables.load_or_build_index(corpus.filter("doc_id = 1"), runs(SMALL), root)
    same_index(mine, tables.load_or_build_index(corpus.filter("doc_id = 1"), runs(SMALL), f"{root}/b"))


def test_stream_feeds_the_index(spark, corpus, questions, tmp_path):
    source, root, checkpoint = (str(tmp_path / n) for n in ("in", "index", "checkpoint"))

    def run():
        stream = spark.readStream.schema(corpus.schema).parquet(source)
        index_stream(stream, runs(SMALL), root, checkpoint).awaitTermination()
        return tables.newest_index(spark, root, runs(SMALL))

    corpus.filter("doc_id < 3").write.mode("append").parquet(source)
    run()
    later = spark.createDataFrame([(0, "Cats hunt mice.", "file0.txt"), (5, "Rain falls.", "file5.txt")], DOCS)
    later.write.mode("append").parquet(source)
    mine = run()
    want = corpus.filter("doc_id in (1, 2)").unionByName(later)
    same_index(mine, tables.load_or_build_index(want, runs(SMALL), str(tmp_path / "fresh")))
    hits = rag.with_text(rag.retrieve(questions, mine, SMALL), mine, numbered=True)
    assert hits.filter("qid = 0 AND experiment = 'base' AND rank = 1").head().chunk_text.startswith("Cats")


def test_digests_and_touched(spark):
    before = spark.createDataFrame([(1, "a", None), (1, "b", None), (2, None, "x"), (None, "n", "n"), (3, "c", "c")], DOCS)
    # Order of an id's rows is no change; a value that moves to another column is one.
    after = spark.createDataFrame([(1, "b", None), (1, "a", None), (2, "x", None), (None, "m", "n"), (3, "c", "c"), (3, "c", "c")], DOCS)
    ids = changes.touched(changes.digests(before), changes.digests(after))
    assert {r.doc_id for r in ids.collect()} == {2, None, 3}


# Lookups


@pytest.mark.parametrize(
    "ids", [[], [5], [None, 5, 5], [0, 1, 2, 3], [-(2**63), 2**63 - 1, 7], list(range(0, 100000, 37)), [2**62 + i for i in range(100)]]
)
def test_ranges_hold_all_ids(spark, ids):
    wanted = spark.createDataFrame([(i,) for i in ids], "doc_id bigint")
    ranges = covering_ranges(wanted)
    assert len(ranges) <= RANGES
    assert all(any(a <= i <= b for a, b in ranges) for i in ids if i is not None)
    assert all(a <= b for a, b in ranges) and all(x[1] + 1 < y[0] for x, y in zip(ranges, ranges[1:]))
    assert narrowed(wanted, ranges).count() == sum(i is not None for i in ids)


def test_gaps_fall_out(spark):
    wanted = spark.createDataFrame([(i,) for i in (1, 2, 500, 1000)], "doc_id bigint")
    assert covering_ranges(wanted) == [(1, 2), (500, 500), (1000, 1000)]


def test_lookups_reach_the_scan(spark, corpus, questions, tmp_path):
    index = tables.load_or_build_index(corpus, runs(SMALL), str(tmp_path))
    index = tables.newest_index(spark, str(tmp_path), runs(SMALL))
    hits = rag.retrieve(questions.filter("qid = 0"), index, SMALL.variant({"retriever.k": 1}))
    ranges = covering_ranges(hits)
    assert 1 <= len(ranges) <= 2
    found = rag.with_text(hits, index, numbered=True)
    plan = found._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line and "GreaterThanOrEqual(doc_id" in line]
    assert len(pushed) >= 2
    # Files are sorted, so a range is a run of rows.
    for table in (index.chunks, index.vectors):
        rows = table.select("doc_id", "pos", F.input_file_name().alias("f"), F.col("_metadata.row_index").alias("i")).collect()
        in_file = sorted(rows, key=lambda r: (r.f, r.i))
        assert all(a.f != b.f or (a.doc_id, a.pos) <= (b.doc_id, b.pos) for a, b in zip(in_file, in_file[1:]))


# Cache


def test_a_repeated_append_is_one(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([("m", "s1", [1.0]), ("m", "s1", [1.0]), ("m", "s2", [2.0])], "model string, text_sha string, embedding array<float>")
    tables.append_cache(rows, path)
    tables.append_cache(rows, path)
    more = spark.createDataFrame([("m", "s2", [9.0]), ("n", "s2", [3.0])], rows.schema)
    tables.append_cache(more, path)
    stored = tables.load_cache(spark, path)
    assert sorted((r.model, r.text_sha, r.embedding[0]) for r in stored.collect()) == [("m", "s1", 1.0), ("m", "s2", 2.0), ("n", "s2", 3.0)]
    assert spark.read.parquet(path).count() == 3
    assert "Exchange" not in stored._jdf.queryExecution().toString()
