"""Tables that outlive a run: chunks, embedding cache, index and result files."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import time
from collections.abc import Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark import hooks
from evalspark.functions.vectors import as_double, normalize
from evalspark.operators import cache as cache_ops
from evalspark.operators import changes
from evalspark.operators.chunking import chunk_offsets, chunk_recursive, chunk_windows
from evalspark.operators.embedding import TFIDF
from evalspark.operators.postings import build_postings
from evalspark.operators.textsearch import CHUNK, chunk_frequency, chunk_words, scaled_words, with_idf, with_vector
from evalspark.session import shared_dir, stage, tidy
from evalspark.settings import Settings

CHUNK_METADATA = ("source", "filename", "file_type", "char_count", "chunk_index")
# Part of the fingerprint; raise it when the tables of an index change.
FORMAT = 4
INDEX_TABLES = ("chunks", "terms", "vectors", "offsets")
# What the next build of a changed corpus starts from: words of each chunk, digest of each document.
WORDS, STATE = "words", "state"
# Only where the settings search by it.
POSTINGS = "postings"
# Postings are built in at most so many shares, each of so many chunks if they suffice.
MOST_SHARES, CHUNKS_PER_SHARE = 8, 200_000
# One row per build of a root, so that a build finds the one before it.
BUILDS = "builds"
BUILD_SCHEMA = "shape string, mark string, started double"
# Written last, so an index without it is unfinished.
DONE = "done"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds a table that can be read."""
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def save_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines of ``{content, metadata}``; parent folders are made."""
    kept = [c for c in CHUNK_METADATA if c in chunks.columns]
    chunks.select(
        F.col("chunk_text").alias("content"), F.struct(*kept).alias("metadata")
    ).write.mode("overwrite").json(path)


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "content string, metadata struct<source:string, filename:string, file_type:string, "
        "char_count:int, chunk_index:bigint>"
    )
    return spark.read.schema(schema).json(path).select(
        F.col("content").alias("chunk_text"), "metadata.*"
    )


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """The embedding cache, one row per model and text; empty when there is none yet.

    The schema is given, so that a model's name stays text. Keys are kept apart when they are
    added, so nothing is shuffled here.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], cache_ops.SCHEMA)
    return spark.read.schema(cache_ops.SCHEMA).parquet(path).select("model", "text_sha", "embedding")


def append_cache(new: DataFrame, path: str) -> None:
    """Add the keys that the cache lacks, each once; what is stored is not written again.

    An append that is repeated, as a stream or a failed build does, adds nothing. Appends to one
    cache have to follow one another: two at the same time may both add a key.
    """
    rows = new.select("text_sha", "embedding", "model").dropDuplicates(cache_ops.KEY)
    stored = load_cache(new.sparkSession, path).select(*cache_ops.KEY)
    rows.join(stored, cache_ops.KEY, "left_anti").select("text_sha", "embedding", "model").write.mode("append").partitionBy(
        "model"
    ).parquet(path)


@dataclasses.dataclass(frozen=True)
class Index:
    """Searchable form of a corpus under one or more experiments.

    ``vectors`` are of length 1 for a registered model; of words they are tf / length, packed, see ``textsearch``.
    """

    chunks: DataFrame
    terms: DataFrame
    vectors: DataFrame
    offsets: DataFrame
    experiments: tuple[str, ...]
    postings: DataFrame | None = None
    # Folder of the embedding cache that the index was made with.
    cache: str | None = None


def text_mark(docs: DataFrame) -> str:
    """Changes with any document, whatever column it is in; reads them all."""
    row = F.xxhash64(*sorted(docs.columns))
    digest = docs.agg(F.count("*"), F.bit_xor(row), F.sum(row.cast("decimal(20,0)"))).head()
    return str(tuple(map(str, digest)))


def file_mark(scan: DataFrame) -> str:
    """Changes with any file of a file scan; reads their names, sizes and times only."""
    files = scan.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    row = F.xxhash64("file_path", "file_size", "file_modification_time")
    digest = files.agg(F.count("*"), F.bit_xor(row), F.sum(row.cast("decimal(20,0)"))).head()
    return str(tuple(map(str, digest)))


def shape_of(runs: Sequence[tuple[str, Settings]]) -> list[tuple]:
    """The settings that shape an index."""
    return [
        (name, s.chunk_size, s.chunk_overlap, s.splitter, s.separators, s.embedding_provider, s.embedding_model)
        + ((s.search_backend,) if s.search_backend != "scan" else ())
        for name, s in runs
    ]


def fingerprint(corpus: str, runs: Sequence[tuple[str, Settings]]) -> str:
    """Changes with the corpus and with any setting that shapes the index."""
    return hashlib.sha256(json.dumps([FORMAT, corpus, shape_of(runs)]).encode()).hexdigest()


def cache_folder(root: str, settings: Settings) -> str | None:
    return None if settings.embedding_provider == TFIDF else f"{root}/cache"


def load_index(spark: SparkSession, root: str, mark: str, experiments: Sequence[str], cache: str | None = None) -> Index | None:
    """The index saved under this fingerprint, or None."""
    folder = f"{root}/{mark}"
    if not exists(spark, f"{folder}/{DONE}"):
        return None
    postings = spark.read.parquet(f"{folder}/{POSTINGS}") if exists(spark, f"{folder}/{POSTINGS}") else None
    chunks, terms, vectors, offsets = [spark.read.parquet(f"{folder}/{name}") for name in INDEX_TABLES]
    return Index(chunks, terms, readable(vectors), offsets, tuple(experiments), postings, cache)


def readable(vectors: DataFrame) -> DataFrame:
    """Vectors of words are stored packed."""
    return with_vector(vectors) if "terms" in vectors.columns else vectors


def through_cache(texts: DataFrame, text: str, settings: Settings, path: str) -> DataFrame:
    """``model, text_sha, embedding`` of all of ``texts(model, text_sha, text)``, and more; those
    that the cache lacks are embedded and added to it now."""
    spark = texts.sparkSession
    misses = cache_ops.cache_misses(texts, load_cache(spark, path), text)
    append_cache(hooks.embedder(settings.embedding_provider, text, model=settings.embedding_model)(misses), path)
    return load_cache(spark, path)


def cached_vectors(chunks: DataFrame, settings: Settings, path: str) -> DataFrame:
    """Chunk vectors of a registered model; only texts that the cache lacks are embedded."""
    texts = cache_ops.keyed(chunks, settings.embedding_model, "chunk_text")
    # Chunks of one text share one cache row, so AQE can split the side of the chunks.
    return texts.select(*CHUNK, *cache_ops.KEY).join(through_cache(texts, "chunk_text", settings, path), cache_ops.KEY).select(
        *CHUNK, normalize(as_double(F.col("embedding"))).alias("vector")
    )


def family(runs: Sequence[tuple[str, Settings]]) -> str:
    """Names the builds that differ in their documents only: one can start from another."""
    return hashlib.sha256(json.dumps([FORMAT, shape_of(runs)]).encode()).hexdigest()


def newest_build(spark: SparkSession, root: str, runs: Sequence[tuple[str, Settings]], but: str | None = None) -> str | None:
    """Mark of the last finished build with these settings, other than ``but``.

    Builds are noted before they are marked as done, so none that is done is missing here.
    """
    if not exists(spark, f"{root}/{BUILDS}"):
        return None
    builds = spark.read.schema(BUILD_SCHEMA).parquet(f"{root}/{BUILDS}").filter(F.col("shape") == family(runs))
    for build in builds.groupBy("mark").agg(F.max("started").alias("started")).orderBy(F.desc("started")).toLocalIterator():
        if build.mark != but and exists(spark, f"{root}/{build.mark}/{DONE}"):
            return build.mark
    return None


def newest_index(spark: SparkSession, root: str, runs: Sequence[tuple[str, Settings]]) -> Index | None:
    """The index that was built last under ``root`` with these settings, as by a stream; None without one."""
    mark = newest_build(spark, root, runs)
    return load_index(spark, root, mark, [name for name, _ in runs], cache_folder(root, runs[0][1])) if mark else None


def build_index(
    docs: DataFrame,
    runs: Sequence[tuple[str, Settings]],
    root: str,
    mark: str,
    anew: bool = False,
    only_ids: DataFrame | None = None,
) -> Index:
    """Chunk, count and weigh ``docs(doc_id, text, filename, ...)`` and save the result.

    Every table is written once and read back by the steps after it, so nothing is
    computed twice and a lost executor costs only its own tasks. Each chunk is split into
    words once. Rows lie sorted by ``doc_id`` in each file, for lookups by range.

    If this root holds a build of the same settings, only documents that differ from it are cut,
    counted and embedded; rows of the others are copied, and those of removed ones left out.
    Document frequencies are mended by the words lost and added. The result is that of a build
    ``anew``. With ``only_ids(doc_id)``, ``docs`` holds just the new rows of these documents (none
    for a removed one), and all others are as they were.
    """
    spark = docs.sparkSession
    folder = f"{root}/{mark}"

    def save(table: DataFrame, name: str, *order: str, mode: str = "overwrite") -> DataFrame:
        with tidy(spark):
            (table.sortWithinPartitions(*order) if order else table).write.mode(mode).option(
                "compression", "zstd"
            ).parquet(f"{folder}/{name}")
        return spark.read.schema(table.schema).parquet(f"{folder}/{name}")

    shapes = {(s.splitter, s.separators, s.embedding_provider, s.embedding_model) for _, s in runs}
    if len(shapes) != 1:
        raise ValueError("the runs of one index share splitter, separators and embedding model")
    splitter, separators, provider, _ = shapes.pop()
    if provider != TFIDF and any(s.search_backend == POSTINGS for _, s in runs):
        raise ValueError("postings are of words: they need the tfidf embedding")
    sizes = [(name, s.chunk_size, s.chunk_overlap) for name, s in runs]
    earlier = None if anew else newest_build(spark, root, runs, but=mark)

    def before(name: str) -> DataFrame:
        return spark.read.parquet(f"{root}/{earlier}/{name}")

    def cut(docs: DataFrame) -> DataFrame:
        return chunk_recursive(docs, sizes, separators) if splitter == "recursive" else chunk_windows(docs, sizes)

    if earlier and sorted(before("chunks").dtypes) != sorted(cut(docs).dtypes):
        if only_ids is not None:
            raise ValueError(f"the index holds chunks {before('chunks').dtypes}, the change {cut(docs).dtypes}")
        earlier = None
    spark.createDataFrame([(family(runs), mark, time.time())], BUILD_SCHEMA).coalesce(1).write.mode("append").parquet(
        f"{root}/{BUILDS}"
    )
    state = changes.digests(docs)
    ids = only_ids
    if earlier and ids is not None:
        state = changes.without(before(STATE), ids).unionByName(state)
    state = save(state, STATE, "doc_id")
    if earlier and ids is None:
        ids = stage(changes.touched(before(STATE), state), spark)
        docs = changes.only(docs, ids)

    # A digest starts with the number of rows of its id. Staged, as few ids then leave the chunks in place.
    repeated = stage(state.filter(F.substring_index("digest", " ", 1).cast("long") > 1).select("doc_id"), spark)
    if not earlier:
        chunks = save(cut(docs), "chunks", "doc_id", "pos")
        words = save(chunk_words(chunks, repeated), WORDS, "doc_id", "pos")
        frequency = chunk_frequency(words)
    else:
        fresh = stage(cut(docs), spark)
        added = stage(chunk_words(fresh, repeated), spark)
        lost = changes.only(before(WORDS), ids)
        chunks = save(changes.without(before("chunks"), ids).unionByName(fresh), "chunks", "doc_id", "pos")
        words = save(changes.without(before(WORDS), ids).unionByName(added), WORDS, "doc_id", "pos")
        frequency = changes.mended_frequency(before("terms"), chunk_frequency(lost), chunk_frequency(added))
    terms = save(with_idf(frequency, chunks), "terms")
    offsets = save(chunk_offsets(chunks), "offsets", "doc_id")
    if provider == TFIDF:
        # Every length holds the number of chunks, so all are weighed anew; no text is read.
        vectors = scaled_words(words, terms, terms.count(), offsets)
    else:
        cache = cache_folder(root, runs[0][1])
        if not earlier:
            vectors = cached_vectors(chunks, runs[0][1], cache)
        else:
            vectors = changes.without(before("vectors"), ids).unionByName(cached_vectors(fresh, runs[0][1], cache))
    vectors = readable(save(vectors, "vectors", "doc_id", "pos"))
    postings = None
    if any(s.search_backend == POSTINGS for _, s in runs):
        # What is moved at once does not grow beyond a share, and goes when that is written.
        shares = min(MOST_SHARES, 1 + (terms.agg(F.max("n_chunks")).first()[0] or 0) // CHUNKS_PER_SHARE)
        for share in range(shares):
            part = build_postings(vectors, offsets, share=share, shares=shares)
            postings = save(part, POSTINGS, mode="append" if share else "overwrite")
    save(spark.range(1), DONE)
    return Index(chunks, terms, vectors, offsets, tuple(name for name, _ in runs), postings, cache_folder(root, runs[0][1]))


def update_index(
    changed: DataFrame, runs: Sequence[tuple[str, Settings]], root: str, key: str, removed: DataFrame | None = None
) -> Index:
    """The newest index of ``root`` with the documents in ``changed`` put in the place of those with
    their ids, and those in ``removed(doc_id)`` taken out; the other documents are not read.

    ``key`` names the change. A change that is given again under its key finds its index and does
    nothing. Without an earlier index, ``changed`` is the corpus.
    """
    spark = changed.sparkSession
    mark = fingerprint(f"change {key}", runs)
    found = load_index(spark, root, mark, [name for name, _ in runs], cache_folder(root, runs[0][1]))
    if found:
        return found
    changed = stage(changed, spark)
    ids = changed.select("doc_id")
    if removed is not None:
        # A document that is both removed and given is removed.
        removed = stage(removed.select("doc_id"), spark)
        ids, changed = ids.unionByName(removed), changes.without(changed, removed)
    return build_index(changed, runs, root, mark, only_ids=stage(ids.distinct(), spark))


def load_or_build_index(
    docs: DataFrame,
    runs: Sequence[tuple[str, Settings]],
    root: str | None = None,
    rebuild: bool = False,
    corpus: str | None = None,
) -> Index:
    """A saved index is used only if corpus and settings are those it was built from.

    ``corpus`` names the state of the documents, as ``file_mark`` or a table version
    does; without it all texts are read to tell. A changed corpus starts from the last build of
    the same settings, unless a ``rebuild`` is asked for.
    """
    spark = docs.sparkSession
    root = root or f"{shared_dir(spark)}/index"
    mark = fingerprint(corpus or text_mark(docs), runs)
    found = None if rebuild else load_index(spark, root, mark, [name for name, _ in runs], cache_folder(root, runs[0][1]))
    return found or build_index(docs, runs, root, mark, rebuild)


# The names of result files, with the time they were made.
SCORES_FILE = "ragas_{}_{}.csv"
SUMMARY_FILE = "experiment_{}.csv"


def stamp(now: datetime | None = None) -> str:
    return (now or datetime.now()).strftime("%Y%m%d_%H%M%S")


def flat(table: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for CSV."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return table.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in table.schema.fields
        ]
    )


def save_scores(scores: DataFrame, results: str, name: str = "eval", now: datetime | None = None) -> str:
    """Scores per question, one folder per experiment."""
    path = f"{results}/{SCORES_FILE.format(name, stamp(now))}"
    flat(scores).write.option("header", True).partitionBy("experiment").csv(path)
    return path


def save_summary(summary: DataFrame, results: str, now: datetime | None = None) -> str | None:
    """One row per experiment in one file; nothing is written without rows.

    Experiments are the settings of a sweep, so one task can hold them.
    """
    if summary.isEmpty():
        return None
    path = f"{results}/{SUMMARY_FILE.format(stamp(now))}"
    summary.coalesce(1).write.option("header", True).csv(path)
    return path
