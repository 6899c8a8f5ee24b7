"""TF-IDF vectors of chunks and questions, and exact top-k between them.

All tables are keyed by ``experiment``, so that a sweep is one job:

- ``terms``    experiment, term, df, n_chunks, idf
- ``words``    experiment, doc_id, pos, terms, counts (packed, see ``functions.packed``)
- ``vectors``  experiment, doc_id, pos, number, length, terms, counts, and vector array<struct<term,weight>> on reading

The vectors of an index are tf / length, where length is that of the TF-IDF vector: without idf
they need no words moved to be weighed, only a number per chunk. The idf of a word goes to the
question instead (``with_idf_of_chunks``), which gives the same cosine.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions import packed
from evalspark.functions.text import tokens
from evalspark.operators import blocks, changes
from evalspark.session import stage

CHUNK = ["experiment", "doc_id", "pos"]
# A term table up to this many rows is broadcast: some 100 bytes each in memory.
BROADCAST_TERMS = 1_000_000
# Words of questions or answers that are sent to the terms.
BROADCAST_WORDS = 200_000
# Chunks whose words are counted in one step.
ROWS_PER_STEP = 10_000
# Packed words that one step counts or weighs.
BYTES_PER_STEP = 16_000_000
PACKED = [T.StructField("terms", T.StringType()), T.StructField("counts", T.StringType())]


def term_counts(chunks: DataFrame) -> DataFrame:
    """``experiment, doc_id, pos, term, tf``.

    Chunks that come from documents spread by ``doc_id`` are counted where they
    are: that hash clusters the longer key as well, so nothing is shuffled.
    """
    return (
        chunks.select(*CHUNK, F.explode(tokens(F.col("chunk_text"))).alias("term"))
        .groupBy(*CHUNK, "term")
        .agg(F.count("*").alias("tf"))
    )


def chunk_words(chunks: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """``experiment, doc_id, pos, terms, counts``, the words packed and sorted; chunks without words have no row.

    The words of a chunk, so as bounded as its text; split and counted where the chunk is read, without a
    shuffle. Chunks of one key, as documents that share an id have them, count as one: only those of
    the ids in ``repeated(doc_id)`` are gathered. Without it, all are.
    """
    together = chunks if repeated is None else changes.only(chunks, repeated)
    words = F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("words")
    gathered = term_counts(together).groupBy(*CHUNK).agg(words).select(*CHUNK, *packed.pack(F.col("words")))
    if repeated is None:
        return gathered
    single = changes.without(chunks, repeated).select(*CHUNK, F.lower("chunk_text").alias("text"))
    schema = T.StructType([*(chunks.schema[name] for name in CHUNK), *PACKED])
    return single.mapInArrow(count_words, schema).unionByName(gathered)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, len(whole), ROWS_PER_STEP):
            batch = whole.slice(at, ROWS_PER_STEP)
            length, words = packed.split_words(batch["text"], packed.BREAKS)
            if not len(words):
                continue
            coded = words.dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            row = np.repeat(np.arange(len(batch)), length)
            found, tf = np.unique(row * len(order) + place[coded.indices.to_numpy()], return_counts=True)
            row, word = np.divmod(found, len(order))
            n = np.bincount(row, minlength=len(batch))
            kept = np.flatnonzero(n)
            terms = packed.joined(n[kept], coded.dictionary.take(pa.array(order[word])))
            counts = packed.joined(n[kept], pa.array(tf).cast(pa.string()))
            columns = [batch[name].take(pa.array(kept)) for name in CHUNK]
            yield pa.RecordBatch.from_arrays([*columns, terms, counts], names=[*CHUNK, "terms", "counts"])


def words_counted(words: DataFrame) -> DataFrame:
    """Words of chunks as the rows of ``term_counts``."""
    return words.select(*CHUNK, F.inline(packed.unpack("tf", lambda n: n)))


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Neighbouring batches together, until they hold ``BYTES_PER_STEP``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= BYTES_PER_STEP:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def chunk_frequency(words: DataFrame) -> DataFrame:
    """``experiment, term, df``: chunks that hold the term. A task counts before it gives rows away."""
    schema = T.StructType([words.schema["experiment"], T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            if not len(part):
                continue
            length, terms = packed.split_words(blocks.one(part["terms"]))
            names, coded = blocks.one(part["experiment"]).dictionary_encode(), terms.dictionary_encode()
            name = np.repeat(names.indices.to_numpy().astype(np.int64), length)
            n = np.bincount(name * len(coded.dictionary) + coded.indices.to_numpy())
            found = np.flatnonzero(n)
            name, term = np.divmod(found, max(1, len(coded.dictionary)))
            columns = [names.dictionary.take(pa.array(name)), coded.dictionary.take(pa.array(term)), pa.array(n[found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return words.select("experiment", "terms").mapInArrow(count, schema).groupBy("experiment", "term").agg(F.sum("n").alias("df"))


def with_idf(frequency: DataFrame, chunks: DataFrame) -> DataFrame:
    """``experiment, term, df, n_chunks, idf``, smoothed."""
    n_chunks = chunks.groupBy("experiment").agg(F.count("*").alias("n_chunks"))
    # One row per experiment, and experiments are the settings of a sweep.
    return frequency.join(F.broadcast(n_chunks), "experiment").withColumn(
        "idf", F.ln((1 + F.col("n_chunks")) / (1 + F.col("df"))) + 1
    )


def term_table(chunks: DataFrame) -> DataFrame:
    """Document frequency and smoothed inverse document frequency of each term.

    Each chunk gives its distinct terms once, so the count needs no counts per chunk.
    """
    words = chunks.select("experiment", F.explode(F.array_distinct(tokens(F.col("chunk_text")))).alias("term"))
    return with_idf(words.groupBy("experiment", "term").agg(F.count("*").alias("df")), chunks)


def lowest_common(terms: DataFrame, most: int) -> int:
    """The smallest document frequency that at most ``most`` terms reach."""
    # One row per frequency: their number grows with the root of the count of words at most.
    found, total = None, 0
    for row in terms.groupBy("df").agg(F.count("*").alias("n")).orderBy(F.desc("df")).toLocalIterator():
        total += row.n
        if total > most:
            break
        found = row.df
    return found or 2**62


def weigh(counts: DataFrame, terms: DataFrame, n_terms: int, most: int = BROADCAST_TERMS) -> DataFrame:
    """Counts with ``raw`` weight tf * idf.

    A small term table goes to all tasks. Beyond the bound only its most frequent terms
    do; they hold most counts and would be the hot keys of a join. The rest meets
    its terms by a shuffle on the term.
    """
    key = ["experiment", "term"]
    columns = [*CHUNK, "term", (F.col("tf") * F.col("idf")).alias("raw")]
    if n_terms <= most:
        return counts.join(F.broadcast(terms.select(*key, "idf")), key).select(*columns)
    is_common = F.col("df") >= lowest_common(terms, most)
    common = F.broadcast(terms.filter(is_common).select(*key, "idf"))
    rare = terms.filter(~is_common).select(*key, "idf")
    return (
        counts.join(common, key)
        .select(*columns)
        .unionByName(counts.join(common, key, "left_anti").join(rare, key).select(*columns))
    )


def same_chunk(one: DataFrame, two: DataFrame):
    """Chunk keys that are equal; null ids count as equal."""
    return (one["experiment"] == two["_experiment"]) & one["doc_id"].eqNullSafe(two["_doc_id"]) & (one["pos"] == two["_pos"])


def squares(words: DataFrame, terms: DataFrame, n_terms: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """``experiment, doc_id, pos, term, value`` twice: sums of (tf * idf)^2 over the common words of a chunk, without
    a term; and the tf of its other words, or None if all terms are common.

    Terms as in ``weigh``: those that are sent around are looked up once per step and word, not per posting.
    """
    spark = words.sparkSession
    common = terms if n_terms <= most else terms.filter(F.col("df") >= lowest_common(terms, most))
    table = common.select("experiment", "term", "idf").toArrow().combine_chunks()
    known = {}
    for name in pc.unique(table["experiment"]).to_pylist():
        part = table.filter(pc.equal(table["experiment"], name))
        known[name] = blocks.one(part["term"]), part["idf"].to_numpy()
    shared = spark.sparkContext.broadcast(known)
    more = [T.StructField("term", T.StringType()), T.StructField("value", T.DoubleType())]
    schema = T.StructType([*(words.schema[name] for name in CHUNK), *more])

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            for name in pc.unique(step["experiment"]).to_pylist():
                part = step.filter(pc.equal(step["experiment"], name)).combine_chunks()
                found, idf = shared.value.get(name, (pa.array([], pa.string()), np.zeros(0)))
                length, words = packed.split_words(blocks.one(part["terms"]))
                coded = words.dictionary_encode()
                at = pc.fill_null(pc.index_in(coded.dictionary, value_set=found), len(idf)).to_numpy()
                idf = np.append(idf, np.nan)[at][coded.indices.to_numpy()]
                tf = packed.numbers(blocks.one(part["counts"]))
                row = np.repeat(np.arange(len(part)), length)
                rare = np.isnan(idf)
                total = np.bincount(row, np.where(rare, 0.0, (tf * idf) ** 2), len(part))
                keys = [blocks.one(part[c]) for c in CHUNK]
                yield pa.RecordBatch.from_arrays([*keys, pa.nulls(len(part), pa.string()), pa.array(total)], names=schema.names)
                rest = pa.array(np.flatnonzero(rare))
                if len(rest):
                    keys = [c.take(pa.array(row[rare])) for c in keys]
                    yield pa.RecordBatch.from_arrays([*keys, words.take(rest), pa.array(tf[rare], pa.float64())], names=schema.names)

    sums = words.select(*CHUNK, "terms", "counts").mapInArrow(weighed, schema)
    if n_terms <= most:
        return sums, None
    sums = stage(sums, spark)
    return sums.filter("term IS NULL"), sums.filter("term IS NOT NULL")


def chunk_lengths(words: DataFrame, terms: DataFrame, n_terms: int, most: int = BROADCAST_TERMS) -> DataFrame:
    """``experiment, doc_id, pos, length`` of the TF-IDF vector of each chunk."""
    sums, rest = squares(words, terms, n_terms, most)
    sums = sums.select(*CHUNK, "value")
    if rest is not None:
        raw = F.col("value") * F.col("idf")
        others = terms.filter(F.col("df") < lowest_common(terms, most)).select("experiment", "term", "idf")
        rare = rest.join(others, ["experiment", "term"]).select(*CHUNK, (raw * raw).alias("value"))
        sums = sums.unionByName(rare).groupBy(*CHUNK).agg(F.sum("value").alias("value"))
    return sums.select(*CHUNK, F.sqrt("value").alias("length"))


def scaled_words(words: DataFrame, terms: DataFrame, n_terms: int, offsets: DataFrame) -> DataFrame:
    """``experiment, doc_id, pos, number, length, terms, counts``: packed words with the length of their TF-IDF
    vector, and the number of the chunk by ``offsets`` (null where its id is null).

    What a task sums for a chunk is one number, and the sums of rare words meet it as such.
    """
    lengths = (
        chunk_lengths(words, terms, n_terms)
        .join(offsets, ["experiment", "doc_id"], "left")
        .withColumn("number", F.col("first_index") + F.col("pos"))
        .drop("first_index")
        .withColumnsRenamed({name: f"_{name}" for name in CHUNK})
    )
    words = words.select(*CHUNK, "terms", "counts")
    return words.join(lengths, same_chunk(words, lengths)).select(*CHUNK, "number", "length", "terms", "counts")


def with_vector(scaled: DataFrame) -> DataFrame:
    """Rows of ``scaled_words`` and their ``vector``: weight tf / length of each word. It is made only where it is read."""
    return scaled.withColumn("vector", packed.unpack("weight", lambda n: n / F.col("length")))


def meeting(words: DataFrame, terms: DataFrame, key: Sequence[str] = ("experiment", "term")) -> DataFrame:
    """``words`` and what ``terms`` has of them. The words of questions or answers go to the terms, which are not moved,
    unless they are many."""
    words = stage(words, words.sparkSession)
    few = words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    return terms.join(F.broadcast(words) if few else words, list(key))


def with_idf_of_chunks(vectors: DataFrame, keys: list[str], terms: DataFrame) -> DataFrame:
    """``experiment, *keys, vector`` with each weight times the idf of its word."""
    weight = F.struct(F.col("term"), (F.col("weight") * F.col("idf")).alias("weight"))
    words = vectors.select("experiment", *keys, F.inline("vector"))
    return (
        meeting(words, terms.select("experiment", "term", "idf"))
        .groupBy("experiment", *keys)
        .agg(F.collect_list(weight).alias("vector"))
    )


def unit_vectors(weighed: DataFrame, keys: list[str]) -> DataFrame:
    """``experiment, *keys, vector``: weights gathered and scaled to length 1.

    A group is the distinct words of one text, so its size is that of a row.
    """
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length")
    return (
        weighed.groupBy("experiment", *keys)
        .agg(F.collect_list(F.struct("term", "raw")).alias("words"), length)
        .select(
            "experiment",
            *keys,
            F.transform(
                "words",
                lambda x: F.struct(
                    x["term"].alias("term"), (x["raw"] / F.col("length")).alias("weight")
                ),
            ).alias("vector"),
        )
    )


def text_vectors(texts: DataFrame, keys: list[str], text: str, terms: DataFrame) -> DataFrame:
    """Vectors of any texts, by the corpus statistics of each experiment in ``terms``.

    Words that the corpus does not hold drop out.
    """
    own = ["experiment"] if "experiment" in texts.columns else []
    counts = (
        texts.select(*own, *keys, F.explode(tokens(F.col(text))).alias("term")).groupBy(*own, *keys, "term").agg(F.count("*").alias("tf"))
    )
    weighed = (
        meeting(counts, terms.select("experiment", "term", "idf"), [*own, "term"])
        .select("experiment", *keys, "term", (F.col("tf") * F.col("idf")).alias("raw"))
    )
    return unit_vectors(weighed, keys)


def topk_chunks(asked: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact top ``k`` chunks by cosine: ``experiment, qid, rank, doc_id, pos, sim``.

    ``asked(experiment, qid, vector)`` holds vectors of the kind in ``vectors``. Scores
    are rounded before ranking, so copies tie and the first chunk leads. Packed vectors are
    scored as they are stored.
    """
    vector = F.struct("terms", "counts", "length") if "terms" in vectors.columns else F.col("vector")
    found = blocks.topk(
        vectors.select(F.col("experiment").alias("cell"), "doc_id", "pos", vector.alias("vector")),
        asked.withColumnRenamed("experiment", "cell"),
        ["doc_id", "pos"],
        k,
    )
    return found.withColumnRenamed("cell", "experiment")
