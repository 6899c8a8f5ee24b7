"""Text search over an inverted index whose blocks are skipped by score bounds.

Chunks are numbered in document order and cut into blocks of ``BLOCK``. For each word and
block that has it the index holds the block's postings and the largest weight among them:

    experiment, term, block, largest, postings array<struct<doc_id,pos,weight>>, first, last

``first`` and ``last`` mark the ends of a block, whose rows lie in one file one after the other.

The largest weights of a question's words add up to a bound on the score of any chunk of a
block. Each question first scores the ``FIRST`` blocks of highest bound; the k-th score found
there is a floor, and of the other blocks only those whose bound reaches it are scored. Blocks
below hold no chunk of the top k, so the result is exact. Questions that fit into all tasks go to the
postings, which stay where they are (``scored_in_place``); with more questions it is all joins and sums: the
bounds grow with questions and blocks, the postings read with the blocks that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from evalspark.functions.packed import numbers, split_words
from evalspark.operators.blocks import DIGITS, SCORES_PER_STEP, Best, are_few, by_cell, one
from evalspark.session import stage

BLOCK = 256
FIRST = 4
# Rounded scores may exceed a bound by half a digit; sums in another order by far less.
SLACK = 10.0**-DIGITS
ASKED = ["experiment", "qid"]


def build_postings(vectors: DataFrame, offsets: DataFrame, block: int = BLOCK, share: int = 0, shares: int = 1) -> DataFrame:
    """Postings of ``vectors(experiment, doc_id, pos, vector)`` by the chunk numbers in ``offsets``.

    A row holds at most ``block`` postings, however frequent its word is. Vectors that carry the
    number of their chunk are not moved to meet it.

    Whole vectors move to the task of their block, words packed as one text (they hold no white space),
    instead of each posting; a file then holds few chunks, and their ids and weights are short there.
    Of ``shares``, only every block of one ``share`` is built, so what is moved at once is bounded by the caller.
    """
    if "number" not in vectors.columns:
        vectors = vectors.join(offsets, ["experiment", "doc_id"]).withColumn("number", F.col("first_index") + F.col("pos"))
    number = F.floor(F.col("number") / block).cast("long")
    if "terms" in vectors.columns:
        held = ["terms", "counts", "length"]
    else:
        held = [F.array_join("vector.term", " ").alias("terms"), F.col("vector.weight").alias("weights")]
    vectors = vectors.filter(F.col("number").isNotNull() & (F.pmod(number, F.lit(shares)) == share))
    by_block = vectors.select("experiment", number.alias("block"), "doc_id", "pos", *held)
    entry = [by_block.schema["doc_id"], by_block.schema["pos"], T.StructField("weight", T.DoubleType())]
    fields = [by_block.schema["experiment"], T.StructField("term", T.StringType()), T.StructField("block", T.LongType())]
    fields += [T.StructField("largest", T.DoubleType()), T.StructField("postings", T.ArrayType(T.StructType(entry)))]
    schema = T.StructType([*fields, T.StructField("first", T.BooleanType()), T.StructField("last", T.BooleanType())])
    arrow = to_arrow_schema(schema)
    return by_block.repartition("experiment", "block").groupBy("experiment", "block").applyInArrow(
        lambda rows: inverted_rows(rows).cast(arrow), schema
    )


def inverted_rows(rows: pa.Table) -> pa.Table:
    """The rows of one block, sorted by term; its vectors, so as bounded as ``block`` of them."""
    n, words = split_words(one(rows["terms"]))
    if "counts" in rows.column_names:
        weight = numbers(one(rows["counts"])) / np.repeat(rows["length"].to_numpy(), n)
    else:
        weight = one(rows["weights"]).flatten().to_numpy()
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    place = place[coded.indices.to_numpy()]
    doc, pos = [np.repeat(rows[c].to_numpy(), n) for c in ("doc_id", "pos")]
    by = np.lexsort((pos, doc, place))
    ends = np.concatenate(([0], np.cumsum(np.bincount(place, minlength=len(order)))))
    entries = pa.StructArray.from_arrays([pa.array(doc[by]), pa.array(pos[by]), pa.array(weight[by])], names=["doc_id", "pos", "weight"])
    at, total = np.arange(len(order)), len(order)
    columns = {
        "experiment": pa.repeat(rows["experiment"][0], total),
        "term": coded.dictionary.take(order),
        "block": pa.repeat(rows["block"][0], total),
        "largest": np.maximum.reduceat(weight[by], ends[:-1]) if total else pa.array([], pa.float64()),
        "postings": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries),
        "first": at == 0,
        "last": at == total - 1,
    }
    return pa.table(columns)


def question_words(asked: DataFrame) -> DataFrame:
    """``experiment, qid, term, share``: the words of each question vector."""
    return asked.select(*ASKED, F.explode("vector").alias("word")).select(
        *ASKED, F.col("word.term").alias("term"), F.col("word.weight").alias("share")
    )


def block_bounds(words: DataFrame, postings: DataFrame) -> DataFrame:
    """``experiment, qid, block, bound``: no chunk of the block scores more."""
    largest = postings.select("experiment", "term", "block", "largest")
    return (
        words.join(largest, ["experiment", "term"])
        .groupBy(*ASKED, "block")
        .agg(F.sum(F.col("share") * F.col("largest")).alias("bound"))
    )


def block_scores(wanted: DataFrame, words: DataFrame, postings: DataFrame) -> DataFrame:
    """``experiment, qid, doc_id, pos, sim`` of all chunks that share a word, in the blocks of
    ``wanted(experiment, qid, block)``. Postings of other blocks drop out before they are opened."""
    read = wanted.join(words, ASKED).join(postings.drop("largest"), ["experiment", "term", "block"])
    return (
        read.select(*ASKED, "share", F.explode("postings").alias("p"))
        .groupBy(*ASKED, F.col("p.doc_id").alias("doc_id"), F.col("p.pos").alias("pos"))
        .agg(F.round(F.sum(F.col("share") * F.col("p.weight")), DIGITS).alias("sim"))
        .filter("sim > 0")
    )


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy(*ASKED).orderBy(F.desc("sim"), "doc_id", "pos")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def blocks_to_read(bounds: DataFrame, first: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The blocks not among ``first`` whose bound reaches the k-th score in ``found``, if there are k."""
    floor = found.filter(F.col("rank") == k).select(*ASKED, F.col("sim").alias("floor"))
    return (
        bounds.join(first.select(*ASKED, "block"), [*ASKED, "block"], "left_anti")
        .join(floor, ASKED, "left")
        .filter(F.col("bound") + SLACK >= F.coalesce("floor", F.lit(0.0)))
        .select(*ASKED, "block")
    )


def topk_postings(asked: DataFrame, postings: DataFrame, k: int, first: int = FIRST) -> DataFrame:
    """Exact top ``k`` chunks by cosine: ``experiment, qid, rank, doc_id, pos, sim``.

    ``asked(experiment, qid, vector)``; chunks that share no word with the question are left
    out, see ``fill_up``. Equal scores go to the first chunk. Postings that meet questions which fit into
    all tasks are not moved.
    """
    spark = asked.sparkSession
    asked = stage(asked.select(*ASKED, "vector"), spark)
    queries = asked.withColumnRenamed("experiment", "cell")
    few = are_few(queries)
    words = stage(question_words(asked), spark)
    words = F.broadcast(words) if few else words
    bounds = block_bounds(words, postings)
    bounds = bounds if few else stage(bounds, spark)
    best = W.partitionBy(*ASKED).orderBy(F.desc("bound"), "block")
    begin = bounds.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= first).select(*ASKED, "block")
    begin = stage(begin, spark)
    if few:
        near = postings.join(F.broadcast(begin.select("experiment", "block").distinct()), ["experiment", "block"], "left_semi")
        found = stage(ranked(scored_in_place(queries, words, None, near, k), k), spark)
        scored = scored_in_place(queries, words, found, postings, k)
    else:
        found = stage(ranked(block_scores(begin, words, postings), k), spark)
        more = block_scores(blocks_to_read(bounds, begin, found, k), words, postings)
        scored = found.drop("rank").unionByName(more)
    return ranked(scored, k).select(*ASKED, "rank", "doc_id", "pos", "sim")


def scored_in_place(queries: DataFrame, words: DataFrame, found: DataFrame | None, postings: DataFrame, k: int) -> DataFrame:
    """``experiment, qid, doc_id, pos, sim``, all of the top ``k`` among them.

    The rows of a block lie one after the other, so the task that reads its first and its last row has it
    whole: it bounds the block, skips it if no question can gain by it, else scores its chunks and keeps ``k`` per question.
    Of a block that two tasks share, both give away what they have summed. Scores in ``found`` are a floor to begin with.
    """
    scorers = by_cell(queries)
    lowest = found.filter(F.col("rank") == k).select(*ASKED, "sim").collect() if found is not None else []
    floors = {(r.experiment, r.qid): r.sim for r in lowest}
    shared = postings.sparkSession.sparkContext.broadcast((scorers, floors))
    vocabulary = words.select("experiment", "term").distinct().withColumn("asked", F.lit(True))
    read = postings.join(F.broadcast(vocabulary), ["experiment", "term"], "left").filter("asked OR first OR last")
    entry = postings.schema["postings"].dataType.elementType
    fields = [queries.schema["cell"], T.StructField("qid", T.LongType()), entry["doc_id"], entry["pos"], T.StructField("sim", T.DoubleType())]
    schema = T.StructType(fields)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers, floors = shared.value
        best = {}
        for name, scorer in scorers.items():
            best[name] = Best(scorer, k, 2, False)
            best[name].floor = np.array([floors.get((name, q), -np.inf) for q in scorer.qids.tolist()])
        types = [to_arrow_type(f.dataType) for f in fields]

        def rows(name, qid, ids, sim):
            columns = [pa.array([name] * len(qid), types[0]), pa.array(qid), *(pa.array(c).cast(t) for c, t in zip(ids, types[2:4])), pa.array(sim)]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for name, part in runs_of_blocks(batches):
            if name not in best:
                continue
            queries, floor = best[name].queries, best[name].floor
            number = part["block"].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
            ends = np.append(starts[1:], len(number))
            whole = part["first"].to_numpy(zero_copy_only=False)[starts] & part["last"].to_numpy(zero_copy_only=False)[ends - 1]
            bound = queries.score(vectors_of(np.append(starts, len(number)), part["term"], part["largest"]))[0]
            wanted = ((bound + SLACK >= floor[:, None]) & (bound > 0)).any(axis=0)
            place = np.repeat(np.arange(len(starts)), ends - starts)
            for chosen, complete in ((wanted & whole, True), (~whole, False)):
                mine = part.filter(pa.array(chosen[place]))
                if not len(mine):
                    continue
                ids, vectors = transposed(mine)
                if complete:
                    best[name].add(vectors, ids)
                    continue
                step = max(1, SCORES_PER_STEP // max(1, len(queries.qids)))
                for at in range(0, len(vectors), step):
                    sims, allowed = queries.score(vectors.slice(at, step))
                    query, row = np.nonzero(allowed)
                    yield rows(name, queries.qids[query], [c[at : at + step][row] for c in ids], sims[query, row])
        for name, kept in best.items():
            qid, *ids, sim = kept.columns()
            yield rows(name, qid, ids, sim)

    sums = read.select("experiment", "block", "term", "largest", "postings", "first", "last").mapInArrow(score, schema)
    return (
        sums.withColumnRenamed("cell", "experiment")
        .groupBy(*ASKED, "doc_id", "pos")
        .agg(F.round(F.sum("sim"), DIGITS).alias("sim"))
        .filter("sim > 0")
    )


def runs_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Rows of neighbouring blocks of one experiment. A block is kept back until its last row or another block
    comes, so none is cut that a task reads whole."""
    held: pa.Table | None = None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, table]) if held is not None else table
        name, block = held["experiment"], held["block"]
        open_ = pc.and_(pc.equal(name, name[-1]), pc.equal(block, block[-1])).to_numpy()
        start = int(np.flatnonzero(~open_)[-1]) + 1 if not open_.all() else 0
        yield from of_one_name(held.slice(0, start))
        held = held.slice(start)
    if held is not None:
        yield from of_one_name(held)


def of_one_name(table: pa.Table) -> Iterator[tuple[str, pa.RecordBatch]]:
    if not len(table):
        return
    batch = table.combine_chunks().to_batches()[0]
    for name in pc.unique(batch["experiment"]).to_pylist():
        yield name, batch.filter(pc.equal(batch["experiment"], name))


def vectors_of(ends: np.ndarray, terms: pa.Array, weights: pa.Array) -> pa.ListArray:
    pairs = pa.StructArray.from_arrays([terms, weights], names=["term", "weight"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)


def transposed(rows: pa.RecordBatch) -> tuple[list[np.ndarray], pa.ListArray]:
    """``doc_id`` and ``pos`` of the chunks in rows of postings, and their vectors."""
    lists = rows["postings"]
    term = np.repeat(np.arange(len(rows)), pc.list_value_length(lists).to_numpy())
    entries = lists.flatten()
    doc, pos = [entries.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "pos")]
    order = np.lexsort((term, pos, doc))
    doc, pos = doc[order], pos[order]
    starts = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1]))))
    vectors = vectors_of(np.append(starts, len(doc)), rows["term"].take(pa.array(term[order])), entries.field("weight").take(pa.array(order)))
    return [doc[starts], pos[starts]], vectors


def fill_up(hits: DataFrame, questions: DataFrame, chunks: DataFrame, offsets: DataFrame, k: int) -> DataFrame:
    """``hits`` with ``k`` rows for each of ``questions(experiment, qid)``, or all chunks if there are fewer.

    What a question lacks are chunks of score 0, the first ones that it did not hit. It hit
    fewer than k, so these are among the first 2k chunks of its experiment.
    """
    hits = stage(hits, hits.sparkSession)
    # A question's hits are at most k rows.
    short = questions.join(hits.groupBy(*ASKED).agg(F.count("*").alias("n")), ASKED, "left").select(
        *ASKED, F.coalesce("n", F.lit(0)).alias("n")
    ).filter(F.col("n") < k)
    begin = offsets.filter(F.col("first_index") < 2 * k)
    first = chunks.select("experiment", "doc_id", "pos").join(F.broadcast(begin), ["experiment", "doc_id"]).filter(
        F.col("first_index") + F.col("pos") < 2 * k
    ).drop("first_index")
    order = W.partitionBy(*ASKED).orderBy("doc_id", "pos")
    rest = (
        short.join(first, "experiment")
        .join(hits.select(*ASKED, "doc_id", "pos"), [*ASKED, "doc_id", "pos"], "left_anti")
        .withColumn("rank", F.col("n").cast("int") + F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(*ASKED, "rank", "doc_id", "pos", F.lit(0.0).alias("sim"))
    )
    return hits.select(*ASKED, "rank", "doc_id", "pos", "sim").unionByName(rest)
