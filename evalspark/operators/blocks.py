"""Exact top-k of queries against corpus blocks, without a row per pair.

A corpus row has a ``cell``, integer id columns and a ``vector``; a query has a
``cell``, a ``qid`` and a ``vector``, and is scored against the rows of its cell.
Each task scores a block of rows with numpy and gives back at most k rows per
query, so what is shuffled grows with queries and tasks and not with pairs.

A vector is array<double> (dense) or array<struct<term,weight>> (sparse). Those of rows may be packed too:
struct<terms,counts,length>, for words with weight count / length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from evalspark.functions.packed import numbers, split_words
from evalspark.session import stage

DIGITS = 6
# Queries that are sent to all tasks: at most this many, and this many numbers.
BROADCAST_QUERIES = 4096
BROADCAST_NUMBERS = 4_000_000
# Average size of the blocks that meet when there are more queries.
ROWS_PER_BLOCK = 32_768
QUERIES_PER_BLOCK = 4096
# Scores that one numpy step holds.
SCORES_PER_STEP = 2_000_000
# Products of a word's weights in a query and in a row that one numpy step holds, or those of one row.
PRODUCTS_PER_STEP = 1_000_000


class DenseQueries:
    """Queries as the rows of a matrix."""

    def __init__(self, qids, vectors: pa.ListArray):
        self.qids = np.asarray(qids, dtype=np.int64)
        self.matrix = matrix(vectors)

    def score(self, vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray | None]:
        return self.matrix @ matrix(vectors).T, None


class SparseQueries:
    """Queries as an inverted list: for each word, who has it and with what weight."""

    def __init__(self, qids, vectors: pa.ListArray):
        self.qids = np.asarray(qids, dtype=np.int64)
        owner, terms, weights = _flat(vectors)
        encoded = terms.dictionary_encode()
        self.words = encoded.dictionary
        codes = encoded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        self.owner, self.weights = owner[order], weights[order]
        self.count = np.bincount(codes, minlength=len(self.words))
        self.start = np.cumsum(self.count) - self.count

    def score(self, vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray | None]:
        row, terms, weights = _flat(vectors)
        code = pc.fill_null(pc.index_in(terms, value_set=self.words), -1).to_numpy()
        hit = code >= 0
        row, weights, code = row[hit], weights[hit], code[hit]
        times = self.count[code]
        scores = np.zeros((len(self.qids), len(vectors)))
        # Whole rows at a time, so that a frequent word in many queries stays bounded.
        part = np.cumsum(np.bincount(row, weights=times, minlength=len(vectors))) // PRODUCTS_PER_STEP
        cuts = np.searchsorted(row, np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(vectors)])))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a < b:
                self._meet(row[a:b], weights[a:b], code[a:b], times[a:b], scores)
        return scores, scores > 0

    def _meet(self, row, weights, code, times, scores) -> None:
        """Each posting meets every query that has its word."""
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        at = np.repeat(self.start[code], times) + step
        first, width = row[0], row[-1] - row[0] + 1
        place = self.owner[at] * width + np.repeat(row - first, times)
        found = np.bincount(place, weights=self.weights[at] * np.repeat(weights, times), minlength=len(self.qids) * width)
        scores[:, first : first + width] = found.reshape(-1, width)


def matrix(vectors: pa.ListArray) -> np.ndarray:
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(vectors), -1)


def _flat(vectors: pa.ListArray | pa.StructArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    if pa.types.is_struct(vectors.type):
        terms, counts, length = vectors.flatten()
        n, words = split_words(terms)
        return np.repeat(np.arange(len(vectors)), n), words, numbers(counts) / np.repeat(length.to_numpy(zero_copy_only=False), n)
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    pairs = vectors.flatten()
    return (
        np.repeat(np.arange(len(vectors)), lengths),
        pairs.field("term"),
        pairs.field("weight").to_numpy(zero_copy_only=False),
    )


def query_block(qids, vectors: pa.ListArray) -> DenseQueries | SparseQueries:
    sparse = pa.types.is_struct(vectors.type) or pa.types.is_struct(vectors.type.value_type)
    return (SparseQueries if sparse else DenseQueries)(qids, vectors)


class Best:
    """The k best rows of each query seen so far; ties go to the smaller ids."""

    def __init__(self, queries, k: int, n_ids: int, exclude_self: bool):
        self.queries, self.k, self.exclude_self = queries, k, exclude_self
        self.floor = np.full(len(queries.qids), -np.inf)
        self.query = np.empty(0, np.int64)
        self.score = np.empty(0)
        self.ids = [np.empty(0, np.int64) for _ in range(n_ids)]

    def add(self, vectors: pa.ListArray, ids: list[np.ndarray]) -> None:
        step = max(1, SCORES_PER_STEP // max(1, len(self.queries.qids)))
        for at in range(0, len(vectors), step):
            self._add(vectors.slice(at, step), [column[at : at + step] for column in ids])

    def _add(self, vectors: pa.ListArray, ids: list[np.ndarray]) -> None:
        scores, allowed = self.queries.score(vectors)
        if len(self.floor) and self.floor.min() > -np.inf:
            # Each query has k rows by now, so few of the others are looked at.
            query, row = np.nonzero(scores >= self.floor[:, None] - 10.0**-DIGITS)
            score = np.round(scores[query, row], DIGITS)
            kept = score >= self.floor[query]
            if allowed is not None:
                kept &= allowed[query, row]
            if self.exclude_self:
                kept &= self.queries.qids[query] != ids[0][row]
            query, row, score = query[kept], row[kept], score[kept]
        else:
            scores = np.round(scores, DIGITS)
            if allowed is not None:
                scores = np.where(allowed, scores, -np.inf)
            if self.exclude_self:
                scores = np.where(self.queries.qids[:, None] == ids[0][None, :], -np.inf, scores)
            if scores.shape[1] >= self.k:
                kth = np.partition(scores, -self.k, axis=1)[:, -self.k]
                self.floor = np.maximum(self.floor, kth)
            query, row = np.nonzero((scores >= self.floor[:, None]) & (scores > -np.inf))
            score = scores[query, row]
        if not len(query):
            return
        self.query = np.concatenate([self.query, query])
        self.score = np.concatenate([self.score, score])
        self.ids = [np.concatenate([old, new[row]]) for old, new in zip(self.ids, ids)]
        self._cut()

    def _cut(self) -> None:
        order = np.lexsort((*reversed(self.ids), -self.score, self.query))
        query = self.query[order]
        first = np.searchsorted(query, query, side="left")
        order = order[np.arange(len(query)) - first < self.k]
        self.query, self.score = self.query[order], self.score[order]
        self.ids = [column[order] for column in self.ids]
        full = np.bincount(self.query, minlength=len(self.floor)) >= self.k
        lowest = np.full(len(self.floor), np.inf)
        np.minimum.at(lowest, self.query, self.score)
        self.floor = np.where(full, np.maximum(self.floor, lowest), self.floor)

    def columns(self) -> list[np.ndarray]:
        return [self.queries.qids[self.query], *self.ids, self.score]


def topk(
    corpus: DataFrame,
    queries: DataFrame,
    ids: list[str],
    k: int,
    exclude_self: bool = False,
) -> DataFrame:
    """``cell, qid, rank, *ids, sim`` for ``corpus(cell, *ids, vector)``.

    Queries within the bounds go to all tasks and the corpus is not shuffled.
    With more of them, blocks of queries meet blocks of the corpus.
    """
    queries = stage(queries.select("cell", "qid", "vector"), queries.sparkSession)
    if are_few(queries):
        found = _scan(corpus, queries, ids, k, exclude_self)
    else:
        found = grid(corpus, queries, ids, k, exclude_self)
    return rank(found, ids, k)


def are_few(queries: DataFrame) -> bool:
    """Whether queries fit into all tasks."""
    sizes = queries.select(F.size("vector").alias("n")).limit(BROADCAST_QUERIES + 1)
    found, total = sizes.agg(F.count("n"), F.sum("n")).head()
    return found <= BROADCAST_QUERIES and (total or 0) <= BROADCAST_NUMBERS


def by_cell(queries: DataFrame) -> dict:
    """What scores the rows of each cell, made from queries that are few."""
    table = queries.toArrow().combine_chunks()
    found = {}
    for cell in pc.unique(table["cell"]).to_pylist():
        part = table.filter(pc.equal(table["cell"], cell)).sort_by("qid")
        found[cell] = query_block(part["qid"].to_numpy(), one(part["vector"]))
    return found


def rank(found: DataFrame, ids: list[str], k: int) -> DataFrame:
    order = W.partitionBy("cell", "qid").orderBy(F.desc("sim"), *ids)
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("cell", "qid", "rank", *ids, "sim")
    )


def _schema(corpus: DataFrame, ids: list[str]) -> T.StructType:
    fields = [corpus.schema["cell"], T.StructField("qid", T.LongType())]
    fields += [corpus.schema[name] for name in ids]
    return T.StructType([*fields, T.StructField("sim", T.DoubleType())])


def _scan(corpus, queries, ids, k, exclude_self) -> DataFrame:
    shared = corpus.sparkSession.sparkContext.broadcast(by_cell(queries))
    schema = _schema(corpus, ids)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        arrow = None
        for batch in batches:
            for cell in pc.unique(batch["cell"]).to_pylist():
                if cell not in shared.value:
                    continue
                part = batch.filter(pc.equal(batch["cell"], cell))
                if cell not in best:
                    best[cell] = Best(shared.value[cell], k, len(ids), exclude_self)
                best[cell].add(
                    part["vector"], [part[name].to_numpy().astype(np.int64) for name in ids]
                )
                arrow = [batch.schema.field(name).type for name in ["cell", *ids]]
        for cell, kept in best.items():
            qid, *keys, sim = kept.columns()
            columns = [pa.array([cell] * len(qid), arrow[0]), pa.array(qid)]
            columns += [pa.array(c).cast(t) for c, t in zip(keys, arrow[1:])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sim)], names=schema.names)

    return corpus.select("cell", *ids, "vector").mapInArrow(scan, schema)


def one(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def grid(corpus, queries, ids, k, exclude_self, block=None) -> DataFrame:
    """Blocks of a cell's rows meet blocks of its queries, each pair in one group.

    A hot cell is cut into as many blocks as its size asks for, so every group is
    of bounded size. ``block(qids, vectors, cell)`` makes what scores the rows of a cell;
    rows may then hold something else than a vector.
    """
    block = block or (lambda qids, vectors, cell: query_block(qids, vectors))
    sizes = (
        corpus.groupBy("cell")
        .agg(F.ceil(F.count("*") / ROWS_PER_BLOCK).cast("int").alias("row_blocks"))
        .join(
            queries.groupBy("cell").agg(
                F.ceil(F.count("*") / QUERIES_PER_BLOCK).cast("int").alias("query_blocks")
            ),
            "cell",
        )
    )
    # One row per cell: cells are experiments or pivots, both of bounded number.
    sizes = F.broadcast(sizes)

    def blocks(table: DataFrame, key: list[str], own: str, other: str) -> DataFrame:
        return (
            table.join(sizes, "cell")
            .withColumn(own, F.pmod(F.xxhash64(*key), F.col(f"{own}s")).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
            .select("cell", "row_block", "query_block", *key, "vector")
            .groupBy("cell", "row_block", "query_block")
        )

    schema = _schema(corpus, ids)

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        types = {f.name: f.type for f in rows.schema}
        if len(rows) and len(asked):
            asking = block(asked["qid"].to_numpy(), one(asked["vector"]), rows["cell"][0].as_py())
            best = Best(asking, k, len(ids), exclude_self)
            best.add(one(rows["vector"]), [rows[name].to_numpy().astype(np.int64) for name in ids])
            qid, *keys, sim = best.columns()
            cells = pa.array([rows["cell"][0].as_py()] * len(qid), types["cell"])
            keys = [pa.array(c).cast(types[name]) for c, name in zip(keys, ids)]
            return pa.table([cells, pa.array(qid), *keys, pa.array(sim)], names=schema.names)
        return pa.table(
            [pa.array([], types["cell"]), pa.array([], pa.int64())]
            + [pa.array([], types[name]) for name in ids]
            + [pa.array([], pa.float64())],
            names=schema.names,
        )

    return (
        blocks(corpus, ids, "row_block", "query_block")
        .cogroup(blocks(queries, ["qid"], "query_block", "row_block"))
        .applyInArrow(meet, schema)
    )
