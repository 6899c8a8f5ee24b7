"""Approximate nearest neighbours: a two-level inverted file of compressed vectors.

Vectors are of length 1. The number of lists grows with the root of the number of vectors, and a
search looks into some of them. Centers are in two levels: a vector is
compared with the upper ones, then with the lists below the nearest. What a list keeps of a vector
is its rest behind the center, in units of the list's usual rest (so that a narrow list, as of many
near copies, is told apart as well as a wide one), ``PER_CODE`` numbers to a byte by one codebook per
place. A search scores these, and only the best ``depth`` for each row asked for are compared exactly.

    index = build(corpus, "vec_id")          # corpus(vec_id, vector)
    found = search(index, queries, 10)       # queries(qid, vector)

Centers and codebooks are fitted on a sample of the vectors, chosen by hash of the key: some
``SAMPLE_PER_LIST`` of them for each list, in all no more than some ``SAMPLE_NUMBERS`` numbers. Every vector
is indexed. How many lists a search visits is measured: some ``TRIALS`` vectors of the corpus are
compared with all others, and the lists in which their true neighbours lie, and their ranks by code
there, tell ``visits`` and ``depth`` for ``TARGET`` of them (``depth`` up to ``DEEPEST``). What the driver holds and sends out are centers and codebooks, at most ``CENTER_NUMBERS``
numbers and one codebook each; there are no more than ``LISTS`` lists, and beyond
their square the lists grow.

Keys are unique. Null vectors are not in ``densesearch.prepare``'s output and not allowed here.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.operators import blocks
from evalspark.operators.blocks import DIGITS, DenseQueries, matrix, one
from evalspark.session import stage

LISTS = 16_384
CENTER_NUMBERS = 16_000_000
SAMPLE_PER_LIST = 64
SAMPLE_NUMBERS = 16_000_000
PER_CODE = 4
CODES = 256
ROUNDS = 12
# The search is tuned to this share of the true neighbours of about so many vectors.
TARGET = 0.95
TRIALS = 256
TRIAL_K = 10
DEEPEST = 64


@dataclasses.dataclass(frozen=True)
class Centers:
    """``lists[first[t]:first[t + 1]]`` lie below ``upper[t]``; ``books`` are place x code x numbers,
    in units of ``scale`` of the list."""

    upper: np.ndarray
    lists: np.ndarray
    first: np.ndarray
    books: np.ndarray
    scale: np.ndarray

    def place(self, vectors: np.ndarray) -> np.ndarray:
        above, below = nearest(vectors, self.upper), np.zeros(len(vectors), np.int64)
        for t in np.unique(above):
            mine = above == t
            below[mine] = self.first[t] + nearest(vectors[mine], self.lists[self.first[t] : self.first[t + 1]])
        return below

    def rest(self, vectors: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """What lies behind the center, filled up with zeros to whole codes."""
        rest = (vectors - self.lists[lists]) / self.scale[lists][:, None]
        return np.pad(rest, ((0, 0), (0, -rest.shape[1] % PER_CODE)))

    def encode(self, vectors: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = self.rest(vectors, lists)
        codes = [nearest(rest[:, m * PER_CODE : (m + 1) * PER_CODE], book) for m, book in enumerate(self.books)]
        return np.stack(codes, axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray, number: int) -> np.ndarray:
        center = self.lists[number]
        rest = self.books[np.arange(len(self.books)), codes].reshape(len(codes), -1)
        found = rest[:, : len(center)] * self.scale[number] + center
        # Of length 1 as the vectors are: in a narrow list an error of the length outweighs the angles.
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)


@dataclasses.dataclass(frozen=True)
class InvertedIndex:
    """``codes(cell, <key>, vector)`` with the codes as bytes, and the ``corpus`` they are of."""

    key: str
    corpus: DataFrame
    codes: DataFrame
    centers: Centers | None
    sizes: np.ndarray
    visits: int = 1
    depth: int = 4


def nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Place of the nearest center; of equal ones the first."""
    length = (centers**2).sum(axis=1)
    step = max(1, blocks.SCORES_PER_STEP // max(1, len(centers)))
    found = [
        (length - 2.0 * points[at : at + step] @ centers.T).argmin(axis=1) for at in range(0, len(points), step)
    ]
    return np.concatenate(found) if found else np.empty(0, np.int64)


def means(points: np.ndarray, count: int) -> np.ndarray:
    """At most ``count`` centers by Lloyd's rule, started from points at equal steps."""
    points = points[np.lexsort(points.T)]
    distinct = np.unique(points, axis=0)
    centers = distinct[np.linspace(0, len(distinct) - 1, min(count, len(distinct))).astype(int)]
    if len(centers) == len(distinct):
        return centers
    for _ in range(ROUNDS):
        mine = nearest(points, centers)
        order = np.argsort(mine, kind="stable")
        used, start = np.unique(mine[order], return_index=True)
        sums = np.add.reduceat(points[order], start, axis=0)
        moved = centers.copy()
        moved[used] = sums / np.diff(np.append(start, len(order)))[:, None]
        if np.array_equal(moved, centers):
            break
        centers = moved
    return centers


def fitted(points: DataFrame, by: str, count: int) -> dict[int, np.ndarray]:
    """Centers of ``points(<by>, vector)`` of the sample, one task per group."""

    def fit(rows: pa.Table) -> pa.Table:
        centers = means(matrix(one(rows["vector"])), count)
        return pa.table(
            {
                by: pa.array([rows[by][0].as_py()] * len(centers), pa.int32()),
                "vector": pa.array(list(centers), pa.list_(pa.float64())),
            }
        )

    rows = points.groupBy(by).applyInArrow(fit, f"{by} int, vector array<double>").toArrow()
    owner, centers = rows[by].to_numpy(), matrix(one(rows["vector"])) if len(rows) else np.empty((0, 0))
    return {int(t): centers[owner == t] for t in np.unique(owner)}


def fit_centers(corpus: DataFrame, key: str, total: int, dims: int) -> Centers:
    spark = corpus.sparkSession
    count = max(1, min(LISTS, CENTER_NUMBERS // dims, math.ceil(math.sqrt(total))))
    n_upper = math.ceil(math.sqrt(count))
    rows = min(max(SAMPLE_PER_LIST * count, 4 * CODES), SAMPLE_NUMBERS // dims)
    # A share of all hashes, so the sample is the same in each run and of the whole table.
    share = min(1.0, rows / total)
    chosen = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    sample = stage(corpus.filter(chosen).select(F.lit(0).alias("above"), "vector"), spark)
    upper = fitted(sample, "above", n_upper).get(0)
    if upper is None:
        # A tiny table of which the hash took no row.
        sample = stage(corpus.select(F.lit(0).alias("above"), "vector").limit(1), spark)
        upper = fitted(sample, "above", n_upper)[0]

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner = pa.array(nearest(matrix(batch["vector"]), upper), pa.int32())
            yield pa.RecordBatch.from_arrays([owner, batch["vector"]], names=["above", "vector"])

    placed = sample.mapInArrow(above, "above int, vector array<double>")
    below = fitted(placed, "above", math.ceil(count / n_upper))
    groups = [below.get(t, upper[t : t + 1]) for t in range(len(upper))]
    first = np.cumsum([0, *map(len, groups)])
    lists = np.concatenate(groups)
    centers = Centers(upper, lists, first, np.empty((0, CODES, PER_CODE)), np.ones(len(lists)))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch["vector"])
            cell = centers.place(vectors)
            square = (centers.rest(vectors, cell) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(square)], names=["cell", "square"])

    squares = sample.select("vector").mapInArrow(lengths, "cell int, square double").groupBy("cell").agg(F.avg("square").alias("square"))
    for row in squares.collect():  # at most LISTS rows
        centers.scale[row.cell] = max(math.sqrt(row.square), 1e-6)

    def rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch["vector"])
            rest = centers.rest(vectors, centers.place(vectors)).reshape(len(vectors), -1, PER_CODE)
            for m in range(rest.shape[1]):
                part = pa.array(list(rest[:, m]), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([m] * len(rest), pa.int32()), part], names=["place", "vector"])

    books = fitted(sample.select("vector").mapInArrow(rests, "place int, vector array<double>"), "place", CODES)
    # Few distinct rests make a short book; it is filled up with its last row.
    full = [np.pad(books[m], ((0, CODES - len(books[m])), (0, 0)), mode="edge") for m in sorted(books)]
    return dataclasses.replace(centers, books=np.stack(full))


def build(corpus: DataFrame, key: str) -> InvertedIndex:
    """Index ``corpus(<key>, vector)``, vectors of length 1 and one dimension."""
    spark = corpus.sparkSession
    corpus = stage(corpus.select(key, "vector"), spark)
    total, dims = corpus.agg(F.count("*"), F.max(F.size("vector"))).head()
    if not total:
        empty = corpus.select(F.lit(0).alias("cell"), key, F.lit(b"").alias("vector"))
        return InvertedIndex(key, corpus, empty, None, np.zeros(0))
    centers = fit_centers(corpus, key, total, dims)
    shared = spark.sparkContext.broadcast(centers)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch["vector"])
            cell = shared.value.place(vectors)
            codes = [row.tobytes() for row in shared.value.encode(vectors, cell)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), batch[key], pa.array(codes, pa.binary())], names=["cell", key, "vector"]
            )

    kind = corpus.schema[key].dataType.simpleString()
    codes = stage(corpus.mapInArrow(encode, f"cell int, {key} {kind}, vector binary"), spark)
    sizes = np.zeros(len(centers.lists))
    for row in codes.groupBy("cell").count().collect():  # at most LISTS rows
        sizes[row.cell] = row["count"]
    index = InvertedIndex(key, corpus, codes, centers, sizes)
    return tuned(index, total)


def tuned(index: InvertedIndex, total: int) -> InvertedIndex:
    """Set ``visits`` and ``depth`` by the true neighbours of vectors chosen by hash."""
    share = min(1.0, TRIALS / total)
    chosen = F.pmod(F.xxhash64(index.key, F.lit("trial")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    trials = index.corpus.filter(chosen).limit(2 * TRIALS).select(F.col(index.key).cast("bigint").alias("qid"), "vector")
    trials = stage(trials.withColumn("cell", F.lit("")), index.corpus.sparkSession)
    true = blocks.topk(index.corpus.withColumn("cell", F.lit("")), trials, [index.key], TRIAL_K, True)
    held = true.select("qid", index.key, "rank").join(index.codes.select("cell", index.key), index.key)
    held = held.select("qid", "cell").collect()  # at most TRIAL_K rows a trial
    if not held:
        return index
    asked = {row.qid: np.array(row.vector) for row in trials.collect()}
    places = {qid: np.argsort(np.argsort(-(index.centers.lists @ v), kind="stable")) for qid, v in asked.items()}
    needed = [places[row.qid][row.cell] + 1 for row in held]
    index = dataclasses.replace(index, visits=int(np.quantile(needed, TARGET, method="higher")))
    by_code = candidates(index, trials, TRIAL_K * DEEPEST, True, index.visits).select("qid", index.key, F.col("rank").alias("code_rank"))
    ranks = [row.code_rank for row in true.join(by_code, ["qid", index.key]).select("code_rank").collect()]
    deep = math.ceil(np.quantile(ranks, TARGET, method="higher") / TRIAL_K) if ranks else DEEPEST
    # Twice of that: the margin for queries that were not among the trials.
    return dataclasses.replace(index, depth=min(DEEPEST, 2 * deep))


class CodedQueries(DenseQueries):
    """Queries that meet the codes of one list."""

    def __init__(self, qids, vectors: pa.ListArray, centers: Centers, number: int):
        super().__init__(qids, vectors)
        self.centers, self.number = centers, number

    def score(self, vectors: pa.Array) -> tuple[np.ndarray, None]:
        width = len(self.centers.books)
        fixed = vectors.cast(pa.binary(width))
        codes = np.frombuffer(fixed.buffers()[1], np.uint8)[fixed.offset * width : (fixed.offset + len(fixed)) * width]
        return self.matrix @ self.centers.decode(codes.reshape(-1, width), self.number).T, None


def visited(index: InvertedIndex, queries: DataFrame, least: int, number: int) -> DataFrame:
    """``cell, qid, vector``: the nearest lists of each query, and so many that they hold ``least`` vectors."""
    shared = index.corpus.sparkSession.sparkContext.broadcast((index.centers.lists, index.sizes))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, sizes = shared.value
        step = max(1, blocks.SCORES_PER_STEP // len(lists))
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                order = np.argsort(-(matrix(part["vector"]) @ lists.T), axis=1, kind="stable")
                held = np.cumsum(sizes[order], axis=1) - sizes[order]
                query, place = np.nonzero((np.arange(len(lists)) < number) | (held < least))
                cell = order[query, place]
                query, cell = query[sizes[cell] > 0], cell[sizes[cell] > 0]
                rows = part.select(["qid", "vector"]).take(pa.array(query))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *rows.columns], names=["cell", "qid", "vector"])

    return queries.select("qid", "vector").mapInArrow(visit, "cell int, qid bigint, vector array<double>")


def candidates(index: InvertedIndex, queries: DataFrame, keep: int, exclude_self: bool, visits: int) -> DataFrame:
    """``cell, qid, rank, <key>, sim``: the best ``keep`` by code in the visited lists."""
    shared = index.corpus.sparkSession.sparkContext.broadcast(index.centers)
    asked = stage(visited(index, queries, keep + 1, visits), index.corpus.sparkSession)
    rough = blocks.grid(
        index.codes, asked, [index.key], keep, exclude_self,
        block=lambda qids, vectors, cell: CodedQueries(qids, vectors, shared.value, cell),
    )
    return blocks.rank(rough.withColumn("cell", F.lit("")), [index.key], keep)


def search(
    index: InvertedIndex,
    queries: DataFrame,
    k: int,
    exclude_self: bool = False,
    visits: int | None = None,
    depth: int | None = None,
) -> DataFrame:
    """``cell, qid, rank, <key>, sim``: up to ``k`` rows a query, of the best by codes the best by
    their exact cosine. More ``visits`` (lists) and ``depth`` than measured find more of the true
    neighbours.

    A list with many rows or many queries is met in bounded blocks (``blocks.grid``), each of
    which gives back its best rows only.
    """
    spark = index.corpus.sparkSession
    queries = stage(queries.select(F.col("qid").cast("bigint").alias("qid"), "vector"), spark)
    if index.centers is None:
        return blocks.topk(
            index.corpus.withColumn("cell", F.lit("")), queries.withColumn("cell", F.lit("")), [index.key], k, exclude_self
        )
    keep = k * (depth or index.depth)
    near = candidates(index, queries, keep, exclude_self, visits or index.visits)
    near = stage(near.select("cell", "qid", index.key), spark)
    product = F.aggregate(F.zip_with("vector", "asked", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    exact = (
        near.join(index.corpus, index.key)
        .join(queries.withColumnRenamed("vector", "asked"), "qid")
        .select("cell", "qid", index.key, F.round(product, DIGITS).alias("sim"))
    )
    return blocks.rank(exact, [index.key], k)
