"""Nearest neighbours on dense vectors; cosine, so vectors are scaled to length 1."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.vectors import as_double, normalize
from evalspark.operators import blocks, inverted
from evalspark.operators.blocks import matrix
from evalspark.session import stage

BACKENDS = ("scan", "cells", "inverted")
# Cells of the pivot index; pivots and their statistics are the only broadcast.
PIVOTS = 64
# Queries times cells that a task holds at once.
VISITS_PER_STEP = 16_384
# Distances are compared with this room for rounding.
SLACK = 1e-5


def prepare(table: DataFrame, key: str, vector: str = "embedding", cell: str = "") -> DataFrame:
    """``cell, <key>, vector`` with unit vectors."""
    return table.filter(F.col(vector).isNotNull()).select(
        F.lit(cell).alias("cell"), key, normalize(as_double(F.col(vector))).alias("vector")
    )


def topk_dense(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    key: str = "vec_id",
    backend: str = "scan",
    exclude_self: bool = False,
) -> DataFrame:
    """``cell, qid, rank, <key>, sim``; ``scan`` and ``cells`` give the exact result.

    ``scan`` scores every vector for every query. ``cells`` skips vectors that
    cannot be near, which pays with many queries on clustered vectors. ``inverted`` is
    approximate (see ``inverted``); its scores are exact.
    """
    if backend not in BACKENDS:
        raise ValueError(f"Unknown vector store backend: '{backend}'. Expected one of {BACKENDS}.")
    if backend == "scan":
        return blocks.topk(corpus, queries, [key], k, exclude_self)
    if backend == "inverted":
        return inverted.search(inverted.build(corpus, key), queries, k, exclude_self)
    return _topk_cells(corpus, queries, k, key, exclude_self)


def _topk_cells(corpus, queries, k, key, exclude_self) -> DataFrame:
    """Exact search over cells around pivots.

    Every vector belongs to its nearest pivot, and a cell has the radius of its
    farthest vector. A query first searches its nearest cells that together hold
    k vectors: the k-th distance found is a limit. By the triangle inequality a
    cell farther than limit + radius holds nothing nearer, and is left out.
    """
    spark = corpus.sparkSession
    corpus = corpus.drop("cell")
    picks = (
        corpus.groupBy(F.pmod(F.xxhash64(key), F.lit(PIVOTS)).alias("h"))
        .agg(F.min_by("vector", key).alias("vector"))
        .orderBy("h")
    )
    # At most PIVOTS rows here and in the statistics below.
    pivots = np.array([row.vector for row in picks.collect()])
    if not len(pivots):
        return blocks.topk(corpus.withColumn("cell", F.lit("")), queries, [key], k, exclude_self)
    shared = spark.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(matrix(batch["vector"]), shared.value)
            yield batch.append_column("cell", pa.array(far.argmin(axis=1))).append_column(
                "far", pa.array(far.min(axis=1))
            )

    id_type = corpus.schema[key].dataType.simpleString()
    placed = stage(
        corpus.select(key, "vector").mapInArrow(
            nearest, f"{key} {id_type}, vector array<double>, cell long, far double"
        ),
        spark,
    )
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    size, radius = np.zeros(len(pivots)), np.zeros(len(pivots))
    for row in stats.collect():
        size[row.cell], radius[row.cell] = row.n, row.radius
    placed = placed.drop("far")
    wanted = k + 1 if exclude_self else k

    def first_cells(far: np.ndarray) -> np.ndarray:
        order = far.argsort(axis=1)
        before = np.cumsum(size[order], axis=1) - size[order]
        visit = np.zeros(far.shape, bool)
        np.put_along_axis(visit, order, before < wanted, axis=1)
        return visit & (size > 0)

    def visits(select):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from visited(batch, select, shared.value)

        return run

    def near_cells(far: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        floor = batch["floor"].to_numpy(zero_copy_only=False)
        limit = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (floor - 1e-6)))
        return (far - radius <= limit[:, None] + SLACK) & (size > 0)

    shape = "qid long, vector array<double>, cell long"
    queries = queries.select("qid", "vector")
    first = stage(queries.mapInArrow(visits(lambda far, _: first_cells(far)), shape), spark)
    floors = (
        _best(blocks.grid(placed, first, [key], k, exclude_self), key, k)
        .groupBy("qid")
        .agg(F.min("sim").alias("floor"), F.count("*").alias("n"))
        # Fewer than k found: only a limit that leaves out nothing is safe.
        .select("qid", F.when(F.col("n") >= k, F.col("floor")).otherwise(-2.0).alias("floor"))
    )
    second = stage(
        queries.join(floors, "qid", "left")
        .fillna(-2.0, ["floor"])
        .mapInArrow(visits(near_cells), shape),
        spark,
    )
    found = blocks.grid(placed, second, [key], k, exclude_self)
    return _best(found, key, k)


def visited(batch: pa.RecordBatch, select, pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row per query and cell that it visits, each with a copy of the vector, so a few at a time."""
    rows = max(1, VISITS_PER_STEP // len(pivots))
    for at in range(0, len(batch), rows):
        part = batch.slice(at, rows)
        query, cell = select(distances(matrix(part["vector"]), pivots), part).nonzero()
        yield part.select(["qid", "vector"]).take(pa.array(query)).append_column("cell", pa.array(cell))


def _best(found: DataFrame, key: str, k: int) -> DataFrame:
    return blocks.rank(found.withColumn("cell", F.lit("")), [key], k)


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Between unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (vectors @ pivots.T)))
