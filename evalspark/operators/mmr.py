"""Maximal marginal relevance: pick results that are near the query and unlike each other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.operators.blocks import DIGITS, one, query_block


def pick(sims: np.ndarray, between: np.ndarray, k: int, weight: float) -> list[int]:
    """Greedy choice by ``weight * sim - (1 - weight) * nearest chosen``; ties to the first."""
    chosen: list[int] = []
    nearest = np.full(len(sims), -np.inf)
    open_ = np.ones(len(sims), bool)
    for _ in range(min(k, len(sims))):
        value = sims if not chosen else weight * sims - (1 - weight) * nearest
        best = int(np.argmax(np.where(open_, value, -np.inf)))
        chosen.append(best)
        open_[best] = False
        nearest = np.maximum(nearest, between[best])
    return chosen


def mmr(hits: DataFrame, vectors: DataFrame, ids: list[str], k: int, weight: float) -> DataFrame:
    """Rerank ``hits(cell, qid, rank, *ids, sim)`` to ``k`` per query.

    ``vectors(cell, *ids, vector)`` is read for the hits only. A group is one
    query's pool of ``fetch_k`` hits, the bound set when they were fetched.
    """
    pool = hits.join(vectors, ["cell", *ids]).select("cell", "qid", "rank", *ids, "sim", "vector")

    def choose(group: pa.Table) -> pa.Table:
        group = group.sort_by("rank")
        block = query_block(np.arange(len(group)), one(group["vector"]))
        between = np.round(block.score(one(group["vector"]))[0], DIGITS)
        chosen = pick(group["sim"].to_numpy(), between, k, weight)
        out = group.drop_columns(["vector", "rank"]).take(chosen)
        ranks = pa.array(np.arange(1, len(chosen) + 1), pa.int32())
        return out.append_column("rank", ranks).select(names)

    names = ["cell", "qid", "rank", *ids, "sim"]
    schema = pool.select("cell", "qid", F.col("rank").cast("int"), *ids, "sim").schema
    return pool.groupBy("cell", "qid").applyInArrow(choose, schema)
