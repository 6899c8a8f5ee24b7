"""Few rows of a large table by key: ranges that the scan can use to skip what it need not read.

A join reads its large side whole before it knows which keys it needs. Tables of an index are
sorted by ``doc_id`` inside each file, so a range of ids is a few pages of it. The wanted ids are
covered by at most RANGES ranges, which reach the Parquet reader as a pushed filter. That number
does not depend on how many ids are wanted: many ids make the ranges wide, never the plan long.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGES = 64


def covering_ranges(wanted: DataFrame, key: str = "doc_id", ranges: int = RANGES) -> list[tuple[int, int]]:
    """At most ``ranges`` ranges ``(first, last)`` that hold all whole numbers in ``wanted[key]``.

    The span of the ids is cut in equal parts and each part shrunk to the ids it holds, so large
    gaps fall out. Nulls meet nothing and are left out; no ids give no ranges.
    """
    ids = wanted.select(F.col(key).cast("bigint").alias("id")).filter("id IS NOT NULL")
    first, last = ids.agg(F.min("id"), F.max("id")).first()
    if first is None:
        return []
    part = F.width_bucket("id", F.lit(float(first)), F.lit(float(last) + 1), F.lit(ranges))
    # Very large ids can round beyond the last part; they stay in it.
    part = F.least(F.coalesce(part, F.lit(1)), F.lit(ranges))
    found = ids.groupBy(part.alias("part")).agg(F.min("id").alias("a"), F.max("id").alias("b")).collect()
    merged: list[tuple[int, int]] = []
    for a, b in sorted((r.a, r.b) for r in found):
        if merged and a <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def narrowed(table: DataFrame, ranges: list[tuple[int, int]], key: str = "doc_id") -> DataFrame:
    """Rows of ``table`` inside the ranges; a join with the wanted keys has still to follow."""
    inside = [F.col(key).between(F.lit(a), F.lit(b)) for a, b in ranges]
    return table.filter(reduce(lambda x, y: x | y, inside, F.lit(False)))
