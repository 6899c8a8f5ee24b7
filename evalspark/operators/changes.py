"""Which documents changed between two states of a corpus, and what that does to counts.

A state is a table ``doc_id, digest`` of one row per id. Ids may be null or repeat: the
digest covers all rows of an id, in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "doc_id"


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, digest`` over all columns; nulls count by their place."""
    columns = [c for name in sorted(docs.columns) for c in (F.col(name), F.col(name).isNull())]
    row = F.xxhash64(*columns)
    return (
        docs.select(KEY, row.alias("row"))
        .groupBy(KEY)
        .agg(F.count("*").alias("n"), F.bit_xor("row").alias("x"), F.sum(F.col("row").cast("decimal(20,0)")).alias("s"))
        .select(KEY, F.concat_ws(" ", "n", "x", "s").alias("digest"))
    )


def touched(before: DataFrame, after: DataFrame) -> DataFrame:
    """``doc_id`` of documents that are new, changed or gone: their digest stands on one side only."""
    both = before.select(KEY, "digest").unionByName(after.select(KEY, "digest"))
    once = both.groupBy(KEY, "digest").agg(F.count("*").alias("sides")).filter("sides = 1")
    return once.select(KEY).distinct()


def _meets(table: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    ids = ids.select(F.col(KEY).alias("_touched_id"))
    return table.join(ids, table[KEY].eqNullSafe(ids["_touched_id"]), how)


def without(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of documents that are not in ``ids(doc_id)``, a null id among them or not."""
    return _meets(table, ids, "left_anti")


def only(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of documents in ``ids(doc_id)``."""
    return _meets(table, ids, "left_semi")


def mended_frequency(before: DataFrame, lost: DataFrame, added: DataFrame) -> DataFrame:
    """``experiment, term, df`` after chunks were lost and added; terms that no chunk has left go.

    All three are tables of that form, so only the words of touched documents are counted.
    """
    columns = ["experiment", "term", "df"]
    return (
        before.select(*columns)
        .unionByName(lost.select("experiment", "term", (-F.col("df")).alias("df")))
        .unionByName(added.select(*columns))
        .groupBy("experiment", "term")
        .agg(F.sum("df").alias("df"))
        .filter("df > 0")
    )
