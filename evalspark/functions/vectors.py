"""Vector expressions on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda total, x: total + x
    )


def length(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def normalize(vector: Column) -> Column:
    """Unit length; a zero vector stays zero.

    The length is paired with the elements: inside a lambda it would be computed
    anew for each of them.
    """
    size = F.nullif(length(vector), F.lit(0.0))
    scaled = F.zip_with(vector, F.array_repeat(size, F.size(vector)), lambda x, s: x / s)
    return F.when(F.exists(vector, lambda x: x != 0), scaled).otherwise(vector)
