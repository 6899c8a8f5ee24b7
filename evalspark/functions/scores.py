"""Expressions that read or show metric scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bounds (inclusive) of the score bands, best first.
BANDS = ((0.85, "Excellent"), (0.70, "Good"), (0.55, "Acceptable"), (0.40, "Poor"))
LOWEST_BAND = "Very poor"
BAR_WIDTH = 20


def numeric(score: Column) -> Column:
    """Score as double; text that is no number and NaN become null."""
    return F.nullif(score.try_cast("double"), F.lit(float("nan")))


def band(score: Column) -> Column:
    out = F.when(score.isNull(), None)
    for bound, name in BANDS:
        out = out.when(score >= bound, name)
    return out.otherwise(LOWEST_BAND)


def bar(mean: Column) -> Column:
    filled = F.least(F.greatest((mean * BAR_WIDTH).cast("int"), F.lit(0)), F.lit(BAR_WIDTH))
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(BAR_WIDTH) - filled))


def metric_label(metric: Column) -> Column:
    return F.initcap(F.replace(metric, F.lit("_"), F.lit(" ")))


def fixed(number: Column, digits: int) -> Column:
    """Text with ``digits`` decimals, rounded from the exact binary value as ``%.3f`` is.

    ``format_string`` rounds the shortest decimal form instead: 0.2875 would be 0.288.
    """
    return F.call_function("format_number", number, F.lit("0." + "0" * digits))
