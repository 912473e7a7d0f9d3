"""Vector expressions over arrays; sums in double, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def min_max(score: Column, low: Column, high: Column) -> Column:
    """Scaled to 0..1; 0.5 where all scores are equal."""
    return F.when(high == low, F.lit(0.5)).otherwise((score - low) / (high - low))
