"""Small column functions on the texts of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def variation(values: Column) -> Column:
    """The population standard deviation over the mean of an array; 0 of nothing. One pass."""
    sums = F.aggregate(values, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda s, x: F.struct((s["a"] + x).alias("a"), (s["b"] + x * x).alias("b")), lambda s: F.when(s["a"] > 0, F.sqrt(F.greatest(F.size(values) * s["b"] / (s["a"] * s["a"]) - 1, F.lit(0.0)))).otherwise(F.lit(0.0)))
    return F.coalesce(sums, F.lit(0.0))


def quote(text: Column, marker: str, before: int = 30, after: int = 60) -> Column:
    """The text around the first occurrence of a marker; null without one."""
    at = F.locate(marker, F.lower(text))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + F.lit(len(marker) + after)))
