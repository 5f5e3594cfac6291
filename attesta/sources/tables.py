"""The input tables, and the moment that stands for now where an operator needs one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> Column:
    """The reference moment; a parameter of the data, not of the clock, so that results repeat."""
    return F.lit(NOW).cast("timestamp")
