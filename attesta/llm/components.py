"""Connected components as rounds of joins (alternating large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each node of edges (u, v) but the smallest of its component; component is that smallest id.

    Null ends are dropped; loops and repeated edges are harmless; no edges give no rows. Every step is a grouped
    minimum and a join by one key: the edges of one node meet in one task of the join.
    """
    now = cut(edges.filter("u is not null and v is not null and u <> v").select("u", "v").distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if mark["n"] == 0 or before == (mark["n"], mark["x"]):
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = (mark["n"], mark["x"])
        now = cut(_small_star(_large_star(now)), "edges")
