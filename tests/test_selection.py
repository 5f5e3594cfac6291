"""Order statistics over range partitions against sorting by hand."""

import math
import random

from pyspark.sql import functions as F

from attesta.operators import selection


def by_hand(values, p):
    s = sorted(values)
    place = (len(s) - 1) * p
    a, b = s[math.floor(place)], s[math.ceil(place)]
    return a + (b - a) * (place - math.floor(place))


def test_quantiles(spark):
    r = random.Random(1)
    data = [(g, float(r.randrange(-50, 50))) for g in ["hot"] * 3000 + ["b", None] * 40 + ["one"]]
    data += [("hot", 7.0)] * 2000 + [("none", None), ("hot", None)]
    df = spark.createDataFrame(data, "g string, x double").repartition(7)
    for most in (0, 60, 200_000):  # all groups are ranged, the hot one, none
        got = {row["g"]: (row["n"], row["q"]) for row in selection.quantiles(df, ["g"], "x", [0.0, 0.25, 0.5, 0.9, 1.0], most=most).collect()}
        assert set(got) == {"hot", "b", None, "one"}
        for g, (n, q) in got.items():
            values = [x for h, x in data if h == g and x is not None]
            assert n == len(values) and all(math.isclose(a, by_hand(values, p)) for a, p in zip(q, [0.0, 0.25, 0.5, 0.9, 1.0]))


def test_quantiles_in_many_ranges(spark):
    values = [float(i * 37 % 1000) for i in range(5000)]
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(x,) for x in values], "x double")
        (row,) = selection.quantiles(df, [], "x", [0.1, 0.5, 0.999], most=0).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    assert row["n"] == 5000 and all(math.isclose(a, by_hand(values, p)) for a, p in zip(row["q"], [0.1, 0.5, 0.999]))


def test_counted_values_and_ranks(spark):
    df = spark.createDataFrame([("a", 2, 3), ("a", 1, 2), ("a", 9, 0), ("a", 2, 1)], "g string, x int, c long")
    ranks = [lambda n: F.lit(0), lambda n: F.lit(1), lambda n: F.lit(2), lambda n: n - 1, lambda n: n]
    (row,) = selection.at_ranks(df, ["g"], "x", ranks, "c").collect()
    assert (row["n"], row["v"]) == (6, [1, 1, 2, 2, None])
    assert selection.quantiles(df.limit(0), ["g"], "x", [0.5]).collect() == []


def test_share_by_hash(spark):
    df = spark.range(997).select(F.sha1(F.col("id").cast("string").cast("binary")).alias("h"))
    every = sorted(row["h"] for row in df.collect())
    for share in (0.0, 0.2, 0.5, 1.0):
        for digits in (1, 4):
            assert [row["edge"] for row in selection.share_by_hash(df, "h", share, digits).collect()] == [every[max(1, math.ceil(share * 997)) - 1]]
    assert selection.share_by_hash(df.limit(0), "h", 0.2).collect() == []
