"""Aggregations: funnels, series, histograms, rankings, coverage, weighted and decayed means."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.selection import quantiles


def funnel(rows: DataFrame, key: str, steps: Mapping[str, DataFrame | Column], by: list[str] | None = None) -> DataFrame:
    """Counts of rows, and of those that reach each step: a condition, or a DataFrame that has the key.

    A DataFrame step is an existence test: its distinct keys are joined as a flag, so tests can be combined freely.
    """
    for name, step in steps.items():
        if isinstance(step, DataFrame):
            flags = step.select(F.col(key)).distinct().withColumn(f"__{name}", F.lit(True))
            rows = rows.join(flags, key, "left")
    reached = [F.count_if(F.coalesce(F.col(f"__{n}"), F.lit(False)) if isinstance(s, DataFrame) else s).alias(n) for n, s in steps.items()]
    return rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total"), *reached)


def daily_series(rows: DataFrame, ts: str, **conditions: Column) -> DataFrame:
    """Per day: the count of rows and of those that meet each condition."""
    return rows.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(k) for k, c in conditions.items()))


def histogram(rows: DataFrame, value: Column, bins: int = 12) -> DataFrame:
    """(bin, lo, hi, n) of equal-width bins; the last is closed; one distinct value makes one bin; empty bins are listed."""
    spark = rows.sparkSession
    x = rows.select(value.cast("double").alias("x")).filter("x is not null")
    edges = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()  # one row
    if edges["lo"] is None:
        return spark.range(0).select(F.col("id").alias("bin"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), F.lit(0).cast("long").alias("n"))
    lo, hi = edges["lo"], edges["hi"]
    bins = bins if hi > lo else 1
    step = (hi - lo) / bins
    index = F.least(F.lit(bins - 1), F.floor((F.col("x") - lo) / step)) if step else F.lit(0)
    counts = x.groupBy(index.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(bins).withColumnRenamed("id", "bin")
    return every.join(counts, "bin", "left").select("bin", (F.lit(lo) + F.col("bin") * step).alias("lo"), (F.lit(lo) + (F.col("bin") + 1) * step).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def top_groups(rows: DataFrame, name: Column, n: int, blank: str = "(none)") -> DataFrame:
    """The n most frequent names, ties by name; blank names become a placeholder."""
    named = F.when(F.trim(F.coalesce(name, F.lit(""))) == "", F.lit(blank)).otherwise(name)
    return rows.groupBy(named.alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(n)


def coverage(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row: the total, and for each condition how many meet it."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(c).alias(k) for k, c in conditions.items()))


def weighted_mean(x: Column, w: Column) -> Column:
    """Sum of x*w over sum of w, null where no weight is left."""
    return F.sum(x * w) / F.nullif(F.sum(F.when(x.isNotNull(), w)), F.lit(0.0))


def capped_per_group(rows: DataFrame, cell: list[str], owner: str, key: list[str], share: float = 0.2) -> DataFrame:
    """At most max(1, floor(share of the cell)) rows of one owner in each cell, the first by key."""
    size = F.count(F.lit(1)).over(Window.partitionBy(*cell))
    place = F.row_number().over(Window.partitionBy(*cell, owner).orderBy(*key))
    return rows.withColumns({"__size": size, "__place": place}).filter(F.col("__place") <= F.greatest(F.lit(1), F.floor(F.col("__size") * share))).drop("__size", "__place")


def cascade_cells(rows: DataFrame, levels: list[str], value: str) -> DataFrame:
    """Count and quartiles of every prefix of the levels: the most detailed cell is level 1."""
    cells = rows.select(value, *levels, F.explode(F.sequence(F.lit(1), F.lit(len(levels)))).alias("level"))
    named = [F.when(F.col("level") <= len(levels) - i, F.col(c)).alias(c) for i, c in enumerate(levels)]
    per = quantiles(cells.select("level", value, *named), ["level", *levels], value, [0.25, 0.5, 0.75])
    return per.select("level", *levels, "n", *(F.round(F.col("q")[i], 6).alias(k) for i, k in enumerate(("p25", "median", "p75"))))


def decayed_axis(rows: DataFrame, by: list[str], weight: Column, months: Column, cap: float, half: float = 18.0, scale: float = 6.0) -> DataFrame:
    """Per group: cap * (1 - e^(-S / scale)) of S, the sum of weights that fade with age."""
    total = F.sum(weight * F.exp(-F.greatest(months, F.lit(0.0)) / half))
    return rows.groupBy(*by).agg(F.round(F.lit(cap) * (1 - F.exp(-total / scale)), 4).alias("axis"), F.count(F.lit(1)).alias("n"))


def auroc(rows: DataFrame, score: str, label: str, ranges: int = 200) -> DataFrame:
    """One row: the area under the ROC curve, ties counting half, from counts per distinct score.

    The scores are ranked within ranges of about equal size; the totals of the ranges, a few numbers each, give the offsets.
    """
    value = F.col(score).cast("double")
    edges = sorted(set(rows.select(value.alias("s")).approxQuantile("s", [i / ranges for i in range(1, ranges)], 0.5 / ranges)))
    bucket = F.when(F.col("s").isNull(), F.lit(-1)).otherwise(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("s").cast("double"))) if edges else F.lit(0))
    per = rows.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).withColumn("bucket", bucket)
    totals = sorted(tuple(r) for r in per.groupBy("bucket").agg(F.sum("p"), F.sum("n")).collect())  # one row a range
    offsets, before = {}, 0
    for k, _, n in totals:
        offsets[k], before = before, before + n
    pairs = float(sum(t[1] for t in totals) * before)
    offset = F.element_at(F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv)), F.col("bucket")) if offsets else F.lit(0)
    within = F.sum("n").over(Window.partitionBy("bucket").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    area = F.sum(F.col("p") * F.col("below") + F.col("p") * F.col("n") * 0.5)
    return per.withColumn("below", F.coalesce(within, F.lit(0)) + offset).agg(F.round(area / F.nullif(F.lit(pairs), F.lit(0.0)), 6).alias("auroc"))


def threshold_grid(rows: DataFrame, score: str, label: str, limits: list[float]) -> DataFrame:
    """(limit, tp, fp, fn, tn) of predicting 1 at each limit; each row is spread over the grid and counted before any shuffle."""
    grid = rows.select(score, label, F.explode(F.array(*(F.lit(x) for x in limits))).alias("limit"))
    yes, one = F.col(score) >= F.col("limit"), F.col(label) == 1
    return grid.groupBy("limit").agg(F.count_if(yes & one).alias("tp"), F.count_if(yes & ~one).alias("fp"), F.count_if(~yes & one).alias("fn"), F.count_if(~yes & ~one).alias("tn"))
