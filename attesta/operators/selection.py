"""Exact order statistics of groups of any size: ranks of large groups are found over range partitions, no task holds one.

For `at_ranks`, equal values of a group are counted first. The values are dealt into ranges in the order of group and value, sorted
there, and written with the range's number and a running total of the counts, which one pass over Arrow batches adds. The
ranges' totals, one row for each group and range, say in which range and at which running total a wanted rank is. Nulls are
no values; a group without values has no row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.streaming.events import written


def _same(names: list[str], other: str) -> Column:
    """Equal groups, nulls alike, of columns whose names on the other side begin so."""
    return reduce(and_, (F.col(c).eqNullSafe(F.col(other + c)) for c in names))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a range with the running total of n, whatever the group."""
    before = 0
    for batch in batches:
        upto = np.cumsum(batch.column("n").to_numpy()) + before
        before = int(upto[-1]) if len(upto) else before
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto, pa.int64())], [*batch.schema.names, "upto"])


def at_ranks(rows: DataFrame, by: list[str], value: str, ranks: list[Callable[[Column], Column]], count: str | None = None) -> DataFrame:
    """(by, n, v): of each group, its number of values and the values at the ranks (from 0), each a function of that number.

    count: a column that says how often a row's value counts, else once. Groups may be null. A rank beyond the group's
    values gives null. by may be empty: then all rows are one group, and of no values there is no row.
    """
    found = _ranked(_counted(rows, by, value, count), _names(by), ranks)
    return found.select(*(F.col(g).alias(c) for g, c in zip(_names(by), by)), "n", "v")


def _names(by: list[str]) -> list[str]:
    return [f"g{i}" for i in range(max(1, len(by)))]


def _counted(rows: DataFrame, by: list[str], value: str, count: str | None) -> DataFrame:
    """(g0, ..., x, n): how often each group has each value."""
    group = [F.col(c).alias(f"g{i}") for i, c in enumerate(by)] or [F.lit(0).alias("g0")]
    n = F.col(count).cast("long") if count else F.lit(1).cast("long")
    return rows.select(*group, F.col(value).alias("x"), n.alias("n")).filter("x is not null and n > 0").groupBy(*_names(by), "x").agg(F.sum("n").alias("n"))


def _ranked(counted: DataFrame, names: list[str], ranks: list[Callable[[Column], Column]]) -> DataFrame:
    ranges = counted.repartitionByRange(*names, "x").withColumn("part", F.spark_partition_id()).sortWithinPartitions(*names, "x")
    return _looked_up(written(ranges.mapInArrow(_running, ranges.withColumn("upto", F.lit(1).cast("long")).schema)), names, ranks)


def _looked_up(held: DataFrame, names: list[str], ranks: list[Callable[[Column], Column]]) -> DataFrame:
    """(names, n, v) from the written ranges (names, x, n, part, upto)."""
    within = Window.partitionBy(*names)
    totals = held.groupBy(*names, "part").agg(F.sum("n").alias("t"), F.min(F.col("upto") - F.col("n")).alias("base"))
    placed = totals.withColumns({"start": F.sum("t").over(within.orderBy("part")) - F.col("t"), "all": F.sum("t").over(within)})
    asked = F.array(*(F.struct(F.lit(i).alias("i"), r(F.col("all")).cast("long").alias("rank")) for i, r in enumerate(ranks)))
    here = F.filter(asked, lambda a: (a["rank"] >= F.col("start")) & (a["rank"] < F.col("start") + F.col("t")))
    places = F.transform(here, lambda a: F.struct(a["i"].alias("i"), (a["rank"] - F.col("start") + F.col("base")).alias("at")))
    wanted = placed.withColumn("asked", places).filter(F.size("asked") > 0).select(*(F.col(c).alias(f"w{c}") for c in names), F.col("part").alias("wpart"), "asked")

    hit = F.filter("asked", lambda a: (a["at"] >= F.col("upto") - F.col("n")) & (a["at"] < F.col("upto")))
    found = held.join(wanted, _same(names, "w") & (F.col("part") == F.col("wpart"))).select(*names, "x", F.explode(hit).alias("a"))
    values = [F.max(F.when(F.col("a.i") == i, F.col("x"))).alias(f"v{i}") for i in range(len(ranks))]
    sizes = totals.groupBy(*(F.col(c).alias(f"s{c}") for c in names)).agg(F.sum("t").alias("n"))
    return sizes.join(found.groupBy(*names).agg(*values), _same(names, "s"), "left").select(*(F.col(f"s{c}").alias(c) for c in names), "n", F.array(*(F.col(f"v{i}") for i in range(len(ranks)))).alias("v"))


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], count: str | None = None, most: int = 200_000, each: int = 500_000) -> DataFrame:
    """(by, n, q): of each group, its number of values and, for each share, the quantile between its two nearest values.

    Rows are dealt into sorted ranges of about `each` rows, and are not gathered by value before that: what a task holds is a
    range. There are 200 ranges at most (spark.shuffle.sort.bypassMergeThreshold): of more, the tasks that deal would hold all
    their rows to sort them by range, so that ranges grow then, and their sort spills. Groups that lie within a range and have at most `most` rows there are settled as the range
    streams by; the others, of which a range has two and those of more than `most` rows, are ranked over ranges. All is exact.
    """
    names, k = _names(by), len(shares)
    group = [F.col(c).alias(g) for g, c in zip(names, by)] or [F.lit(0).alias("g0")]
    n = F.col(count).cast("long") if count else F.lit(1).cast("long")
    single = rows.select(*group, F.col(value).cast("double").alias("x"), n.alias("n")).filter("x is not null and n > 0")
    # Equal values from several tasks may part, so that a frequent one does not make a range.
    dealt = single.withColumn("of", F.spark_partition_id()).repartitionByRange(min(200, max(1, math.ceil(single.count() / each))), *names, "x", "of").drop("of")
    ranges = dealt.withColumn("part", F.spark_partition_id()).sortWithinPartitions(*names, "x")
    held = written(ranges.mapInArrow(_settling(names, shares, most), ranges.withColumns({"upto": F.lit(1).cast("long"), "q": F.lit(None).cast("array<double>")}).schema))
    low = [lambda n, p=p: F.floor((n - 1) * p) for p in shares]
    high = [lambda n, p=p: F.ceil((n - 1) * p) for p in shares]

    def between(i: int) -> Column:
        place = (F.col("n") - 1) * shares[i]
        return F.col("v")[i] + (F.col("v")[k + i] - F.col("v")[i]) * (place - F.floor(place))

    many = _looked_up(held.filter("q is null").drop("q"), names, low + high)
    both = held.filter("q is not null").select(*names, "n", "q").unionByName(many.select(*names, "n", F.array(*(between(i) for i in range(k))).alias("q")))
    return both.select(*(F.col(g).alias(c) for g, c in zip(names, by)), "n", "q")


def _settling(names: list[str], shares: list[float], most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a sorted range's batches (names, x, n, part): one row with quantiles of each group of at most `most` rows that neither
    begins nor ends the range; the rows of the others as they are, with the running total of n among them, without quantiles."""

    def starts(batch: pa.RecordBatch) -> np.ndarray:
        """The rows whose group is another than that of the row before."""
        new = np.zeros(batch.num_rows - 1, bool)
        for c in names:
            a, b = batch.column(c)[:-1], batch.column(c)[1:]
            differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
            new |= differ | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
        return np.flatnonzero(new) + 1

    def settled(whole: pa.RecordBatch, edges: np.ndarray) -> pa.RecordBatch:
        """One row for each group of whole, which edges divide."""
        x, n = whole.column("x").to_numpy(), whole.column("n").to_numpy()
        first, upto = edges[:-1], np.cumsum(n)
        before = upto[first] - n[first]
        total = upto[edges[1:] - 1] - before
        at = lambda rank: x[np.searchsorted(upto, before + rank, side="right")]
        found = []
        for p in shares:
            place = (total - 1) * p
            lo, hi = np.floor(place), np.ceil(place)
            a, b = at(lo.astype(np.int64)), at(hi.astype(np.int64))
            found.append(np.where(a == b, a, (hi - place) * a + (place - lo) * b))
        q = pa.ListArray.from_arrays(np.arange(len(first) + 1, dtype=np.int32) * len(shares), np.stack(found, axis=1).ravel())
        one = whole.take(pa.array(first))
        return pa.RecordBatch.from_arrays([*(one.column(c) for c in names), one.column("x"), pa.array(total), one.column("part"), pa.array(total), q], [*names, "x", "n", "part", "upto", "q"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, opening, passing, held = 0, True, False, []  # held: the rows of the group that is open, unless they pass

        def as_they_are(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal before
            upto = np.cumsum(batch.column("n").to_numpy()) + before
            before = int(upto[-1])
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto, pa.int64()), pa.nulls(batch.num_rows, pa.list_(pa.float64()))], [*batch.schema.names, "upto", "q"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            seam = batch if last is None else pa.concat_batches([last, batch])
            edges = starts(seam) - (seam.num_rows - batch.num_rows)
            last = batch.slice(batch.num_rows - 1)
            if not len(edges):
                held.append(batch)
            else:
                if edges[0]:
                    held.append(batch.slice(0, edges[0]))
                size = sum(b.num_rows for b in held)
                if opening or passing or size > most:
                    yield from map(as_they_are, held)
                else:
                    whole = pa.concat_batches(held)
                    yield settled(whole, np.array([0, whole.num_rows]))
                opening, passing, held = False, False, [batch.slice(edges[-1])]
                inner = batch.slice(edges[0], edges[-1] - edges[0])
                long = np.diff(edges) > most
                if long.any():
                    large = np.repeat(long, np.diff(edges))
                    yield as_they_are(inner.filter(pa.array(large)))
                    inner = inner.filter(pa.array(~large))
                if inner.num_rows:
                    yield settled(inner, np.concatenate([[0], np.cumsum(np.diff(edges)[~long])]))
            if opening or passing or sum(b.num_rows for b in held) > most:
                yield from map(as_they_are, held)
                passing, held = True, []
        yield from map(as_they_are, held)

    return run


def share_by_hash(rows: DataFrame, digest: str, share: float, digits: int = 4) -> DataFrame:
    """One row (edge): the hexadecimal digest at rank ceil(share of the rows) - 1, the first at least; of no rows, none.

    Digests are counted by their first digits; the counts, 16 ** digits at most, say which beginning holds the rank, and only
    rows of that beginning are ordered.
    """
    start = F.substring(digest, 1, digits)
    counts = rows.filter(F.col(digest).isNotNull()).groupBy(start.alias("start")).agg(F.count(F.lit(1)).alias("t"))
    every = Window.partitionBy(F.lit(0))
    placed = counts.withColumns({"before": F.sum("t").over(every.orderBy("start")) - F.col("t"), "all": F.sum("t").over(every)})
    rank = F.greatest(F.ceil(F.col("all") * share), F.lit(1)) - 1
    bucket = placed.withColumn("rank", rank).filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("t")))
    kept = rows.select(F.col(digest).alias("h"), start.alias("start")).join(F.broadcast(bucket.select("start", (F.col("rank") - F.col("before")).alias("r"))), "start")  # one row
    near = kept.groupBy("h", "r").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("r").orderBy("h"))  # a 16 ** digits-th of the rows
    return near.withColumn("upto", upto).filter((F.col("r") >= F.col("upto") - F.col("n")) & (F.col("r") < F.col("upto"))).select(F.col("h").alias("edge"))
