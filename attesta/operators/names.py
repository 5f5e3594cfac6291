"""Fuzzy names: ratios of common characters, and joins of names whose ratio reaches a limit, without comparing all pairs.

The ratio of two strings is 100 * 2 * L / (sum of lengths), L the length of their longest common subsequence. A ratio of
`least` allows d = (1 - least / 100) * (sum of lengths) insertions and deletions.

Short strings join on deletion neighbourhoods: two strings reach the limit if and only if deleting i characters of one
and j of the other, i + j <= d, gives the same string, so they join on (i, j, what is left), and nothing joins that is
not a result. The number of ways to delete grows with the length; where it passes `most`, strings join on segments: if
the shorter is split into d + 1 segments, one of them is whole in the longer, at most d places away; so they join on
(length, segment, its characters), and what joins is compared. Nothing that reaches the limit is lost either way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common(a: str, b: str) -> int:
    """The length of the longest common subsequence, with one bit of an integer per character of b."""
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for c in a:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 0.0


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter string with any part of the longer that is as long, or cut by its ends."""
    a, b = sorted((a, b), key=len)
    if not a:
        return 0.0
    if a in b:
        return 100.0
    n = len(a)
    return max(ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)) if b[max(0, i) : i + n])


def sorted_words(name: str | None) -> str:
    return " ".join(sorted((name or "").split()))


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of two names' sorted words; 0 where both are empty."""
    return pd.Series([round(ratio(sorted_words(x), sorted_words(y)), 4) for x, y in zip(a, b)], dtype=float)


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """See partial; nulls count as empty."""
    return pd.Series([round(partial(x or "", y or ""), 4) for x, y in zip(a, b)], dtype=float)


def budget(n: int, least: float) -> int:
    """Insertions and deletions that a string of n characters and a longer one may differ by: d <= (1 - least) * (2n + d)."""
    share = 1 - least / 100
    return math.floor(share * 2 * n / (1 - share) + 1e-9)


def segments(n: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of `parts` even segments of n characters."""
    at = [n * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def allowed(left: int, i: int, j: int, least: float) -> bool:
    """Whether strings of left + i and left + j characters that share `left` of them reach the limit."""
    return 200.0 * left >= least * (2 * left + i + j) - 1e-9


def _deletions(n: int, least: float) -> int:
    """The most characters that a string of n may lose."""
    return max(i for i in range(n + 1) if allowed(n - i, i, 0, least))


def short_limit(least: float, most: int) -> int:
    """The longest strings whose deletion neighbourhood, and that of all shorter ones, has at most `most` members."""
    n = 0
    while sum(math.comb(n + 1, i) for i in range(_deletions(n + 1, least) + 1)) <= most:
        n += 1
        if n > 200:  # at a limit of 100, nothing may be deleted
            break
    return n


def _neighbours(s: str, least: float, probe: bool) -> set[str]:
    """Keys of a short string: how many characters it and its partner lose, in this order for one side, and what is left."""
    n, out = len(s), set()
    for i in range(_deletions(n, least) + 1):
        partner = [j for j in range(n + 1) if allowed(n - i, i, j, least)]
        for gone in combinations(range(n), i):
            left = "".join(s[a + 1 : b] for a, b in zip((-1, *gone), (*gone, n)))
            out.update(f"{j}.{i}.{left}" if probe else f"{i}.{j}.{left}" for j in partner)
    return out


def _keys(s: str, least: float, probe: bool, limit: int) -> set[str]:
    """Keys by segments, for pairs of which the longer string has more than `limit` characters."""
    n, out = len(s), set()
    if not probe:
        d = budget(n, least)
        return {f"{n}:{i}:{s[a : a + k]}" for i, (a, k) in enumerate(segments(n, d + 1))} if n + d > limit else out
    if n <= limit:
        return out
    for m in range(n, 0, -1):
        d = budget(m, least)
        if n - m > d:
            break
        for i, (a, k) in enumerate(segments(m, d + 1)):
            for at in range(max(0, a - d), min(n - k, a + d) + 1):
                out.add(f"{m}:{i}:{s[at : at + k]}")
    return out


def _keyed(names: DataFrame, keys_of) -> DataFrame:
    """(name, key): 64-bit hashes of the keys that keys_of(sorted words) gives.

    The few bytes of the names say nothing of the work and of the keys, so they are dealt to as many tasks as a shuffle has.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                rows = [(s, sorted(keys_of(sorted_words(s)))) for s in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["name", "keys"])

    dealt = names.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("name"))  # by the name itself, its grouping's few partitions would stay
    return dealt.mapInArrow(run, "name string, keys array<string>").select("name", F.explode("keys").alias("key")).select("name", F.xxhash64("key").alias("key"))


def name_candidates(x: DataFrame, y: DataFrame, least: float, most: int = 4000) -> DataFrame:
    """(a, b): distinct pairs of names of two frames (name) that may reach the limit; all that do are among them.

    Keys meet in a merge join: Spark takes them for as few bytes as their names have, and would broadcast some hundred a name.
    """
    limit = short_limit(least, most)
    a, b = F.col("name").alias("a"), F.col("name").alias("b")
    near = lambda probe: lambda s: _neighbours(s, least, probe) if len(s) <= limit else set()
    far = lambda probe: lambda s: _keys(s, least, probe, limit)
    join = lambda left, right: _keyed(x, left).select(a, "key").join(_keyed(y, right).select(b, "key").hint("merge"), "key").select("a", "b")
    return join(near(False), near(True)).unionByName(join(far(False), far(True))).unionByName(join(far(True), far(False))).distinct()


def similar_names(left: DataFrame, right: DataFrame, least: float = 92.0) -> DataFrame:
    """(a, b, ratio) of the names of two one-column frames whose ratio is `least` or more; equal names included.

    Null and blank names match nothing; repeated names count once.
    """
    x, y = (d.select(F.col(d.columns[0]).alias("name")).filter("trim(name) <> ''").distinct() for d in (left, right))
    return name_candidates(x, y, least).withColumn("ratio", token_sort_ratio("a", "b")).filter(F.col("ratio") >= least)


def resolved(claimed: DataFrame, known: DataFrame, least: float = 92.0) -> DataFrame:
    """(name, found) of each claimed name: itself if known, else the most similar known name (the first of equals), else itself."""
    names = claimed.select(F.col(claimed.columns[0]).alias("name")).filter("name is not null").distinct()
    exact = known.select(F.col(known.columns[0]).alias("name")).distinct().withColumn("known", F.lit(True))
    marked = names.join(exact, "name", "left")
    near = similar_names(marked.filter("known is null").select("name"), exact.select("name"), least)
    best = near.groupBy(F.col("a").alias("name")).agg(F.min_by("b", F.struct(-F.col("ratio"), F.col("b"))).alias("near"))
    return marked.join(best, "name", "left").select("name", F.coalesce(F.when(F.col("known"), F.col("name")), "near", "name").alias("found"))


def plain_name(name: Column) -> Column:
    """Lower case, no quotes or punctuation, no legal forms, single spaces."""
    x = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " ")
    return F.array_join(F.filter(F.split(F.trim(x), " "), lambda w: ~w.isin("llc", "ltd", "inc", "gmbh", "corp", "co", "plc") & (w != "")), " ")
