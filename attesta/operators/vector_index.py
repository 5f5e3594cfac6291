"""An inverted file over vectors: cells around centroids, near pairs without loss, and nearest neighbours at a measured recall.

Centroids are fitted on a bounded sample; every vector is in the cell of its nearest centroid. For pairs at an angle of at
most t, a vector need only visit cells whose centroid is at most t + r away, r the largest angle of a member: by the
triangle inequality no pair is lost. Pairs meet by blocks of cells, and skip the cells of a block that are out of reach.
For nearest neighbours a query visits its `probes` nearest cells, as many as a sample needs for the stated recall; what it
meets is compared exactly. Cells are dealt in shards and their visitors in blocks, so that a task's size does not follow a
cell's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators.similar import best_of_groups, k_best
from attesta.streaming.events import written


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1)
    return x / np.where(size > 0, size, 1)[:, None]


def _angles(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centroids.T, -1.0, 1.0))


def fit_centroids(x: np.ndarray, cells: int, rounds: int = 6, seed: int = 1) -> np.ndarray:
    """Unit centroids of unit vectors, by rounds of nearest centroid and mean."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:cells]]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = np.linalg.norm(sums, axis=1) == 0
        c = _unit(np.where(empty[:, None], c, sums))
    return c


@dataclass(frozen=True)
class Index:
    """rows: (k, v array<double>, cell, angle), written down; centroids; per cell its size and its largest angle."""

    rows: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray
    sample: np.ndarray
    kind: str


def build(rows: DataFrame, key: str, vector: str, *, cells: int | None = None, sample: int = 10_000) -> Index:
    """Index all vectors of the length that most sampled ones have. Those with nulls, of nothing or of another length are left out.

    sample: rows, chosen by the hash of their key, that the centroids are fitted on; cells: by default the root of the
    number of rows, 1024 at most.
    """
    whole = F.when(~F.exists(vector, lambda x: x.isNull() | F.isnan(x)), F.col(vector).cast("array<double>"))
    held = rows.select(F.col(key).alias("k"), whole.alias("v")).filter("k is not null and size(v) > 0").filter(F.exists("v", lambda x: x != 0))
    some = held.orderBy(F.xxhash64("k")).limit(sample).collect()  # at most `sample` rows
    lengths = pd.Series([len(r["v"]) for r in some], dtype=int)
    width = int(lengths.mode().iloc[0]) if len(lengths) else 1
    x = _unit(np.array([r["v"] for r in some if len(r["v"]) == width], float).reshape(-1, width))
    n = cells or max(1, min(1024, math.isqrt(held.count()), len(x) // 4))
    centroids = fit_centroids(x, n) if len(x) else np.ones((1, width)) / math.sqrt(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                u = _unit(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
                a = _angles(u, centroids)
                at = pa.array(np.arange(len(u) + 1, dtype=np.int32) * np.int32(width))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(at, pa.array(u.reshape(-1))), pa.array(a.argmin(axis=1).astype(np.int32)), pa.array(a.min(axis=1, initial=math.pi))], ["k", "v", "cell", "angle"])

    kind = rows.schema[key].dataType.simpleString()
    placed = written(held.filter(F.size("v") == width).mapInArrow(run, f"k {kind}, v array<double>, cell int, angle double"))
    sizes, radii = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("r")).collect():  # at most `cells` rows
        sizes[r["cell"]], radii[r["cell"]] = r["n"], r["r"]
    return Index(placed, centroids, sizes, radii, x, kind)


def _visits(rows: DataFrame, index: Index, cells_of) -> DataFrame:
    """(k, v, cell, own) for each cell that cells_of(unit vectors, own cells) names for a row of (k, v, cell)."""
    step = max(1, 32768 // len(index.centroids))  # at most so many copies of vectors at once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                row, cell = np.nonzero(cells_of(_unit(x), part.column(2).to_numpy()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(cell.astype(np.int32)), part.column(2).take(pa.array(row))], ["k", "v", "cell", "own"])

    return rows.select("k", "v", "cell").mapInArrow(run, f"k {index.kind}, v array<double>, cell int, own int")


def _met(visits: DataFrame, index: Index, shard_rows: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Visitors (role 0) and members (role 1) of cells, as (k, v, own, i, j, role): i is a cell's block of visitors, j its shard."""
    spark, n = visits.sparkSession, len(index.centroids)
    asked = np.zeros(n, np.int64)
    for r in visits.groupBy("cell").count().collect():  # at most `cells` rows
        asked[r["cell"]] = r["count"]
    deal = [(c, int(max(1, -(-index.sizes[c] // shard_rows))), int(max(1, -(-asked[c] // block)))) for c in range(n)]
    parts = F.broadcast(spark.createDataFrame(deal, "cell int, shards int, blocks int"))  # `cells` rows
    h = lambda many: F.pmod(F.xxhash64("k"), F.col(many)).cast("int")
    i = F.col("cell") + F.lit(n) * F.col("blk")
    left = visits.join(parts, "cell").withColumn("blk", h("blocks")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    right = index.rows.join(parts, "cell").withColumn("j", h("shards")).withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("own", F.col("cell"))
    return left.select("k", "v", "own", i.alias("i"), "j", F.lit(0).alias("role")), right.select("k", "v", "own", i.alias("i"), "j", F.lit(1).alias("role"))


def near_pairs(rows: DataFrame, key: str, vector: str, least: float, *, cells: int | None = None, sample: int = 10_000, block: int | None = None, block_bytes: int = 32 << 20) -> DataFrame:
    """(a, b, cosine) of all pairs a < b of a cosine of `least` or more, least above 0; none is lost, each comes once.

    Cells are gathered in blocks, large ones split, and each two blocks that hold cells within reach of each other meet in
    one group, where the first is held and the second streams past it. So a vector is shuffled once for each block that its
    own may meet, not for each cell. block: vectors of a block; by default a 24th of all, 2048 at least and `block_bytes`
    at most, so that what is shuffled grows as the input until a block is full.
    """
    if least <= 0:
        raise ValueError("least must be above 0")
    index = build(rows, key, vector, cells=cells, sample=sample)
    spark, centroids, near = rows.sparkSession, index.centroids, math.acos(min(1.0, least)) + 1e-7
    width, reach, total = centroids.shape[1], index.radii + near, int(index.sizes.sum())
    size = block or max(1, min(max(2048, -(-total // 24)), block_bytes // (8 * width)))
    deal, held_by, room = [], [], 0  # (cell, its first block, how many it is dealt to); the cells of each block
    for cell in np.flatnonzero(index.sizes).tolist():
        many = -(-int(index.sizes[cell]) // size)
        if many > 1 or index.sizes[cell] > room:
            held_by, room = held_by + [[] for _ in range(many)], size if many == 1 else 0
        for at in range(len(held_by) - many, len(held_by)):
            held_by[at].append(cell)
        room -= int(index.sizes[cell])
        deal.append((cell, len(held_by) - many, many))
    close = _angles(centroids, centroids) <= index.radii[:, None] + reach
    meet = [(i, j) for i in range(len(held_by)) for j in range(i, len(held_by)) if i == j or close[np.ix_(held_by[i], held_by[j])].any()]
    sides = [(b, n, role) for n, pair in enumerate(meet) for role, b in enumerate(pair)]
    parts, turns = spark.createDataFrame(deal, "cell int, first int, many int"), spark.createDataFrame(sides, "blk int, pair int, role int")
    placed = index.rows.join(F.broadcast(parts), "cell").withColumn("blk", F.col("first") + F.pmod(F.xxhash64("k"), F.col("many")).cast("int"))
    dealt = placed.join(F.broadcast(turns), "blk").select("k", "v", "cell", "blk", "pair", "role").repartition(max(1, len(meet)), "pair").sortWithinPartitions("pair", "role", "cell")
    screen = least - (width + 8) * 2.0**-22  # what single precision may lose; those that pass are computed again

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, full = None, [], None

        def tile(k, x, cell, blk) -> Iterator[pa.RecordBatch]:
            hk, hx, hs, hcell, hblk = full
            reached = (_angles(x, centroids) <= reach).any(axis=0)
            some, xs = np.flatnonzero(reached[hcell]), x.astype(np.float32)
            for at in range(0, len(some), 2048):
                own = some[at : at + 2048]
                p, q = np.nonzero(hs[own] @ xs.T >= screen)
                p = own[p]
                for lo in range(0, len(p), 65536):
                    i, j = p[lo : lo + 65536], q[lo : lo + 65536]
                    value, a, b = np.einsum("ij,ij->i", hx[i], x[j]), hk[i], k[j]
                    fit = (value >= least) & ((a < b) | ((a != b) & (hblk != blk)))  # within one block, each pair meets twice
                    if fit.any():
                        a, b = a[fit], b[fit]
                        swap = a > b
                        yield pa.RecordBatch.from_arrays([pa.array(np.where(swap, b, a)), pa.array(np.where(swap, a, b)), pa.array(np.round(value[fit], 4))], ["a", "b", "cosine"])

        for batch in batches:
            pair, role = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            edges = np.flatnonzero((np.diff(pair) != 0) | (np.diff(role) != 0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                for at in range(lo, hi, 1024):
                    part = batch.slice(at, min(1024, hi - at))
                    k, x, cell = part.column(0).to_numpy(zero_copy_only=False), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width), part.column(2).to_numpy()
                    if group != pair[at]:
                        group, held, full = pair[at], [], None
                    if role[at] == 0:
                        held.append((k, x, cell, int(part.column(3)[0].as_py())))
                        continue
                    if full is None:
                        x0 = np.concatenate([h[1] for h in held])
                        full, held = (np.concatenate([h[0] for h in held]), x0, x0.astype(np.float32), np.concatenate([h[2] for h in held]), held[0][3]), []
                    yield from tile(k, x, cell, int(part.column(3)[0].as_py()))

    return dealt.mapInArrow(compare, f"a {index.kind}, b {index.kind}, cosine double")


def probes_for(index: Index, k: int, recall: float, queries: int = 200) -> int:
    """How many nearest cells `queries` sampled vectors must visit to find `recall` of their k nearest of the sample."""
    x, n = index.sample, len(index.centroids)
    if len(x) <= k:
        return n
    asked = x[:queries]
    sims = asked @ x.T
    sims[np.arange(len(asked)), np.arange(len(asked))] = -2
    top = np.argsort(-sims, axis=1)[:, :k]
    place = np.argsort(np.argsort(_angles(asked, index.centroids), axis=1), axis=1)
    home = _angles(x, index.centroids).argmin(axis=1)
    at = np.sort(np.take_along_axis(place, home[top], axis=1).ravel())
    return int(at[min(len(at) - 1, math.ceil(recall * len(at)) - 1)]) + 1


def search(index: Index, queries: DataFrame, k: int, *, recall: float = 0.95, shard_rows: int = 20_000, block: int = 2048) -> DataFrame:
    """(q, id, cosine) of about the k most similar rows of each query (q, qv), itself excluded; cosines are exact.

    recall is reached on the sample, and about so on all rows. Queries that build would leave out find nothing.
    """
    probes, centroids = probes_for(index, k, recall), index.centroids
    width, filled = centroids.shape[1], index.sizes > 0

    def cells_of(x: np.ndarray, _) -> np.ndarray:
        a = _angles(x, centroids)
        return np.argsort(np.argsort(np.where(filled, a, 9.0), axis=1), axis=1) < probes

    stated = queries.select(F.col("q").alias("k"), F.col("qv").cast("array<double>").alias("v"), F.lit(0).alias("cell")).filter(F.size("v") == width).filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x)) & F.exists("v", lambda x: x != 0))
    left, right = _met(_visits(stated, index, cells_of), index, shard_rows, block)
    kinds = f"q {queries.schema['q'].dataType.simpleString()}, id {index.kind}, cosine double"
    return k_best(best_of_groups(left.unionByName(right), width, k, kinds), k)
