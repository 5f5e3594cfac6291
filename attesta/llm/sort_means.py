"""k-means over vectors of integers by sort-means: exact, with the distances that the triangle inequality leaves.

Each round, the centroids are ordered by their distance from each centroid. A vector begins at the centroid that it
had, at distance d, and looks at the others in that centroid's order; one that is farther than 2 d from it can't be
nearer to the vector, nor can any after it, so the scan stops there. Ties go to the smaller number, so it stops only
strictly beyond. All is integer arithmetic: squared distances compare as d(p, j) > 4 d(x, p).

A round is one pass that reads the vectors with their centroids of the round before and writes them with the new ones,
and one grouped sum, combined before it is shuffled. Only the centroids pass through the driver: k vectors, k a parameter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import cut, drop_cut

WHOLE = 1 << 26  # components up to this: squared distances of up to 512 of them fit 64 bits


def integers(vectors: DataFrame, *, dim: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x array<long>): floor(scale * component) of the vectors of exactly dim finite components; others are left out."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    whole = (F.size("v") == dim) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform("v", lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).filter(whole).select("id", x.alias("x"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x from c; Python's integers where 64 bits might not hold them."""
    d = x - c
    return (d * d).sum(axis=1)


def exact(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """x and the centroids in a type that holds their squared distances."""
    c = np.array(centroids, dtype=object)
    if not len(x) or max(abs(int(x.min())), abs(int(x.max())), int(np.abs(c).max())) <= WHOLE:
        return x, c.astype(np.int64)
    return x.astype(object), c


def nearest(x: np.ndarray, centroids: list[list[int]], had: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row of x; had: where its scan begins."""
    x, c = exact(x, centroids)
    k = len(c)
    cluster, distance = had.astype(np.int32).copy(), np.zeros(len(x), x.dtype)
    for p in range(k):
        rows = np.flatnonzero(had == p)
        if not len(rows):
            continue
        apart = squared(c, c[p])
        own = squared(x[rows], c[p])
        best, at = own.copy(), np.full(len(rows), p, np.int32)
        live = np.arange(len(rows))
        for j in sorted((j for j in range(k) if j != p), key=lambda j: (apart[j], j)):
            live = live[(4 * own[live] >= apart[j]).astype(bool)]
            if not len(live):
                break
            d = squared(x[rows[live]], c[j])
            nearer = ((d < best[live]) | ((d == best[live]) & (j < at[live]))).astype(bool)
            best[live[nearer]], at[live[nearer]] = d[nearer], j
        cluster[rows], distance[rows] = at, best
    return cluster, distance


def _assigned(rows: DataFrame, centroids: list[list[int]], dim: int, tell: bool = False) -> DataFrame:
    """(id, x, had) with had replaced by the nearest centroid; tell: (id, had, distance), null where it does not fit a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            had, far = nearest(x, centroids, batch.column(2).to_numpy())
            if tell:
                told = pa.array([int(d) if d < 1 << 63 else None for d in far], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(had), told], ["id", "had", "distance"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(had)], ["id", "x", "had"])

    return rows.mapInArrow(run, "id long, had int, distance long" if tell else "id long, x array<long>, had int")


def _seeds(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [list(r["x"]) for r in rows.select("x", name.alias("h")).orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()]  # k rows


def _moved(rows: DataFrame, centroids: list[list[int]], dim: int) -> list[list[int]]:
    """Each centroid as the floor of its vectors' mean; one without vectors stays."""
    sums = rows.groupBy("had").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.get("x", F.lit(i)).cast("decimal(28,0)")).alias(f"s{i}") for i in range(dim)))
    out = [list(c) for c in centroids]
    for r in sums.collect():  # at most k rows
        out[r["had"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dim)]
    return out


def sort_means(vectors: DataFrame, *, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that is kept.

    Kept are vectors of exactly dim components, none null or not finite. Centroids begin as the k kept vectors of the
    smallest sha256 of `seed:id`, null ids last, repeated ids by their components; fewer vectors give fewer centroids.
    Rows of null or repeated ids are kept as they are. A component that, scaled, does not fit 64 bits is an error; a
    distance or inertia that does not is null. An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = cut(integers(vectors, dim=dim, scale=scale, id_col=id_col, vector_col=vector_col).withColumn("had", F.lit(0)), "vectors")
    centroids = _seeds(rows, k, seed)
    for _ in range(rounds if centroids else 0):
        now = cut(_assigned(rows, centroids, dim), "vectors")
        drop_cut(rows)
        rows, centroids = now, _moved(now, centroids, dim)
    told = cut(_assigned(rows, centroids or [[0] * dim], dim, tell=True), "assigned")
    drop_cut(rows)
    whole = lambda total: int(total) if total is not None and total < 1 << 63 else None
    sums = {r["had"]: (r["s"], r["m"]) for r in told.groupBy("had").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count(F.when(F.col("distance").isNull(), 1)).alias("m")).collect()}  # at most k rows
    inertia = None if any(m for _, m in sums.values()) else whole(sum(s for s, _ in sums.values()))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    each = [(j, None if m else whole(s), inertia, digest[j]) for j, (s, m) in sorted(sums.items())]
    totals = F.broadcast(spark.createDataFrame(each, "had int, cluster_inertia long, inertia long, centroid_sha256 string"))  # k rows
    return told.join(totals, "had").select(F.col("id").alias("vec_id"), F.col("had").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same clusters in SQL: every round compares all vectors with all centroids."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT u, vec_id, x, arg_min(j, d * {k} + j) AS j, min(d) AS d FROM
  (SELECT v.u, v.vec_id, v.x, c.j, list_sum(list_transform(range(1, {dim + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::HUGEINT AS d FROM v, c{r} c) GROUP BY u, vec_id, x)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (SELECT j, i, sum(y) AS s, count(*) AS n FROM (SELECT j, unnest(x) AS y, unnest(range(1, {dim + 1})) AS i FROM a{r}) GROUP BY j, i),
c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM m{r} GROUP BY j) m ON c.j = m.j)""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS u, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dim}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR), x) - 1 AS j, x FROM v QUALIFY j < {k}),{",".join(steps)}
SELECT vec_id, a.j::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.j = c.j
"""
