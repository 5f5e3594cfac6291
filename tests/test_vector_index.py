"""The inverted file against all pairs and all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.operators import similar
from attesta.operators import vector_index as vi


def clustered(n, dim, spread, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    return centres[rng.integers(0, 9, n)] + spread * rng.normal(size=(n, dim))


def frame(spark, x, more=()):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + list(more), "id long, v array<double>")


@pytest.mark.parametrize("spread,least", [(0.2, 0.9), (1.0, 0.5), (3.0, 0.3)])
def test_near_pairs_lose_nothing(spark, spread, least):
    x = clustered(300, 12, spread)
    x[7] = x[3]
    odd = [(900, None), (901, [None] + [1.0] * 11), (902, [1.0]), (903, [0.0] * 12), (904, [float("nan")] * 12)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    want = {(a, b): round(float(c[a, b]), 4) for a in range(300) for b in range(a + 1, 300) if c[a, b] >= least}
    got = vi.near_pairs(frame(spark, x, odd), "id", "v", least, cells=11, block=50).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == set(want)
    assert all(abs(r["cosine"] - want[r["a"], r["b"]]) < 2e-4 for r in got)


def test_far_cells_are_not_visited(spark):
    x = clustered(400, 12, 0.05)
    index = vi.build(frame(spark, x), "id", "v", cells=9)
    reach = index.radii + np.arccos(0.9)
    met = (vi._angles(x / np.linalg.norm(x, axis=1, keepdims=True), index.centroids) <= reach).mean()
    assert met < 0.5


@pytest.mark.parametrize("spread", [0.3, 5.0])
def test_search_reaches_its_recall(spark, spread):
    x = clustered(1500, 16, spread, 4)
    rows = frame(spark, x)
    asked = rows.filter("id % 50 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    exact = {(r["q"], r["id"]): r["cosine"] for r in similar.most_similar(rows, "id", "v", asked, 10).collect()}
    index = vi.build(rows, "id", "v")
    found = {(r["q"], r["id"]): r["cosine"] for r in vi.search(index, asked, 10, shard_rows=40, block=7).collect()}
    assert len(exact) == 300 and len(found) <= 300
    assert len(exact.keys() & found.keys()) >= 0.9 * len(exact)
    assert all(abs(found[k] - exact[k]) < 1e-5 for k in exact.keys() & found.keys())
    if spread < 1:
        assert vi.probes_for(index, 10, 0.95) < len(index.centroids) / 2


def test_empty_and_few(spark):
    none = frame(spark, np.zeros((0, 3)))
    assert vi.near_pairs(none, "id", "v", 0.5).collect() == []
    one = frame(spark, np.ones((1, 3)))
    asked = one.select(F.col("id").alias("q"), F.col("v").alias("qv"))
    assert vi.search(vi.build(one, "id", "v"), asked, 3).collect() == []
