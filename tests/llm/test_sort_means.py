"""Sort-means against plain k-means in Python's integers."""

import hashlib
import math
import random

import numpy as np

from attesta.llm import sort_means as sm

DIM = 64


def by_hand(rows, k=8, rounds=10):
    kept = []
    for ident, v in rows:
        if v is not None and len(v) == DIM and all(c is not None and math.isfinite(c) for c in v):
            kept.append((ident, [math.floor(1024 * float(np.float32(c))) for c in v]))
    name = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [x for _, x in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda x: min(range(len(centroids)), key=lambda j: (far(x, centroids[j]), j))
    for _ in range(rounds):
        own = [near(x) for _, x in kept]
        for j in range(len(centroids)):
            mine = [x for (_, x), o in zip(kept, own) if o == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    own = [near(x) for _, x in kept]
    d = [far(x, centroids[o]) for (_, x), o in zip(kept, own)]
    sums = {j: sum(a for a, o in zip(d, own) if o == j) for j in own}
    return sorted([(i, o, a, sums[o], sum(d), hashlib.sha256(",".join(map(str, centroids[o])).encode()).hexdigest()) for (i, _), o, a in zip(kept, own, d)], key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, had int, id string")


def vectors(n, seed, spread=0.05):
    rng = random.Random(seed)
    centres = [[rng.uniform(-0.6, 0.6) for _ in range(DIM)] for _ in range(12)]
    return [(i, [float(np.float32(c + rng.gauss(0, spread))) for c in rng.choice(centres)]) for i in range(n)]


def test_against_plain_k_means(spark):
    for spread in (0.02, 0.4):
        rows = vectors(300, 5, spread)
        assert sorted(map(tuple, sm.sort_means(frame(spark, rows)).collect()), key=repr) == by_hand(rows)


def test_broken_vectors_ties_and_repeated_rows(spark):
    base = vectors(12, 9)
    one = base[0][1]
    rows = base + [(50, one), (51, one), (51, one), (None, one), (60, None), (61, one[:-1]), (62, [*one[:-1], None]), (63, [*one[:-1], float("nan")]), (64, [*one[:-1], float("inf")]), (65, [0.0] * DIM), (66, [-0.0] * DIM), (67, [-1e-9] * DIM)]
    assert sorted(map(tuple, sm.sort_means(frame(spark, rows)).collect()), key=repr) == by_hand(rows)


def test_few_vectors_and_none(spark):
    rows = vectors(3, 2)
    assert sorted(map(tuple, sm.sort_means(frame(spark, rows)).collect()), key=repr) == by_hand(rows)
    assert sm.sort_means(frame(spark, [(1, None)])).collect() == []


def test_large_components_are_exact(spark):
    rows = [(i, [float(2**20 * ((i * j) % 5 - 2)) for j in range(DIM)]) for i in range(20)] + [(30, [2.0**50] + [0.0] * (DIM - 1))]
    got = {r["vec_id"]: r for r in sm.sort_means(frame(spark, rows), rounds=2).collect()}
    want = {r[0]: r for r in by_hand(rows, rounds=2)}
    for i, w in want.items():
        assert (got[i]["cluster"], got[i]["centroid_sha256"]) == (w[1], w[5])
        assert got[i]["distance"] == (w[2] if w[2] < 1 << 63 else None)


def test_scan_stops_strictly_beyond(spark):
    """A centroid at exactly twice the distance ties with the one that the vector has, and a smaller number wins."""
    x = np.array([[2, 0]], np.int64)
    assert [int(a[0]) for a in sm.nearest(x, [[4, 0], [0, 0]], np.array([1]))] == [0, 4]
    assert [int(a[0]) for a in sm.nearest(x, [[0, 0], [4, 0]], np.array([1]))] == [0, 4]
    rng = np.random.default_rng(1)
    x, c = rng.integers(-9, 9, (500, 3)), rng.integers(-9, 9, (8, 3))
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    for had in (np.zeros(500, np.int32), rng.integers(0, 8, 500)):
        got, far = sm.nearest(x, c.tolist(), had)
        assert (got == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()
