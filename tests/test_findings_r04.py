"""What a review of round 4 found: each test failed before its finding was mended."""

import os
from datetime import date, timedelta
from functools import partial

import numpy as np
import pytest

import __spark_entry__ as entry
from attesta.operators import shingle_sets, similar

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def sets_of(texts):
    return [frozenset(tuple(w[i : i + 4]) for w in [t.split()] for i in range(max(1, len(w) - 3))) for t in texts]


def near_copies(seed, n):
    rng = np.random.default_rng(seed)
    base = [[f"w{int(x)}" for x in rng.integers(0, 60, int(rng.integers(3, 40)))] for _ in range(8)]
    out = []
    for _ in range(n):
        w = [x for i in rng.choice(8, int(rng.integers(1, 4)), replace=False) for x in base[i]]
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(len(w)))] = f"new{int(rng.integers(9))}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("most,batch", [(1_000_000, 10_000), (7, 2)])
def test_weeks_of_alike_texts_in_split_cells_and_small_batches(spark, monkeypatch, most, batch):
    monkeypatch.setattr(similar, "_alike_sets", partial(similar._alike_sets, most=most))
    spark.conf.set(BATCH, batch)
    try:
        texts = near_copies(1, 90)
        data = [(i, "ab"[i % 5 == 0], t, date(2023, 6, 1) + timedelta(days=i * 7 % 30)) for i, t in enumerate(texts)]
        got = sorted(map(tuple, similar.anchored_groups(spark.createDataFrame(data, "k long, g string, t string, d date"), "k", "g", "t", "d").collect()))
    finally:
        spark.conf.unset(BATCH)
    s = sets_of(texts)
    like = lambda i, j: data[i][1] == data[j][1] and 0 <= (data[j][3] - data[i][3]).days < 7 and round(len(s[i] & s[j]) / min(len(s[i]), len(s[j])), 4) >= 0.6
    assert got == [(i, sum(like(i, j) for j in range(90))) for i in range(90)] and max(n for _, n in got) > 3


def test_no_whole_sets_are_written_and_steps_are_removed(spark, monkeypatch):
    kept, keep = [], similar.written
    monkeypatch.setattr(similar, "written", lambda rows: kept.append((rows.count(), keep(rows))) or kept[-1][1])
    data = [(i, "x", " ".join(f"w{i}_{j}" for j in range(50)), date(2023, 6, 1)) for i in range(30)]
    got = similar.anchored_groups(spark.createDataFrame(data, "k long, g string, t string, d date"), "k", "g", "t", "d")
    assert sorted(map(tuple, got.collect())) == [(i, 1) for i in range(30)]
    assert max(n for n, _ in kept) == 30 and "array<bigint>" not in {t for _, f in kept for _, t in f.dtypes}  # not one of 47 shingles each
    left = [os.path.exists(f._written_to.removeprefix("file:")) for _, f in kept]
    assert left[0] is False and sum(left) < len(left) / 2


def test_packed_hashes_come_back(spark):
    rng = np.random.default_rng(3)
    for n, top in ((1, 1), (2, 2), (5000, 2**64 - 1)):
        g, at = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True)), rng.integers(0, 400, n)
        names = rng.integers(-(2**63), 2**63 - 1, 400)
        h, place, own = shingle_sets._unpacked(shingle_sets._body(g, at, names))
        assert (h == g).all() and (own[place] == names[at]).all() and len(own) == len(set(at.tolist()))
    edges = shingle_sets._edges(7)
    assert len(edges) == 7 and edges[0] == 0 and (np.diff(edges.astype(object)) > 2**61).all()


@pytest.mark.parametrize("most,batch", [(1_000_000, 10_000), (7, 2)])
def test_contained_texts_in_split_cells_and_small_batches(spark, monkeypatch, most, batch):
    monkeypatch.setattr(similar, "_alike_sets", partial(similar._alike_sets, most=most))
    spark.conf.set(BATCH, batch)
    try:
        texts = near_copies(2, 100)
        texts += texts[:9] + [" ".join(t.split()[:5]) for t in texts[9:30]] + ["", "one two"]
        got = sorted(map(tuple, similar.containment_pairs(spark.createDataFrame([(i, "g", t) for i, t in enumerate(texts)], "k long, g string, t string"), "k", "g", "t").collect()))
    finally:
        spark.conf.unset(BATCH)
    s, first = sets_of(texts), {}
    s = {i: x for i, x in enumerate(s) if texts[i]}
    for i, x in s.items():
        first.setdefault(x, i)
    want = [(first[x], i, 1.0) for i, x in s.items() if first[x] != i]
    own = sorted(first.values())
    like = [(a, b, int(len(s[a] & s[b]) / min(len(s[a]), len(s[b])) * 10_000 + 0.5) / 10_000) for a in own for b in own if a < b]
    assert got == sorted(want + [x for x in like if x[2] >= 0.6]) and len(got) > 100


def test_texts_are_split_in_one_step_and_pairs_carry_no_sets(spark, monkeypatch):
    plans, keep = [], similar.written
    monkeypatch.setattr(similar, "written", lambda rows: plans.append(rows._jdf.queryExecution().toString()) or keep(rows))
    entry.queries()["J18"](spark, "/root/testdata/sf0.001")
    physical = [p.split("== Physical Plan ==")[1] for p in plans]
    assert sum(p.count("regexp_extract_all") for p in physical) == 1 and not any("array_intersect" in p for p in plans)


def test_the_cube_has_four_nested_key_sets(spark):
    rows = entry.queries()["A23"](spark, "/root/testdata/sf0.001").collect()
    kept = {level: {tuple(c for c in ("role", "grade", "geo", "format") if r[c] is not None) for r in rows if r["level"] == level} for level in {r["level"] for r in rows}}
    assert kept == {1: {("role", "grade", "geo", "format")}, 2: {("role", "grade", "geo")}, 3: {("role", "grade")}, 4: {("role",)}}
    assert len({r["format"] for r in rows if r["level"] == 1}) == 2 and len({sum(r["n"] for r in rows if r["level"] == level) for level in kept}) == 1
