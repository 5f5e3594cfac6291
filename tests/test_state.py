"""Keyed state of streams: files out of order, restarts from the checkpoint, eviction, late rows."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from attesta.streaming import events as st
from attesta.streaming import state

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "user_id long, event_type string, ts timestamp"


def write(spark, path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def alerts_by_hand(rows, hours):
    out = []
    for key in {(u, k) for u, k, _ in rows}:
        last = None
        for at in sorted({t for u, k, t in rows if (u, k) == key}):
            if last is None or at - last >= timedelta(hours=hours):
                last = at
                out.append((*key, at))
    return sorted(out)


def test_alerts_of_files_out_of_order_and_after_a_restart(spark, tmp_path):
    rng = random.Random(2)
    rows = [(u, k, START + timedelta(minutes=rng.randint(0, 40 * 24 * 60))) for u in (1, 2) for k in ("error", "view") for _ in range(25)]
    order = sorted(rows, key=lambda r: r[2] + timedelta(days=rng.randint(0, 8)))  # up to eight days late
    path, folder = str(tmp_path / "in"), str(tmp_path / "own")
    files = [order[i : i + 20] for i in range(0, len(order), 20)]
    for f in files[:3]:
        write(spark, path, f)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    first = state.run_available(state.cooled_alerts(stream, 24, "10 days"), f"{tmp_path}/plain")
    assert state.dropped_late(first) == 0
    for f in files[3:]:
        write(spark, path, f)
    again = state.run_available(state.cooled_alerts(stream, 24, "10 days"), f"{tmp_path}/plain")
    assert sum(p["numInputRows"] for p in again.recentProgress) == len(order) - 60  # it went on where it had ended
    decided = spark.read.parquet(f"{tmp_path}/plain/out").count()
    got = state.alerts_of(stream, folder, hours=24, delay="10 days")
    assert sorted((r[0], r[1], r[2].replace(tzinfo=timezone.utc) if r[2].tzinfo is None else r[2]) for r in got.collect()) == alerts_by_hand(rows, 24)
    assert 0 < decided < got.count()  # without the heartbeat, the last ten days wait


def test_presence_over_complete_and_broken_runs_with_a_restart(spark, tmp_path):
    rng = random.Random(4)
    complete = [True, True, False, True, False, False, True, True]
    runs = [sorted(rng.sample(range(12), 6)) for _ in complete]
    path, folder = str(tmp_path / "runs"), str(tmp_path / "own")
    clocks = state.run_clock(complete)
    stream = lambda: spark.readStream.schema("user_id long, clock int").option("maxFilesPerTrigger", 1).parquet(path)
    for part in (range(4), range(4, 8)):
        for r in part:
            write(spark, path, [(u, clocks[r]) for u in [*runs[r], runs[r][0]]], "user_id long, clock int")
        changes = state.presence_changes(stream(), "user_id", "long")
        state.run_available(changes, folder)
    want = {}
    for seen, whole in zip(runs, complete):
        for u in set(want) | set(seen):
            active, cycles = want.get(u, (None, 1))
            if u in seen:
                want[u] = (True, cycles + (active is False))
            elif whole:
                want[u] = (False, cycles)
    got = state.presence(spark.read.parquet(f"{folder}/out")).collect()
    assert {r["key"]: (r["active"], r["cycles"]) for r in got} == want


def test_retention_evicts_and_counts_late_rows(spark, tmp_path):
    path, folder = str(tmp_path / "in"), str(tmp_path / "own")
    days = [0, 3, 1, 9, 30, 31, 2, 32]  # day 2 comes after day 31, outside a retention of ten days
    for d in days:
        write(spark, path, [(1, "view", START + timedelta(days=d, hours=h)) for h in range(3)])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    query = state.run_available(state.daily_counts(stream, "10 days"), folder)
    held = {(r["start"].day, r["start"].month): r["n"] for r in state.retained_counts(spark, folder).collect()}
    assert held == {(31, 1): 3, (1, 2): 3, (2, 2): 3}
    assert state.state_rows(query) == 3
    assert state.dropped_late(query) > 0
    evicted = {r["start"].day: r["n"] for r in spark.read.parquet(f"{folder}/out").collect()}
    assert evicted == {1: 3, 4: 3, 2: 3, 10: 3}


@pytest.mark.parametrize("size", [20, 3])
def test_portions_are_bounded_and_whole(spark, tmp_path, size):
    path = str(tmp_path / "in")
    for d in range(3):
        write(spark, path, [(u, "view", START) for u in range(50 * d, 50 * d + 50)])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    done = st.run_portions(stream, size, lambda rows: rows)
    assert sorted(r["user_id"] for r in done.collect()) == list(range(150))
    assert max(r["count"] for r in done.groupBy("portion").count().collect()) <= size
