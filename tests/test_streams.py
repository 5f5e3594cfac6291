"""Streams over several files that are not in order of time."""

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

DAYS = (9, 1, 0, 5, 20, 2)  # of the files, in the order in which they are read
EVENTS = [(10 * d + i, 1 + i % 2, d * 24 + 7 * i, "error" if i < 4 else "view") for d in DAYS for i in range(5)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("events")
    for d in DAYS:
        some = [e for e in EVENTS if e[0] // 10 == d]
        rows = spark.createDataFrame([*some, some[0]], "event_id long, user_id long, hour int, event_type string")
        ts = F.timestamp_seconds(F.lit(1704067200) + F.col("hour") * 3600)
        rows.select("event_id", ts.alias("ts"), "user_id", "event_type").coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
    return str(path)


def hours(frame, *cols):
    at = (F.unix_seconds(F.col("start" if "start" in frame.columns else "ts")) - 1704067200) / 3600
    return sorted(tuple(r) for r in frame.select(at.cast("int"), *cols).collect())


def test_once_only_keeps_late_ids(spark, folder):
    assert sorted(r[0] for r in entry.queries()["X4"](spark, folder).collect()) == sorted(e[0] for e in EVENTS)


def test_sliding_windows_are_all_there(spark, folder):
    seen = [*EVENTS, *(e for e in EVENTS if e[0] % 10 == 0)]
    want = {}
    for _, _, hour, kind in seen:
        for back in range(7):
            key = (hour // 24 - back) * 24, kind
            want[key] = want.get(key, 0) + 1
    assert hours(entry.queries()["X5"](spark, folder), "event_type", "n") == sorted((*k, n) for k, n in want.items())


def test_alerts_follow_time_and_not_files(spark, folder):
    want = []
    for user, kind in ((u, k) for u in (1, 2) for k in ("error", "view")):
        last = None
        for hour in sorted(e[2] for e in EVENTS if e[1] == user and e[3] == kind):
            if last is None or hour - last >= 24:
                last = hour
                want.append((hour, user, kind))
    assert hours(entry.queries()["X7"](spark, folder), "user_id", "event_type") == sorted(want)
