"""Streams with keyed state: what is seen and missing per key, alerts with a cooldown, and counts that are retained for a time.

Each takes the folder that holds its checkpoint and its output, so that a second run with the same folder goes on where
the first one ended. State is in RocksDB, and every value leaves it: by a timer, by its key's next event, or by the
watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUN_STEP = 1000  # seconds of the runs' clock between two complete runs


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Within, streams keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def run_available(rows: DataFrame, folder: str) -> StreamingQuery:
    """Append what the stream has now to folder/out; state and progress are in folder/state."""
    with rocks(rows.sparkSession):
        query = rows.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return query


def millis(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[ms]").astype("int64")


# Seen and missing ----------------------------------------------------------------------------------------------------


def run_clock(complete: list[bool]) -> list[int]:
    """The moment, in seconds, of each run: complete ones are RUN_STEP apart, incomplete ones lie between them.

    So only a complete run moves the clock to where keys that it lacks are missing. Up to RUN_STEP - 1 incomplete runs
    may follow each other.
    """
    out, k, j = [], 0, 0
    for whole in complete:
        k, j = (k + 1, 0) if whole else (k, j + 1)
        out.append(RUN_STEP * k + j)
    return out


class Presence(StatefulProcessor):
    """Per key: whether it is there, how often it came back, and the moment when it was last seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("presence", "active boolean, cycles long, seen long")

    def _row(self, key: tuple, at: int, active: bool, cycles: int) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "at": [at], "active": [active], "cycles": [cycles]})

    def handleInputRows(self, key, rows, timerValues):
        at = max(int(frame["clock"].max()) for frame in rows)
        active, cycles, seen = self.state.get() if self.state.exists() else (None, 1, None)
        if seen is not None:
            missing = self._missing_at(seen)
            self.handle.deleteTimer(missing)
            if active and at * 1000 > missing:  # it comes back in the batch in which its timer would have fired
                active = False
                yield self._row(key, missing // 1000, False, cycles)
        again = active is False
        self.state.update((True, cycles + again, at))
        self.handle.registerTimer(self._missing_at(at))
        if not active:
            yield self._row(key, at, True, cycles + again)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        _, cycles, seen = self.state.get()
        self.state.update((False, cycles, seen))
        yield self._row(key, self._missing_at(seen) // 1000, False, cycles)

    @staticmethod
    def _missing_at(seen: int) -> int:
        """When the next complete run has come, in milliseconds."""
        return (seen // RUN_STEP + 1) * RUN_STEP * 1000

    def close(self) -> None:
        pass


def presence_changes(runs: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, at, active, cycles): each time that a key appears, goes missing or comes back.

    runs: a stream of (key, clock), one run a batch, clock from run_clock. Rows without key are left out. A key is
    missing only once a complete run lacks it; the runs' clock is the watermark that lets its timer fire.
    """
    rows = runs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col("clock").cast("long").alias("clock"), F.timestamp_seconds("clock").alias("moment")).withWatermark("moment", "0 seconds")
    return rows.groupBy("key").transformWithStateInPandas(Presence(), f"key {kind}, at long, active boolean, cycles long", "Append", "EventTime")


def presence(changes: DataFrame) -> DataFrame:
    """(key, active, cycles): the last change of each key."""
    last = F.max_by(F.struct("active", "cycles"), F.struct("at", "cycles", ~F.col("active")))
    return changes.groupBy("key").agg(last.alias("l")).select("key", "l.active", "l.cycles")


# Alerts --------------------------------------------------------------------------------------------------------------


class Cooldown(StatefulProcessor):
    """Per key: events that the watermark has not passed, and the last one let through while it still matters."""

    def __init__(self, hours: int):
        self.gap = hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, micros long")
        self.last = handle.getValueState("last", "at long, micros long")

    def handleInputRows(self, key, rows, timerValues):
        seen = {m for frame in rows for m in frame["micros"].tolist()}
        self.waiting.appendList([(micros // 1000, micros) for micros in seen])
        self.handle.registerTimer(min(seen) // 1000 + 1)  # later ones are registered when it fires, if they still wait
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """All that the watermark has passed is decided in order of time; what still waits has one timer, that of its first."""
        passed = timerValues.getCurrentWatermarkInMs()
        held = [(int(a), int(m)) for a, m in self.waiting.get()] if self.waiting.exists() else []
        ripe = sorted({m for a, m in held if a < passed})
        last = int(self.last.get()[1]) if self.last.exists() else None
        through = []
        for micros in ripe:
            if last is None or micros - last >= self.gap * 1000:
                last = micros
                through.append(micros)
        if ripe:
            left = [(a, m) for a, m in held if a >= passed]
            if left:
                self.waiting.put(left)
                self.handle.registerTimer(min(a for a, _ in left) + 1)
            else:
                self.waiting.clear()
        if through:
            self.last.update((last // 1000, last))
            self.handle.registerTimer(last // 1000 + self.gap + 2)
            yield pd.DataFrame({"user_id": [key[0]] * len(through), "event_type": [key[1]] * len(through), "micros": through})
        elif last is not None and last // 1000 + self.gap < passed and not self.waiting.exists():
            self.last.clear()  # whatever comes is later than the watermark, and so let through

    def close(self) -> None:
        pass


def cooled_alerts(events: DataFrame, hours: int, delay: str) -> DataFrame:
    """(user_id, event_type, micros) of the events of each user and kind that come `hours` or more after the last let through.

    events: a stream of (user_id, event_type, ts). An event is decided once the watermark, `delay` behind the latest, has
    passed it, so files may come in any order within the delay; later ones are dropped, and counted in the progress.
    Rows without ts, user or kind are left out.
    """
    rows = events.dropna(subset=["ts", "user_id", "event_type"]).select("user_id", "event_type", F.unix_micros("ts").alias("micros"), "ts").withWatermark("ts", delay)
    return rows.groupBy("user_id", "event_type").transformWithStateInPandas(Cooldown(hours), "user_id long, event_type string, micros long", "Append", "EventTime")


def closed(events: DataFrame, beats: str) -> DataFrame:
    """events with the rows of the folder `beats`, whose keys no event has: they only move the watermark."""
    spark = events.sparkSession
    beat = spark.readStream.schema(events.schema).parquet(beats)
    return events.unionByName(beat)


def beat(spark: SparkSession, beats: str, schema, ts, user_id: int = -1, kind: str = "") -> None:
    """Write a heartbeat at ts to the folder."""
    own = {"user_id": user_id, "event_type": kind, "ts": ts}
    spark.createDataFrame([tuple(own.get(f.name) for f in schema)], schema).coalesce(1).write.mode("append").parquet(beats)


def alerts_of(events: DataFrame, folder: str, *, hours: int = 24, delay: str = "30 days", until=None) -> DataFrame:
    """The alerts of what the stream has now, once more after a heartbeat at `until`, which lets the last ones be decided.

    until: a moment more than the delay after the last event; by default the end of the century.
    """
    from datetime import datetime

    spark, beats = events.sparkSession, f"{folder}/beats"
    spark.createDataFrame([], events.schema).coalesce(1).write.mode("append").parquet(beats)
    rows = cooled_alerts(closed(events, beats), hours, delay)
    run_available(rows, folder)
    beat(spark, beats, events.schema, until or datetime(2100, 1, 1))
    run_available(rows, folder)
    told = spark.read.schema(rows.schema).parquet(f"{folder}/out").filter("user_id <> -1")
    return told.select("user_id", "event_type", F.timestamp_micros("micros").alias("ts"))


# Retention -----------------------------------------------------------------------------------------------------------


def daily_counts(events: DataFrame, retention: str) -> DataFrame:
    """A stream of (start, event_type, n) of the days that have left the retention, which are then forgotten."""
    days = events.filter("ts is not null").withWatermark("ts", retention).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return days.select(F.col("window.start").alias("start"), "event_type", "n")


def retained_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(start, event_type, n) of the days that the state of daily_counts still holds."""
    held = spark.read.format("statestore").load(f"{folder}/state")
    return held.select(F.col("key.window.start").alias("start"), F.col("key.event_type").alias("event_type"), F.col("value.count").alias("n"))


def dropped_late(query: StreamingQuery) -> int:
    """Rows that came after the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def state_rows(query: StreamingQuery) -> int:
    """Rows of state after the last batch."""
    return sum(op["numRowsTotal"] for op in query.recentProgress[-1]["stateOperators"])
