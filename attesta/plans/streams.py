"""Queries of streaming operators: ids X of the operator inventory. Each runs over all that its source has now."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.plans.registry import query
from attesta.streaming import events as st
from attesta.streaming import state


def _events(spark, sf_dir):
    return st.source(spark, f"{sf_dir}/events.parquet")


@query("X1", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def available_now(spark, sf_dir):
    return st.run_once(_events(spark, sf_dir).select("event_id", "event_type")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("X3", "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY 1")
def first_last(spark, sf_dir):
    return st.run_merged(_events(spark, sf_dir), st.first_last)


@query("X4", "SELECT event_id FROM events")
def once_only(spark, sf_dir):
    return st.run_once(_events(spark, sf_dir).select("event_id").dropDuplicates(["event_id"]))


@query("X5", "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, date_trunc('day', ts) - to_days(unnest(range(7))::INT) AS start FROM events) GROUP BY ALL")
def sliding(spark, sf_dir):
    return st.run_merged(_events(spark, sf_dir), st.sliding_counts)


@query("X6", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY > (SELECT max(ts) FROM events) - INTERVAL 20 DAY GROUP BY ALL")
def retained(spark, sf_dir):
    """Counts by day that the state holds after all events: of the last 20 days, as the events span 30; older days are evicted."""
    folder = st.shared(spark)
    state.run_available(state.daily_counts(_events(spark, sf_dir), "20 days"), folder)
    return state.retained_counts(spark, folder)


@query("X7", """
WITH RECURSIVE r AS (SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY ALL UNION ALL SELECT e.user_id, e.event_type, min(e.ts) FROM r JOIN events e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.ts >= r.ts + INTERVAL 24 HOUR GROUP BY e.user_id, e.event_type, r.ts)
SELECT user_id, event_type, ts FROM r""")
def cooled(spark, sf_dir):
    """Of each user's events of each kind, those that come a day or more after the last one let through."""
    return state.alerts_of(_events(spark, sf_dir).select("user_id", "ts", "event_type"), st.shared(spark), hours=24, delay="30 days")
