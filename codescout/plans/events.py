"""Registered queries over the event table: time to live, sessions, windows; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codescout.operators import rollups as ro
from codescout.sources.tables import read_table


def _events(s, d):
    return read_table(s, d, "events")


def ttl_alive(s, d):
    """Events younger than a day at the time of the last event."""
    now = _events(s, d).agg(F.max("ts").alias("now"))
    return ro.alive(_events(s, d).crossJoin(F.broadcast(now)), "ts", F.col("now"), 86_400).select("event_id")


def session_summary(s, d):
    e = _events(s, d)
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_turns"), F.bool_or(F.col("event_type") == "purchase").alias("purchased"), F.max("event_id").alias("last_event"))


def session_windows(s, d):
    """Sessions of each user: events less than half an hour apart."""
    e = _events(s, d).where("user_id is not null and ts is not null").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    w = e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.unix_seconds(F.col("session_window.start")).alias("start_s"), "n")


def hourly_windows(s, d):
    e = _events(s, d).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    w = e.where("ts is not null").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.unix_seconds(F.col("window.start")).alias("start_s"), "event_type", "n")


def props_extract(s, d):
    """The number in each event's JSON properties."""
    return _events(s, d).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k is not null")


QUERIES = {
    "ttl_alive": (ttl_alive, "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY"),
    "session_summary": (session_summary, "SELECT user_id, count(*) AS total_turns, bool_or(event_type = 'purchase') AS purchased, max(event_id) AS last_event FROM events GROUP BY user_id"),
    "session_windows": (session_windows, "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS grp FROM e) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start_s, count(*) AS n FROM g GROUP BY user_id, grp"),
    "hourly_windows": (hourly_windows, "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start_s, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2"),
    "props_extract": (props_extract, "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL"),
}
