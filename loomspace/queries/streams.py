"""Streaming jobs as batch twins: the same plan over a static table, so that SQL can state the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tables as t
from ..streaming import jobs
from . import register


@register("stream_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windows(spark, d):
    w = jobs.windowed(t.events(spark, d))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("stream_sessions", "WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM o) SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM s GROUP BY user_id, g")
def sessions(spark, d):
    s = jobs.sessions(t.events(spark, d))
    return s.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")


@register("stream_ingest", "SELECT event_id, count(*) AS n FROM (SELECT DISTINCT event_id FROM events) GROUP BY event_id")
def ingest(spark, d):
    ev = t.events(spark, d)
    return ev.union(ev).dropDuplicates(["event_id"]).groupBy("event_id").agg(F.count("*").alias("n"))
