"""Time: decays, periodic and sequence scores, windows, as-of joins, encodings."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import temporal as tf
from ..functions import vectors as v
from ..operators import fusion, retrieval
from ..operators import temporal as ops
from ..sources import tables as t
from . import register
from .search import PAIRS, SIM, TOP, shown
from .vectors import asked

EV = "WITH a AS (SELECT max(ts) AS as_of, count(*) AS n FROM events), g AS (SELECT event_id, user_id, event_type, value, ts, greatest(0, epoch(date_trunc('second', as_of))::BIGINT - epoch(date_trunc('second', ts))::BIGINT)::DOUBLE AS age, n FROM events, a)"


def aged(spark, d):
    ev = t.events(spark, d)
    a = ev.agg(F.max("ts").alias("as_of"), F.count("*").alias("n"))  # one row
    return ev.crossJoin(F.broadcast(a)).withColumn("age", tf.age(F.col("as_of"), F.col("ts")))


@register("recency_decays", EV + f""" SELECT event_id, round(1 - least(age / 604800, 1), 6) AS linear, round(exp(-age * {math.log(2)!r} / 43200), 6) AS exponential,
 CASE WHEN age < 300 THEN 1.0 WHEN age < 3600 THEN 0.8 WHEN age < 86400 THEN 0.5 WHEN age < 604800 THEN 0.3 ELSE 0.1 END::DOUBLE AS stepped, round(exp(-age * 0.693::DOUBLE / 151200), 6) AS tool,
 round(exp(-age * {math.log(2)!r} / (43200 * (1 + 0.1::DOUBLE * log10(n / 1000)))), 6) AS adaptive FROM g""")  # fmt: skip
def decays(spark, d):
    a = F.col("age")
    parts = {"linear": tf.linear(a, tf.HORIZON["macro"]), "exponential": tf.exponential(a, tf.HALF_LIFE["macro"]), "stepped": tf.stepped(a), "tool": tf.tool_recency(a, tf.HORIZON["macro"]), "adaptive": tf.exponential(a, tf.adaptive_half_life(tf.HALF_LIFE["macro"], F.col("n")))}
    return aged(spark, d).select("event_id", *(F.round(c, 6).alias(n) for n, c in parts.items()))


@register("periodic_scores", "SELECT event_id, hour(ts)::BIGINT AS hour, dayofweek(ts)::BIGINT AS weekday, round(((1 - least(abs(hour(ts) - 9), 24 - abs(hour(ts) - 9)) / 12.0::DOUBLE) + (1 - least(abs(dayofweek(ts) - 2), 7 - abs(dayofweek(ts) - 2)) / 3.5::DOUBLE)) / 2, 6) AS score FROM events")
def periodic(spark, d):
    ts = F.col("ts")
    return t.events(spark, d).select("event_id", F.hour(ts).cast("long").alias("hour"), tf.day_of_week(ts).cast("long").alias("weekday"), F.round(tf.periodic(ts, 9, 2), 6).alias("score"))


@register("injection_factors", EV + " SELECT event_id, CASE WHEN age < 3600 THEN 1.3 WHEN age < 86400 THEN 1.2 WHEN age < 604800 THEN 1.1 WHEN age < 2592000 THEN 1.0 ELSE 0.8 END::DOUBLE AS factor, CASE WHEN age < 60 THEN age::BIGINT || ' second' || CASE WHEN age::BIGINT = 1 THEN '' ELSE 's' END || ' ago' WHEN age < 3600 THEN floor(age / 60)::BIGINT || ' minute' || CASE WHEN floor(age / 60)::BIGINT = 1 THEN '' ELSE 's' END || ' ago' WHEN age < 86400 THEN floor(age / 3600)::BIGINT || ' hour' || CASE WHEN floor(age / 3600)::BIGINT = 1 THEN '' ELSE 's' END || ' ago' WHEN age < 604800 THEN floor(age / 86400)::BIGINT || ' day' || CASE WHEN floor(age / 86400)::BIGINT = 1 THEN '' ELSE 's' END || ' ago' ELSE floor(age / 604800)::BIGINT || ' week' || CASE WHEN floor(age / 604800)::BIGINT = 1 THEN '' ELSE 's' END || ' ago' END AS spoken, dayname(ts) AS day FROM g")
def injection(spark, d):
    return aged(spark, d).select("event_id", tf.injection_factor(F.col("age")).alias("factor"), tf.spoken_age(F.col("age")).alias("spoken"), F.date_format("ts", "EEEE").alias("day"))


MEM = PAIRS + f", tm AS (SELECT event_id AS memory_id, ts FROM events), ao AS (SELECT max(ts) AS as_of FROM events), z AS (SELECT query_id, memory_id, {SIM['E1']} AS sim, ts, greatest(0, epoch(date_trunc('second', as_of))::BIGINT - epoch(date_trunc('second', ts))::BIGINT)::DOUBLE AS age FROM w JOIN tm USING (memory_id), ao)"


def timed(spark, d):
    """Memories with the time and age of their event."""
    ev = aged(spark, d).select(F.col("event_id").alias("memory_id"), "ts", "age")
    return t.vectors(spark, d).select("memory_id", "E1").join(ev, "memory_id")


def best_timed(spark, d, m, score):
    """The best ten by a score of E1 and of a memory's own column ``x``, which is taken before memories meet queries."""
    return shown(retrieval.best(asked(spark, d), m.select("memory_id", "E1", "x"), ("E1",), lambda s, q, m: score(s["E1"], m["x"].to_numpy("float64")[None]), 10))


@register("search_recent", MEM + ", x AS (SELECT query_id, memory_id, sim * greatest(0.8, least(1.2, 1 + 0.3 * (exp(-age * 0.693::DOUBLE / 151200) - 0.5))) AS score FROM z)" + TOP.format("x", 10))
def recent(spark, d):
    m = timed(spark, d).withColumn("x", tf.boosted(F.lit(1.0), tf.tool_recency(F.col("age"), tf.HORIZON["macro"]), 0.3))
    return best_timed(spark, d, m, np.multiply)


@register("search_periodic", MEM + ", x AS (SELECT query_id, memory_id, sim * greatest(0.8, least(1.2, 1 + 0.3 * ((1 - least(abs(hour(ts) - 9), 24 - abs(hour(ts) - 9)) / 12.0::DOUBLE) - 0.5))) AS score FROM z)" + TOP.format("x", 10))
def search_periodic(spark, d):
    m = timed(spark, d).withColumn("x", tf.boosted(F.lit(1.0), tf.periodic(F.col("ts"), 9), 0.3))
    return best_timed(spark, d, m, np.multiply)


@register("temporal_blend", MEM + f", x AS (SELECT query_id, memory_id, sim * 0.7::DOUBLE + 0.3::DOUBLE * ({0.5 / 0.65!r} * exp(-age * {math.log(2)!r} / 43200) + {0.15 / 0.65!r} * ((1 - least(abs(hour(ts) - 9), 24 - abs(hour(ts) - 9)) / 12.0::DOUBLE))) AS score FROM z)" + TOP.format("x", 10))
def blend(spark, d):
    m = timed(spark, d).withColumn("x", tf.blended(F.lit(0.0), 0.3, recency=tf.exponential(F.col("age"), tf.HALF_LIFE["macro"]), periodic=tf.periodic(F.col("ts"), 9)))
    return best_timed(spark, d, m, lambda s, x: 0.7 * s + x)


@register("search_time_window", MEM + ", x AS (SELECT query_id, memory_id, sim AS score FROM z WHERE age BETWEEN 0 AND 86400)" + TOP.format("x", 10))
def window(spark, d):
    m = timed(spark, d).filter(F.col("age").between(0, 86400)).withColumn("x", F.lit(1.0))
    return best_timed(spark, d, m, np.multiply)


@register("asof_previous_event", "WITH r AS (SELECT event_id, user_id, ts - INTERVAL 1 HOUR AS at FROM events WHERE event_type = 'error'), s AS (SELECT user_id, ts AS snapshot_ts, event_id AS snapshot_id FROM events WHERE event_type = 'view') SELECT r.event_id, r.user_id, s.snapshot_id, s.snapshot_ts FROM r ASOF LEFT JOIN s ON r.user_id = s.user_id AND r.at >= s.snapshot_ts")
def asof(spark, d):
    """Each error with its user's latest view at least an hour before."""
    ev = t.events(spark, d)
    rows = ev.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    snaps = ev.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("snapshot_id"))
    return ops.as_of_previous(rows, snaps, 3600, "user_id").select("event_id", "user_id", "snapshot_id", F.col("snapshot_ts").cast("timestamp_ntz").alias("snapshot_ts"))


@register("temporal_pairs", "SELECT a.event_id AS a, b.event_id AS b, epoch(date_trunc('second', b.ts))::BIGINT - epoch(date_trunc('second', a.ts))::BIGINT AS gap_s FROM events a JOIN events b ON a.user_id = b.user_id AND epoch(date_trunc('second', b.ts))::BIGINT - epoch(date_trunc('second', a.ts))::BIGINT BETWEEN 10 AND 86400")
def interval_join(spark, d):
    """Events of one user between 10 seconds and a day apart; day buckets make the interval join an equi-join."""
    ev = t.events(spark, d).select("event_id", "user_id", F.unix_seconds("ts").alias("s"))
    a = ev.select(F.col("event_id").alias("a"), "user_id", F.col("s").alias("sa"), F.explode(F.array(F.floor(F.col("s") / 86400), F.floor(F.col("s") / 86400) + 1)).alias("day"))
    b = ev.select(F.col("event_id").alias("b"), "user_id", F.col("s").alias("sb"), F.floor(F.col("s") / 86400).alias("day"))
    gap = F.col("sb") - F.col("sa")
    return a.join(b, ["user_id", "day"]).filter(gap.between(10, 86400)).select("a", "b", gap.alias("gap_s"))


@register("temporal_encodings", """WITH x AS (SELECT event_id, epoch(date_trunc('second', ts)) AS s FROM events) SELECT event_id, round(sin(s) / 16, 6) AS recency_0, round(cos(s / pow(86400::DOUBLE, 20 / 512.0::DOUBLE)) / 16, 6) AS recency_21, round(sin(2 * pi() * s / 3600) / sqrt(255::DOUBLE), 6) AS periodic_0, 1.0::DOUBLE AS recency_norm, 1.0::DOUBLE AS periodic_norm FROM x""")
def encodings(spark, d):
    e = t.events(spark, d).select("event_id", tf.recency_encoding(F.col("ts")).alias("r"), tf.periodic_encoding(F.col("ts")).alias("p"))
    return e.select("event_id", F.round(F.col("r")[0], 6).alias("recency_0"), F.round(F.col("r")[21], 6).alias("recency_21"), F.round(F.col("p")[0], 6).alias("periodic_0"), F.round(v.norm(F.col("r")), 6).alias("recency_norm"), F.round(v.norm(F.col("p")), 6).alias("periodic_norm"))


@register("tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark, d):
    return t.events(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@register("sliding_windows", "SELECT b - i * INTERVAL 30 MINUTE AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS b FROM events), range(4) r(i) GROUP BY ALL")
def sliding(spark, d):
    return t.events(spark, d).groupBy(F.window("ts", "2 hours", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
