"""Sessions: timelines, context, chains, state comparison, lifecycle."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import temporal as tf
from ..operators import fusion
from ..operators import temporal as ops
from ..sources import tables as t
from . import register

T = "WITH t AS (SELECT conv_id AS session_id, turn AS seq, role, text AS content FROM conversations)"
_LABEL = "CASE WHEN d = 0 THEN 'current turn' WHEN d = 1 THEN 'previous turn' WHEN d = -1 THEN 'next turn' WHEN d > 0 THEN d || ' turns ago' ELSE (-d) || ' turns ahead' END"


@register("session_timeline", T + f", n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq, role) AS n, max(seq) OVER (PARTITION BY session_id) - seq AS d FROM t) SELECT session_id, seq, role, {_LABEL} AS label FROM n WHERE n BETWEEN 2 AND 6")
def timeline(spark, d):
    return ops.timeline(t.turns(spark, d), 5, 1).select("session_id", "seq", "role", "label")


@register("conversation_context", T + ", a AS (SELECT session_id, max(seq) AS anchor_seq FROM t GROUP BY session_id) SELECT session_id, anchor_seq, seq, role, length(content) AS chars FROM t JOIN a USING (session_id) WHERE seq >= anchor_seq - 3 AND seq < anchor_seq")
def context(spark, d):
    turns = t.turns(spark, d)
    anchors = turns.groupBy("session_id").agg(F.max("seq").alias("anchor_seq"))
    return ops.context(turns, anchors, 3).select("session_id", "anchor_seq", "seq", "role", F.length("content").cast("long").alias("chars"))


@register("memory_chain", T + ", a AS (SELECT session_id, min(seq) AS anchor FROM t GROUP BY session_id), x AS (SELECT session_id, seq, seq - anchor AS dist FROM t JOIN a USING (session_id) WHERE seq > anchor AND seq <= anchor + 5) SELECT session_id, seq, round(exp(-3 * dist / 5.0::DOUBLE), 6) AS exponential, round(1 - least(dist, 5) / 5.0::DOUBLE, 6) AS linear FROM x")
def chain(spark, d):
    """Up to five hops forward from each session's first turn, weighed by sequence distance."""
    w = W.partitionBy("session_id")
    x = t.turns(spark, d).withColumn("dist", F.col("seq") - F.min("seq").over(w)).filter(F.col("dist").between(1, 5))
    return x.select("session_id", "seq", F.round(tf.proximity_exp(F.col("dist"), 5), 6).alias("exponential"), F.round(tf.proximity_linear(F.col("dist"), 5), 6).alias("linear"))


@register("compare_session_states", T + " SELECT session_id, count(*) FILTER (WHERE seq <= 1) AS n_before, count(*) FILTER (WHERE seq > 1 AND seq <= 4) AS n_added, count(DISTINCT CASE WHEN seq > 1 AND seq <= 4 THEN role END) AS roles_added FROM t GROUP BY session_id")
def compare(spark, d):
    return ops.compare_states(t.turns(spark, d), 1, 4)


@register("session_search", T + ", x AS (SELECT session_id, seq, role, length(content) AS score, seq AS memory_id FROM t WHERE role = 'user'), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, memory_id) - 1 AS rank FROM x) SELECT session_id, seq, rank FROM r WHERE rank < 2")
def session_search(spark, d):
    x = t.turns(spark, d).filter("role = 'user'").select("session_id", F.col("seq").alias("memory_id"), F.length("content").alias("score"))
    return fusion.top(x, 2, ("session_id",)).select("session_id", F.col("memory_id").alias("seq"), F.col("rank").cast("long").alias("rank"))


@register("session_lifecycle", "WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM o), m AS (SELECT max(ts) AS as_of FROM events) SELECT user_id, session, count(*) AS n, min(ts) AS started, CASE WHEN max(ts) >= any_value(as_of) - INTERVAL 30 MINUTE THEN 'active' WHEN max_by(event_type, (ts, event_id)) = 'error' THEN 'abandoned' ELSE 'completed' END AS status FROM s, m GROUP BY user_id, session")
def lifecycle(spark, d):
    """Sessions by gaps of 30 minutes; the last event gives the status."""
    ev = t.events(spark, d)
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)
    s = ev.withColumn("fresh", F.when(gap <= 1800 * 10**6, 0).otherwise(1)).withColumn("session", F.sum("fresh").over(w))
    out = s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    end = ev.agg((F.max("ts") - F.make_dt_interval(mins=F.lit(30))).alias("cut"))
    status = F.when(F.col("ended") >= F.col("cut"), "active").when(F.col("last") == "error", "abandoned").otherwise("completed")
    return out.crossJoin(F.broadcast(end)).select("user_id", "session", "n", F.col("started").cast("timestamp_ntz").alias("started"), status.alias("status"))


@register("hop_scores", "WITH m AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), h AS (SELECT vec_id, vec_id // 10 AS chain, (list_cosine_similarity(e[17:32], lead(e[1:16]) OVER (PARTITION BY vec_id // 10 ORDER BY vec_id)) + 1) / 2 AS s, row_number() OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) - 1 AS i FROM m) SELECT chain, count(s) AS hops, round(avg(least(1, s * 1.2)), 6) AS mean_hop, round(sum(s * pow(0.9, i)) / sum(CASE WHEN s IS NOT NULL THEN pow(0.9, i) END), 6) AS attenuated, round(product(s * pow(0.9, i)), 6) AS product FROM h GROUP BY chain")
def hops(spark, d):
    """Chains of ten memories: effect of each against the cause of the next."""
    from ..operators import causal

    return causal.chain_scores(t.vectors(spark, d).withColumn("chain", F.floor(F.col("memory_id") / 10)))
