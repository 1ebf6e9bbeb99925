"""Evaluation metrics over rankings, clusters and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import temporal as tf
from ..operators import fusion, metrics
from ..sources import tables as t
from . import register
from .vectors import M

RK = M + ", q AS (SELECT memory_id AS query_id, e AS q, label AS ql FROM m WHERE memory_id % 100 = 0), s AS (SELECT query_id, memory_id, (list_cosine_similarity(q, e) + 1) / 2 AS sim, (ql = label)::INT AS grade FROM q JOIN m ON memory_id <> query_id), r AS (SELECT query_id, memory_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, memory_id) - 1 AS rank FROM s)"


@register("retrieval_metrics", RK + ", x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, rank) AS ideal, sum(grade) OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM r) SELECT query_id, round(sum(CASE WHEN rank < 10 THEN grade ELSE 0 END) / 10.0::DOUBLE, 6) AS precision, round(sum(CASE WHEN rank < 10 THEN grade ELSE 0 END)::DOUBLE / sum(grade), 6) AS recall, round(1.0::DOUBLE / (min(CASE WHEN grade > 0 THEN rank END) + 1), 6) AS mrr, round(sum(CASE WHEN rank < 10 THEN (pow(2, grade) - 1) / log2(rank + 2) ELSE 0 END) / sum(CASE WHEN ideal <= 10 THEN (pow(2, grade) - 1) / log2(ideal + 1) ELSE 0 END), 6) AS ndcg, round(sum(CASE WHEN grade > 0 THEN seen::DOUBLE / (rank + 1) ELSE 0 END) / sum(grade), 6) AS ap FROM x GROUP BY query_id")
def retrieval_metrics(spark, d):
    m = t.vectors(spark, d).select("memory_id", "E1", F.col("label").cast("long").alias("label"))
    q = m.filter("memory_id % 100 = 0").select(F.col("memory_id").alias("query_id"), F.col("E1").alias("q"), "label")
    x = metrics.of_rankings(q, m, "E1", "label", 10)
    return x.select("query_id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr", "ndcg", "ap")))


CT = M + ", ct AS (SELECT (e[1] > 0)::INT * 2 + (e[2] > 0)::INT AS c, label AS l, count(*) AS n FROM m GROUP BY ALL), tt AS (SELECT sum(n)::DOUBLE AS t FROM ct), ca AS (SELECT c, sum(n)::DOUBLE AS a FROM ct GROUP BY c), cb AS (SELECT l, sum(n)::DOUBLE AS b FROM ct GROUP BY l)"


def table(spark, d):
    sign = lambda i: (F.col("E1")[i] > 0).cast("int")
    return metrics.contingency(t.vectors(spark, d).withColumn("c", sign(0) * 2 + sign(1)), "c", "label")


@register("cluster_purity", CT + " SELECT round(sum(top) / sum(n)::DOUBLE, 6) AS purity FROM (SELECT c, max(n) AS top, sum(n) AS n FROM ct GROUP BY c)")
def purity(spark, d):
    return metrics.purity(table(spark, d)).withColumn("purity", F.round("purity", 6))


@register("cluster_nmi", CT + " SELECT round(2 * (SELECT sum(n / t * ln(n * t / (a * b))) FROM ct JOIN ca USING (c) JOIN cb USING (l), tt) / ((SELECT sum(-a / t * ln(a / t)) FROM ca, tt) + (SELECT sum(-b / t * ln(b / t)) FROM cb, tt)), 6) AS nmi")
def nmi(spark, d):
    return metrics.nmi(table(spark, d)).withColumn("nmi", F.round("nmi", 6))


@register("cluster_ari", CT + ", v AS (SELECT (SELECT sum(n * (n - 1) / 2.0::DOUBLE) FROM ct) AS i, (SELECT sum(a * (a - 1) / 2) FROM ca) AS a, (SELECT sum(b * (b - 1) / 2) FROM cb) AS b, t FROM tt) SELECT round((i - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2)), 6) AS ari FROM v")
def ari(spark, d):
    return metrics.ari(table(spark, d)).withColumn("ari", F.round("ari", 6))


@register("sequence_metrics", "WITH t AS (SELECT conv_id, turn, length(text) AS n FROM conversations), k AS (SELECT a.conv_id, sum(sign(b.n - a.n))::DOUBLE / count(*) AS tau FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn GROUP BY a.conv_id), o AS (SELECT conv_id, n, lag(n) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM t), s AS (SELECT conv_id, avg((n >= p)::INT) AS share FROM o WHERE p IS NOT NULL GROUP BY conv_id) SELECT conv_id, round(tau, 6) AS tau, round(share, 6) AS share FROM k JOIN s USING (conv_id)")
def sequence(spark, d):
    x = t.read(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return metrics.kendall(x, "conv_id", "turn", "n").join(metrics.ordered(x, "conv_id", "turn", "n"), "conv_id").select("conv_id", F.round("tau", 6).alias("tau"), F.round("share", 6).alias("share"))


@register("boundary_f1", "SELECT role, round(2.0::DOUBLE * count(*) FILTER (WHERE f AND b) / (2 * count(*) FILTER (WHERE f AND b) + count(*) FILTER (WHERE f AND NOT b) + count(*) FILTER (WHERE NOT f AND b)), 6) AS f1 FROM (SELECT role, length(text) > 200 AS f, turn = 0 AS b FROM conversations) GROUP BY role HAVING count(*) FILTER (WHERE f OR b) > 0")
def boundary(spark, d):
    x = t.read(spark, d, "conversations").select("role", (F.length("text") > 200).alias("f"), (F.col("turn") == 0).alias("b"))
    g = x.groupBy("role").agg(F.round(metrics.f1(F.col("f"), F.col("b")), 6).alias("f1"), F.count(F.when(F.col("f") | F.col("b"), 1)).alias("n"))
    return g.filter("n > 0").drop("n")


@register("temporal_metrics", "WITH a AS (SELECT max(ts) AS as_of FROM events), g AS (SELECT user_id, hour(ts) AS h, epoch(date_trunc('second', as_of))::BIGINT - epoch(date_trunc('second', ts))::BIGINT AS age, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS rank FROM events, a) SELECT user_id, round(avg((age <= 604800)::INT), 6) AS freshness, round(avg((h BETWEEN 8 AND 11)::INT), 6) AS periodic FROM g WHERE rank < 10 GROUP BY user_id")
def temporal(spark, d):
    """Share of each user's ten largest events that are fresh, and that fall in the morning."""
    ev = t.events(spark, d)
    x = ev.crossJoin(F.broadcast(ev.agg(F.max("ts").alias("as_of")))).withColumn("age", tf.age(F.col("as_of"), F.col("ts")))
    r = fusion.top(x.withColumnRenamed("event_id", "memory_id"), 10, ("user_id",), "value")
    return r.groupBy("user_id").agg(F.round(F.avg((F.col("age") <= 604800).cast("double")), 6).alias("freshness"), F.round(F.avg(F.hour("ts").between(8, 11).cast("double")), 6).alias("periodic"))


@register("decay_accuracy", "WITH a AS (SELECT max(ts) AS as_of FROM events), g AS (SELECT user_id, epoch(date_trunc('second', as_of))::BIGINT - epoch(date_trunc('second', ts))::BIGINT AS age, value FROM events, a) SELECT x.user_id, round(avg((y.value <= x.value)::INT), 6) AS accuracy FROM g x JOIN g y ON x.user_id = y.user_id AND x.age < y.age GROUP BY x.user_id")
def decay(spark, d):
    """How often the newer of two events of a user has a value no smaller, over all of the user's events."""
    ev = t.events(spark, d)
    g = ev.crossJoin(F.broadcast(ev.agg(F.max("ts").alias("as_of")))).select("user_id", tf.age(F.col("as_of"), F.col("ts")).alias("age"), "value")
    return metrics.decay_accuracy(g, "user_id", "age", "value").withColumn("accuracy", F.round("accuracy", 6))
