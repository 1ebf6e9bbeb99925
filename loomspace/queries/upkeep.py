"""Curation, provenance, files and context injection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import temporal as tf
from ..functions import text as tx
from ..functions import vectors as v
from ..operators import curation, graph, retrieval
from ..plans import weights as ws
from ..sources import tables as t
from . import register
from .vectors import M, asked

for _how, _expr in (("union", "avg(x)"), ("intersection", "CASE WHEN min(abs(x)) < 0.01 THEN 0 ELSE avg(x) END"), ("weighted_average", "sum(w * x) / sum(w)")):
    _norm = " / sqrt(sum(x * x) OVER (PARTITION BY label))" if _how == "union" else ""

    @register(f"merge_{_how}", M + f", x AS (SELECT label, 1.0::DOUBLE + memory_id % 3 AS w, unnest(range(1, 65)) AS i, unnest(e) AS x FROM m), g AS (SELECT label, i, {_expr} AS x, count(*) AS n FROM x GROUP BY ALL) SELECT label, i AS pos, n, round(x{_norm}, 6) AS x FROM g")
    def merge(spark, d, how=_how):
        m = t.vectors(spark, d).withColumn("w", 1.0 + F.col("memory_id") % 3)
        g = curation.merged(m, "label", how, "E1", "w" if how == "weighted_average" else None)
        return g.select("label", F.posexplode("vector").alias("pos", "x"), "n").select("label", (F.col("pos") + 1).cast("long").alias("pos"), "n", F.round("x", 6).alias("x"))


_DIR = "CASE WHEN list_var_pop(e[1:16]) > 1.05 * list_var_pop(e[17:32]) THEN 'cause' WHEN list_var_pop(e[17:32]) > 1.05 * list_var_pop(e[1:16]) THEN 'effect' ELSE 'unknown' END"
_CONSOLIDATE = M + f", x AS (SELECT memory_id, e, {_DIR} AS dir FROM m), p AS (SELECT a.memory_id AS a, b.memory_id AS b, (list_cosine_similarity(a.e, b.e) + 1) / 2 AS sim FROM x a JOIN x b ON a.memory_id < b.memory_id AND NOT (a.dir = 'cause' AND b.dir = 'effect') AND NOT (a.dir = 'effect' AND b.dir = 'cause')) SELECT a, b, round(sim, 6) AS sim FROM p WHERE sim >= 0.8"


@register("consolidation_candidates", _CONSOLIDATE)
def consolidation(spark, d):
    """All pairs that are nearly the same and don't point opposite ways."""
    m = t.vectors(spark, d).withColumn("dir", retrieval.direction(F.col("E1")))
    return curation.consolidation(m, 0.8).select("a", "b", F.round("sim", 6).alias("sim"))


@register("consolidation_batch", f"SELECT a, b, sim FROM ({_CONSOLIDATE}) ORDER BY sim DESC, a, b LIMIT 50")
def consolidation_batch(spark, d):
    """A day's merges: the best 50 candidates."""
    return consolidation(spark, d).orderBy(F.desc("sim"), "a", "b").limit(50)


@register("boost_importance", "SELECT event_id AS memory_id, round(least(1, greatest(0, (value % 100) / 100 + CASE event_type WHEN 'error' THEN -0.3 ELSE 0.2 END)), 6)::DOUBLE AS importance FROM events")
def boost(spark, d):
    ev = t.events(spark, d)
    return ev.select(F.col("event_id").alias("memory_id"), F.round(curation.boosted((F.col("value") % 100) / 100, F.when(F.col("event_type") == "error", -0.3).otherwise(0.2)), 6).alias("importance"))


@register("forget_concepts", "SELECT vec_id AS memory_id FROM embeddings ANTI JOIN (SELECT event_id AS vec_id FROM events WHERE event_type = 'error') USING (vec_id)")
def forget(spark, d):
    stones = t.events(spark, d).filter("event_type = 'error'").select(F.col("event_id").alias("memory_id"))
    return curation.live(t.vectors(spark, d), stones).select("memory_id")


@register("expired_tombstones", "SELECT event_id AS memory_id FROM events, (SELECT max(ts) AS as_of FROM events) WHERE event_type = 'error' AND epoch(date_trunc('second', as_of))::BIGINT - epoch(date_trunc('second', ts))::BIGINT > 7 * 86400")
def expired(spark, d):
    ev = t.events(spark, d)
    stones = ev.filter("event_type = 'error'").select(F.col("event_id").alias("memory_id"), F.col("ts").alias("deleted_at")).crossJoin(F.broadcast(ev.agg(F.max("ts").alias("as_of"))))
    return curation.expired(stones, F.col("as_of")).select("memory_id")


@register("latest_versions", "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def versions(spark, d):
    ev = t.events(spark, d).withColumn("v", F.struct("ts", "event_id"))
    return curation.latest(ev, "user_id", "v").select("user_id", "event_id", "event_type")


@register("audit_trail", "SELECT event_id, user_id, event_type AS operation, ts, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE user_id % 100 = 0 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'")
def audit(spark, d):
    """The log of stated users in a window of time, with a field of its JSON parameters."""
    ev = t.events(spark, d).filter("user_id % 100 = 0 and ts between timestamp '2024-01-05' and timestamp '2024-01-25'")
    return ev.select("event_id", "user_id", F.col("event_type").alias("operation"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@register("provenance_chain", "WITH a AS (SELECT user_id AS memory_id, count(*) AS audit, min(ts) AS first_ts FROM events GROUP BY ALL), i AS (SELECT user_id AS memory_id, count(*) AS changes FROM events WHERE event_type = 'purchase' GROUP BY ALL) SELECT vec_id AS memory_id, coalesce(audit, 0) AS audit, first_ts, CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END AS merges, coalesce(changes, 0) AS importance_changes FROM embeddings LEFT JOIN a ON a.memory_id = vec_id LEFT JOIN i ON i.memory_id = vec_id")
def provenance(spark, d):
    ev = t.events(spark, d).select(F.col("user_id").alias("memory_id"), "ts", F.col("event_type").alias("operation"), F.col("value").alias("delta"))
    m = t.vectors(spark, d).select("memory_id")
    merges = m.filter("memory_id % 2 = 0").withColumn("merged_into", F.col("memory_id") + 1)
    p = curation.provenance(m, ev, merges, ev.filter("operation = 'purchase'"))
    size = lambda c: F.greatest(F.lit(0), F.coalesce(F.size(c), F.lit(0))).cast("long")
    return p.select("memory_id", size("audit").alias("audit"), F.get("audit", F.lit(0))["ts"].cast("timestamp_ntz").alias("first_ts"), size("merged_into").cast("int").alias("merges"), size("importance_changes").alias("importance_changes"))


@register("watched_files", "SELECT split_part(split_part(url, '://', 2), '/', 1) AS file_path, count(*) AS chunks, max(page_id) AS last_id, round(avg(length(html)), 4) AS mean_chars FROM pages GROUP BY ALL")
def watched(spark, d):
    host = F.split(F.split("url", "://")[1], "/")[0]
    return t.read(spark, d, "pages").groupBy(host.alias("file_path")).agg(F.count("*").alias("chunks"), F.max("page_id").alias("last_id"), F.round(F.avg(F.length("html")), 4).alias("mean_chars"))


@register("file_watcher_stats", "WITH f AS (SELECT split_part(split_part(url, '://', 2), '/', 1) AS h, count(*) AS n FROM pages GROUP BY ALL) SELECT count(*) AS files, sum(n)::BIGINT AS chunks, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most FROM f")
def file_stats(spark, d):
    f = watched(spark, d)
    return f.agg(F.count("*").alias("files"), F.sum("chunks").alias("chunks"), F.round(F.avg("chunks"), 6).alias("mean"), F.min("chunks").alias("least"), F.max("chunks").alias("most"))


@register("reconcile_files", "SELECT DISTINCT source AS file_path FROM documents ANTI JOIN (SELECT DISTINCT source FROM documents WHERE doc_id % 50 = 0) f USING (source)")
def reconcile(spark, d):
    from ..sources.readers import orphans

    files = t.read(spark, d, "documents").select(F.col("source").alias("file_path"), "doc_id")
    return orphans(files, files.filter("doc_id % 50 = 0"))


@register("memetic_status", "SELECT count(*) AS documents, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, sum(strlen(text))::BIGINT AS bytes, count(DISTINCT sha256(text)) AS distinct_contents FROM documents")
def status(spark, d):
    return t.read(spark, d, "documents").agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"), F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.count_distinct(F.sha2("text", 256)).alias("distinct_contents"))


@register("merge_compatibility", M + ", x AS (SELECT label, memory_id, e, CASE WHEN list_var_pop(e[1:16]) > 1.05 * list_var_pop(e[17:32]) THEN 'cause' WHEN list_var_pop(e[17:32]) > 1.05 * list_var_pop(e[1:16]) THEN 'effect' ELSE 'unknown' END AS dir FROM m), p AS (SELECT a.label, min(list_cosine_similarity(a.e, b.e)) AS low FROM x a JOIN x b ON a.label = b.label AND a.memory_id < b.memory_id GROUP BY a.label) SELECT x.label, bool_or(dir = 'cause') AND bool_or(dir = 'effect') AS rejected, any_value(low) < 0.3 AS warns FROM x JOIN p USING (label) GROUP BY x.label")
def compatibility(spark, d):
    m = t.vectors(spark, d).withColumn("dir", retrieval.direction(F.col("E1")))
    low = graph.least_cosine(m, "label", F.col("E1")).select("label", (F.col("low") < 0.3).alias("warns"))
    both = m.groupBy("label").agg((F.bool_or(F.col("dir") == "cause") & F.bool_or(F.col("dir") == "effect")).alias("rejected"))
    return both.join(low, "label")


_INJ = "e1_ AS (SELECT query_id, memory_id, (list_cosine_similarity(q, e) + 1) / 2 AS sim FROM q JOIN m ON memory_id <> query_id), k AS (SELECT query_id, memory_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, memory_id) AS n FROM e1_) WHERE n <= 50)"


def injected(spark, d):
    """Candidates of each query with category, priority and tokens."""
    hits = retrieval.single_space(asked(spark, d), t.vectors(spark, d), "E1", 50)
    mem = t.memories(spark, d).select("memory_id", "created_at", "content")
    end = mem.agg(F.max("created_at").alias("as_of"))
    x = hits.join(mem, "memory_id").crossJoin(F.broadcast(end)).withColumn("age", tf.age(F.col("as_of"), F.col("created_at")))
    cat = F.when(F.col("score") < ws.LOW["E1"], "divergence").when(F.col("rank") < 10, "cluster").when(F.col("rank") < 30, "single").otherwise("session")
    tokens = tx.token_estimate(tx.summary(F.coalesce("content", F.lit(""))))
    return x.select("query_id", "memory_id", cat.alias("category"), F.round(curation.priority(F.col("score"), tf.injection_factor(F.col("age")), curation.diversity_bonus(F.col("score") * 5)), 6).alias("priority"), tokens.alias("tokens"))


@register("injection_priority", M + ", q AS (SELECT memory_id AS query_id, e AS q FROM m WHERE memory_id % 100 = 0), " + _INJ + ", ag AS (SELECT query_id, memory_id, sim, greatest(0, epoch(date_trunc('second', max(ts) OVER ()))::BIGINT - epoch(date_trunc('second', ts))::BIGINT) AS age FROM k JOIN events ON event_id = memory_id), mx AS (SELECT max(ts) AS as_of FROM events JOIN embeddings ON vec_id = event_id), z AS (SELECT query_id, memory_id, sim, epoch(date_trunc('second', as_of))::BIGINT - epoch(date_trunc('second', ts))::BIGINT AS age FROM k JOIN events ON event_id = memory_id, mx) SELECT query_id, memory_id, round(sim * CASE WHEN age < 3600 THEN 1.3 WHEN age < 86400 THEN 1.2 WHEN age < 604800 THEN 1.1 WHEN age < 2592000 THEN 1.0 ELSE 0.8 END::DOUBLE * CASE WHEN sim * 5 >= 5 THEN 1.5 WHEN sim * 5 >= 2.5 THEN 1.2 WHEN sim * 5 >= 1 THEN 1.0 ELSE 0.8 END::DOUBLE, 6) AS priority FROM z")
def injection(spark, d):
    return injected(spark, d).select("query_id", "memory_id", "priority")


@register("context_injection")
def context(spark, d):
    """Candidates within the token budget."""
    return curation.budgeted(injected(spark, d))
