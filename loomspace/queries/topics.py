"""Clusters, topics and their stability."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import clustering, sets, topics
from ..plans import weights as ws
from ..session import written
from ..sources import tables as t
from ..sources.portfolio import PortfolioStore
from . import register
from .indexes import folder
from .vectors import M

#: clusters that SQL can state: E1 by label, others by the signs of two dimensions
MB = M + ", mb AS (SELECT memory_id, 'E1' AS space, label::BIGINT AS cluster FROM m UNION ALL SELECT memory_id, 'E7', (e[1] > 0)::BIGINT * 2 + (e[2] > 0)::BIGINT FROM m UNION ALL SELECT memory_id, 'E10', (e[33] > 0)::BIGINT * 2 + (e[34] > 0)::BIGINT FROM m UNION ALL SELECT memory_id, 'E9', 0 FROM m)"
_CW = ", ".join(f"('{s}', {w!r}::DOUBLE)" for s, w in ws.CATEGORY.items())
TP = MB + f", cw(space, cw) AS (VALUES {_CW}), ds AS (SELECT space FROM mb JOIN cw USING (space) WHERE cluster >= 0 AND cw > 0 GROUP BY space HAVING count(DISTINCT cluster) >= 2), us AS (SELECT mb.* FROM mb SEMI JOIN ds USING (space)), pr AS (SELECT a.memory_id AS a, b.memory_id AS b FROM us a JOIN us b ON a.space = b.space AND a.cluster = b.cluster JOIN cw ON cw.space = a.space GROUP BY a.memory_id, b.memory_id HAVING sum(cw) >= 2.5), tp AS (SELECT a AS memory_id, min(b) AS topic FROM pr GROUP BY a)"


def members(spark, d):
    m = t.vectors(spark, d)
    sign = lambda i: (F.col("E1")[i - 1] > 0).cast("long")
    rows = F.array(F.struct(F.lit("E1").alias("space"), F.col("label").cast("long").alias("cluster")), F.struct(F.lit("E7").alias("space"), (sign(1) * 2 + sign(2)).alias("cluster")), F.struct(F.lit("E10").alias("space"), (sign(33) * 2 + sign(34)).alias("cluster")), F.struct(F.lit("E9").alias("space"), F.lit(0).cast("long").alias("cluster")))
    return m.select("memory_id", F.explode(rows).alias("x")).select("memory_id", "x.*")


@register("discriminating_spaces", TP + " SELECT space FROM ds")
def discriminating(spark, d):
    return topics.discriminating(members(spark, d))


@register("detect_topics", TP + " SELECT memory_id, topic FROM tp")
def detect(spark, d):
    """With three discriminating spaces of weight 1, agreement of 2.5 needs all three, so topics are equal signatures."""
    return topics.synthesise(members(spark, d))


PF = TP + ", sz AS (SELECT topic, count(*) AS size FROM tp GROUP BY topic), sg AS (SELECT space, count(DISTINCT cluster) = 1 AS single FROM mb GROUP BY space), ct AS (SELECT topic, space, cluster, count(*) AS n FROM tp JOIN mb USING (memory_id) GROUP BY ALL), pf AS (SELECT topic, space, CASE WHEN any_value(single) AND any_value(size) > 2 THEN 0 ELSE max(n)::DOUBLE / any_value(size) END AS strength FROM ct JOIN sz USING (topic) JOIN sg USING (space) GROUP BY topic, space)"


@register("topic_profiles", PF + " SELECT topic, space, round(strength, 6) AS strength FROM pf")
def profiles(spark, d):
    mb = members(spark, d)
    return topics.profiles(topics.synthesise(mb), mb).withColumn("strength", F.round("strength", 6))


@register("topic_portfolio", PF + ", ag AS (SELECT topic, least(8.5, sum(strength * cw)) AS a FROM pf JOIN cw USING (space) GROUP BY topic) SELECT topic, size, round(a, 6) AS agreement, round(a / 8.5, 6) AS confidence, (SELECT count(*) FROM tp x WHERE x.topic = ag.topic AND x.memory_id % 2 = 0) AS even_members FROM ag JOIN sz USING (topic)")
def portfolio(spark, d):
    mb = members(spark, d)
    tp = topics.synthesise(mb)
    size = tp.groupBy("topic").agg(F.count("*").alias("size"), F.count(F.when(F.col("memory_id") % 2 == 0, 1)).alias("even_members"))
    return topics.agreement(topics.profiles(tp, mb)).join(size, "topic").select("topic", "size", F.round("agreement", 6).alias("agreement"), F.round("confidence", 6).alias("confidence"), "even_members")


@register("topic_entropy", TP + ", n AS (SELECT topic, count(*)::DOUBLE AS n FROM tp GROUP BY topic), p AS (SELECT n / sum(n) OVER () AS p FROM n) SELECT count(*) AS topics, round(CASE WHEN count(*) >= 2 THEN greatest(0, least(1, sum(-p * log2(p)) / log2(count(*)))) END, 6) AS entropy FROM p")
def entropy(spark, d):
    return topics.entropy(topics.synthesise(members(spark, d))).withColumn("entropy", F.round("entropy", 6))


SN = "WITH sn AS (SELECT date_trunc('hour', ts) AS h, list_distinct(list(event_type)) AS ids FROM events WHERE value > 80 GROUP BY ALL), lg AS (SELECT h, ids, lag(ids) OVER (ORDER BY h) AS prev FROM sn), ch AS (SELECT h, CASE WHEN prev IS NULL THEN 0 ELSE (len(list_filter(ids, lambda x: NOT list_contains(prev, x))) + len(list_filter(prev, lambda x: NOT list_contains(ids, x))))::DOUBLE / len(list_distinct(list_concat(ids, prev))) END AS churn FROM lg)"


def churned(spark, d):
    """Hourly sets of the event types seen with large values stand in for snapshots of topic ids."""
    ev = t.events(spark, d).filter("value > 80")
    sn = ev.groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.collect_set("event_type").alias("ids"))
    return topics.churn(sn)


@register("topic_churn", SN + " SELECT h AS hour, round(churn, 6) AS churn FROM ch")
def churn(spark, d):
    return churned(spark, d).select(F.col("ts").cast("timestamp_ntz").alias("hour"), F.round("churn", 6).alias("churn"))


@register("average_churn", SN + " SELECT round(avg(churn), 6) AS churn, count(*) AS n FROM ch WHERE h > (SELECT max(h) FROM ch) - INTERVAL 6 HOUR")
def average(spark, d):
    c = churned(spark, d)
    last = c.agg((F.max("ts") - F.make_dt_interval(hours=F.lit(6))).alias("since"))
    return c.crossJoin(F.broadcast(last)).filter("ts > since").agg(F.round(F.avg("churn"), 6).alias("churn"), F.count("*").alias("n"))


@register("topic_phases", SN + ", ag AS (SELECT h, churn, (epoch(max(h) OVER ()) - epoch(h)) / 3600 AS age FROM ch) SELECT CASE WHEN age < 1 AND churn > 0.3 THEN 'emerging' WHEN age >= 24 AND churn < 0.1 THEN 'stable' WHEN churn >= 0.5 THEN 'declining' ELSE 'kept' END AS phase, count(*) AS n FROM ag GROUP BY ALL")
def phases(spark, d):
    c = churned(spark, d)
    end = c.agg(F.max("ts").alias("end"))
    x = c.crossJoin(F.broadcast(end)).withColumn("age", (F.unix_seconds("end") - F.unix_seconds("ts")) / 3600)
    return x.groupBy(topics.phase(F.col("age"), F.col("churn"), F.lit("kept")).alias("phase")).agg(F.count("*").alias("n"))


@register("topic_changes", SN + " SELECT h AS hour, unnest(list_filter(ids, lambda x: NOT list_contains(prev, x))) AS added FROM lg WHERE prev IS NOT NULL")
def changes(spark, d):
    ev = t.events(spark, d).filter("value > 80")
    sn = ev.groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.collect_set("event_type").alias("ids")).withColumn("prev", F.lag("ids").over(W.orderBy("ts")))
    return sn.filter("prev is not null").select(F.col("ts").cast("timestamp_ntz").alias("hour"), F.explode(F.array_except("ids", "prev")).alias("added"))


@register("split_mega_topics", MB + ", tp AS (SELECT memory_id, 0 AS topic FROM m), s AS (SELECT space, count(DISTINCT cluster) AS n FROM mb GROUP BY space ORDER BY n DESC, space LIMIT 1), x AS (SELECT memory_id, min(memory_id) OVER (PARTITION BY cluster) AS topic FROM mb WHERE space = (SELECT space FROM s)) SELECT topic, count(*) AS n FROM x GROUP BY topic")
def mega(spark, d):
    mb = members(spark, d)
    one = t.vectors(spark, d).select("memory_id", F.lit(0).cast("long").alias("topic"))
    return topics.split_mega(mb, one, rounds=1).groupBy("topic").agg(F.count("*").alias("n"))


@register("density_clusters")
def clusters(spark, d):
    """Density clusters of four spaces."""
    m = t.vectors(spark, d)
    long = m.select("memory_id", F.explode(F.array(*(F.struct(F.lit(s).alias("space"), t.part(s).alias("v")) for s in ("E1", "E7", "E9", "E11")))).alias("x")).select("memory_id", "x.*")
    return clustering.density(long)


def term_sets(spark, d):
    """Sets of the sparse stand-ins, of documents: words (E6), pairs of neighbouring words (E13) and entities (E11)."""
    docs = t.spread(t.read(spark, d, "documents")).select(F.col("doc_id").alias("memory_id"), F.col("text").alias("content"))
    words = tx.words(F.col("content"))
    two = F.transform(F.array(words), lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.lit(0), F.size(w) - 1)), F.slice(w, 2, F.greatest(F.lit(0), F.size(w) - 1)), lambda a, b: F.concat_ws(" ", a, b)))[0]
    return {"E6": docs.select("memory_id", words.alias("terms")), "E13": docs.select("memory_id", two.alias("terms")), "E11": docs.select("memory_id", tx.mentions(F.col("content")).alias("terms"))}


def sparse_members(spark, d, at_least=0.5):
    """(memory_id, space, cluster) of the sparse spaces: density clusters over Jaccard distances, beyond 1 - ``at_least`` all alike."""
    out = None
    for space, own in term_sets(spark, d).items():
        members, kept = sets.classes(own)
        pairs = sets.similar(kept, at_least).select("a", "b", F.round(1 - F.col("sim"), 12).alias("d"))
        found = clustering.density_of_pairs(members, written(pairs)).select("memory_id", F.lit(space).alias("space"), "cluster")
        out = found if out is None else out.unionByName(found)
    return out


@register("similar_word_sets", "WITH w AS (SELECT doc_id AS memory_id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'))) AS s FROM documents), c AS (SELECT s, min(memory_id) AS rep, len(s) AS n FROM w WHERE len(s) > 0 GROUP BY s), e AS (SELECT rep, n, unnest(s) AS term FROM c), p AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.term = b.term AND a.rep < b.rep WHERE least(a.n, b.n) * 2 >= greatest(a.n, b.n) GROUP BY ALL) SELECT a, b, round(k::DOUBLE / (na + nb - k), 6) AS sim FROM p WHERE 2 * k >= na + nb - k")
def similar_word_sets(spark, d):
    """Pairs of different word sets with a Jaccard similarity of a half, each set by its smallest document."""
    _, kept = sets.classes(term_sets(spark, d)["E6"])
    return sets.similar(kept, 0.5).withColumn("sim", F.round("sim", 6))


@register("sparse_clusters")
def sparse_clusters(spark, d):
    """Density clusters of the sparse spaces; noise is left out."""
    return sparse_members(spark, d).filter("cluster >= 0")


@register("clustered_topics")
def clustered(spark, d):
    """Topics from the density clusters of four dense and three sparse spaces; noise is in no cluster and agrees with nothing, and spaces
    with one cluster, as the dense ones of the small tables, don't discriminate."""
    m = t.vectors(spark, d)
    part = {"E1": "E1", "E5": "E5_cause", "E7": "E7", "E10": "E10_paraphrase"}
    long = m.select("memory_id", F.explode(F.array(*(F.struct(F.lit(s).alias("space"), t.part(p).alias("v")) for s, p in part.items()))).alias("x")).select("memory_id", "x.*")
    dense = clustering.density(long).select("memory_id", "space", F.col("cluster").cast("long").alias("cluster"))
    return topics.synthesise(written(dense.unionByName(sparse_members(spark, d))))


@register("incremental_clusters", M + ", x AS (SELECT label, i, avg(e[i]) AS c FROM m, range(1, 65) r(i) WHERE memory_id % 10 <> 0 GROUP BY ALL), c AS (SELECT label, list(c ORDER BY i) AS c FROM x GROUP BY label), s AS (SELECT memory_id, c.label AS cluster, round(list_cosine_similarity(e, c.c), 9) AS sim FROM m, c WHERE memory_id % 10 = 0), b AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY sim DESC, cluster) AS n FROM s) SELECT memory_id, CASE WHEN sim >= 0.3 THEN cluster END AS cluster, round(sim, 6) AS sim, (SELECT count(*) FROM m WHERE memory_id % 10 = 0) >= 100 AS recluster FROM b WHERE n = 1")
def incremental(spark, d):
    """New memories (every tenth) beside the centroids of the others' clusters, and whether a hundred of them ask for a reclustering."""
    m = t.vectors(spark, d).withColumnRenamed("E1", "v")
    centres = clustering.centroids(m.filter("memory_id % 10 <> 0"), "label").select("label", "centroid")
    return clustering.assigned(m.filter("memory_id % 10 = 0"), centres, "label", 0.3).select("memory_id", F.col("label").alias("cluster"), F.round("sim", 6).alias("sim"), "recluster")


@register("embedder_clusters", M + ", s AS (SELECT label::BIGINT AS cluster, count(*) AS n, list(memory_id ORDER BY memory_id)[1:3] AS samples FROM m GROUP BY label) SELECT cluster, n, array_to_string(samples, ',') AS samples FROM s WHERE n >= 3")
def embedder_clusters(spark, d):
    m = t.vectors(spark, d).select(F.col("label").cast("long").alias("cluster"), "memory_id")
    s = m.withColumn("k", F.row_number().over(W.partitionBy("cluster").orderBy("memory_id")))
    g = s.groupBy("cluster").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.col("memory_id")))), lambda x: x.cast("string")), ",").alias("samples"))
    return g.filter("n >= 3")


@register("centroids", M + ", x AS (SELECT label, unnest(range(1, 65)) AS i, unnest(e) AS x FROM m), c AS (SELECT label, i, avg(x) AS c, count(*) AS n, avg(x * x) - avg(x) * avg(x) AS s FROM x GROUP BY ALL) SELECT label, max(n) AS n, round(max(c) FILTER (WHERE i = 1), 6) AS first, round(sqrt(greatest(0, sum(s))), 6) AS radius FROM c GROUP BY label")
def centroids(spark, d):
    c = clustering.centroids(t.vectors(spark, d).withColumnRenamed("E1", "v"), "label")
    return c.select("label", "n", F.round(F.col("centroid")[0], 6).alias("first"), F.round("radius", 6).alias("radius"))


@register("silhouette", M + ", dd AS (SELECT a.memory_id AS mp, a.label AS cp, b.label AS cq, avg(1 - list_cosine_similarity(a.e, b.e)) AS d FROM m a JOIN m b ON a.memory_id <> b.memory_id GROUP BY ALL), ab AS (SELECT mp, cp, max(d) FILTER (WHERE cp = cq) AS a, min(d) FILTER (WHERE cp <> cq) AS b FROM dd GROUP BY mp, cp) SELECT cp AS label, count(*) AS n, round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM ab GROUP BY cp")
def silhouette(spark, d):
    s = clustering.silhouette(t.vectors(spark, d).withColumnRenamed("E1", "v"), "label")
    return s.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("silhouette"))


@register("topic_merge")
def merged(spark, d):
    """Topics merged by the cosine of their profiles, largest first."""
    mb = members(spark, d)
    tp = topics.synthesise(mb)
    p = topics.profiles(tp, mb).groupBy("topic").agg(F.map_from_entries(F.collect_list(F.struct("space", "strength"))).alias("p")).join(tp.groupBy("topic").agg(F.count("*").alias("size")), "topic")
    p = p.select("topic", "size", F.array(*(F.coalesce(F.col("p")[s], F.lit(0.0)) for s in ws.SPACES)).alias("p"))
    return topics.merged(p)


@register("portfolio_restored", PF + ", ag AS (SELECT topic, least(8.5, sum(strength * cw)) AS a FROM pf JOIN cw USING (space) GROUP BY topic) SELECT topic, size, round(a, 6) AS agreement, round(a / 8.5, 6) AS confidence, a >= 2.5 AS valid FROM ag JOIN sz USING (topic)")
def portfolio_restored(spark, d):
    """The portfolio of a session, restored after another session has saved its own."""
    mb = members(spark, d)
    tp = written(topics.synthesise(mb))
    store = PortfolioStore(spark, folder(spark))
    store.save(tp, topics.profiles(tp, mb), "first", dt.datetime(2024, 1, 1), 0)
    half = tp.filter("topic % 2 = 0")
    store.save(half, topics.profiles(half, mb), "second", dt.datetime(2024, 1, 2), 1)
    out = PortfolioStore(spark, store.path)
    return out.summary(out.latest("first")).select("topic", "size", F.round("agreement", 6).alias("agreement"), F.round("confidence", 6).alias("confidence"), "valid")
