"""Typed relationships, their store and taxonomy, merges of sparse vectors, and aggregates over groups and frames."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import temporal as tf
from ..functions import vectors as v
from ..operators import curation, graph, retrieval, topics
from ..plans import relations as rel
from ..plans import weights as ws
from ..session import shared_dir
from ..sources import tables as t
from . import register
from .causal import _DIR, X
from .graphs import TE, typed
from .search import PAIRS, SIM, TOP, shown
from .sparse import P, docs, parts
from .topics import PF, members
from .upkeep import injected
from .vectors import M, asked

_LABELLED = ", z AS (SELECT source, target, weight, edge_type, a.e AS q, b.e AS e, a.label AS domain FROM te JOIN m a ON a.memory_id = source JOIN m b ON b.memory_id = target)"


def labelled(spark, d):
    """Typed edges with both ends' vectors and the domain of the source."""
    m = t.vectors(spark, d)
    e = typed(spark, d).select("source", "target", "weight", "edge_type")
    return e.join(m.select(F.col("memory_id").alias("source"), F.col("E1").alias("q"), F.col("label").alias("domain")), "source").join(m.select(F.col("memory_id").alias("target"), "E1"), "target")


@register("edge_directions", TE + _LABELLED + f", x AS (SELECT source, target, weight, {_DIR.format('q')} AS a, {_DIR.format('e')} AS b FROM z) SELECT source, target, CASE WHEN a = 'cause' AND b = 'effect' THEN 'forward' WHEN a = 'effect' AND b = 'cause' THEN 'backward' ELSE 'symmetric' END AS direction, round(weight * CASE WHEN a = 'cause' AND b = 'effect' THEN 1.2 WHEN a = 'effect' AND b = 'cause' THEN 0.8 ELSE 1 END::DOUBLE, 6) AS weight FROM x")
def directions(spark, d):
    """Typed edges with their direction, their weight changed by it."""
    a, b = retrieval.direction(F.col("q")), retrieval.direction(F.col("E1"))
    return labelled(spark, d).select("source", "target", rel.edge_direction(a, b).alias("direction"), F.round(F.col("weight") * retrieval.direction_modifier(a, b), 6).alias("weight"))


@register("edges_by_type", TE + " SELECT source, target, edge_type, round(weight, 6) AS weight FROM te WHERE edge_type IN ('semantic_similar', 'code_related')")
def edges_by_type(spark, d):
    """Edges written once by type; reading two types opens only their folders."""
    path = f"{shared_dir(spark)}/edges-{uuid.uuid4().hex}"
    e = typed(spark, d).select("source", "target", "weight", "edge_type")
    e.write.partitionBy("edge_type").parquet(path)
    kept = spark.read.schema(e.schema).parquet(path).filter(F.col("edge_type").isin("semantic_similar", "code_related"))
    return kept.select("source", "target", "edge_type", F.round("weight", 6).alias("weight"))


@register("causal_domains", TE + _LABELLED + " SELECT domain, count(*) AS n, count(DISTINCT source) AS nodes, round(avg(weight), 6) AS mean_strength FROM z GROUP BY domain")
def domains(spark, d):
    """Edges and nodes of each domain, and their average strength."""
    return labelled(spark, d).groupBy("domain").agg(F.count("*").alias("n"), F.count_distinct("source").alias("nodes"), F.round(F.avg("weight"), 6).alias("mean_strength"))


@register("edited_graph", TE + " SELECT source, target, round(weight, 6) AS weight FROM te WHERE source % 10 <> 0 AND target % 10 <> 0 AND edge_type <> 'semantic_similar' UNION ALL SELECT memory_id, memory_id + 1, 1.0::DOUBLE FROM m WHERE memory_id % 10 = 1 AND (memory_id, memory_id + 1) NOT IN (SELECT source, target FROM te WHERE edge_type <> 'semantic_similar')")
def edited(spark, d):
    """The typed edges after nodes (every tenth) and edges (one type) have been removed and others added."""
    e = typed(spark, d).select("source", "target", "weight", "edge_type")
    gone = e.filter("edge_type = 'semantic_similar'")
    nodes = t.vectors(spark, d).filter("memory_id % 10 = 0").select("memory_id")
    more = t.vectors(spark, d).filter("memory_id % 10 = 1").select(F.col("memory_id").alias("source"), (F.col("memory_id") + 1).alias("target"), F.lit(1.0).alias("weight"))
    left = graph.without_nodes(graph.without_edges(e, gone), nodes).select("source", "target", "weight")
    return graph.with_edges(left, more).select("source", "target", F.round("weight", 6).alias("weight"))


_RAW = ("direct", "indirect", "Bidirectional", "sequence", "loop", "unheard of")


@register("causal_by_mechanism", PAIRS + f", x AS (SELECT query_id, memory_id, {SIM['E1']} AS score FROM w WHERE memory_id % 6 IN (2, 4))" + TOP.format("x", 10))
def by_mechanism(spark, d):
    """The best relationships with a feedback mechanism, which memories name in words of their own."""
    words = F.array(*map(F.lit, _RAW))
    m = t.vectors(spark, d).withColumn("mechanism", rel.mechanism(F.get(words, (F.col("memory_id") % 6).cast("int"))))
    return shown(retrieval.single_space(asked(spark, d), m.filter("mechanism = 'feedback'"), "E1", 10, -1.0))


_WORDS = [(w, kind, c) for c, kinds in rel.TYPES.items() for kind, words in kinds.items() for w in words]


@register("relationship_types", "WITH tx(word, type, category) AS (VALUES " + ", ".join(f"('{w}', '{k}', '{c}')" for w, k, c in _WORDS) + "), tk AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM documents) SELECT coalesce(type, 'none') AS type, coalesce(category, 'invocation') AS category, count(*) AS n, count(DISTINCT word) AS words FROM tk LEFT JOIN tx USING (word) GROUP BY 1, 2")
def relationship_types(spark, d):
    """Words of all documents by the relationship they name."""
    from ..functions import text as tx

    tokens = docs(spark, d).select(F.explode(tx.words(F.col("content"))).alias("word")).groupBy("word").agg(F.count("*").alias("k"))
    return rel.named(tokens, "word").groupBy("type", "category").agg(F.sum("k").alias("n"), F.count("*").alias("words"))


@register("causal_score_maps", X + ", k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY e1 DESC, memory_id) AS n FROM s0) WHERE n <= 10) SELECT query_id, memory_id, round(e5, 6) AS e5, (e1 > 0.5)::INT + (e5 > 0.5)::INT + (e8 > 0.5)::INT + (e11 > 0.5)::INT AS n_high, 4 AS n_scores FROM k")
def score_maps(spark, d):
    """Scores per space as a map, and what can be read from it."""
    q, m = asked(spark, d), t.vectors(spark, d)
    hits = retrieval.single_space(q, m, "E1", 10, -1.0).select("query_id", "memory_id")
    own = retrieval.of_candidates(hits, q, m, ("E1", "E5", "E8", "E11")).groupBy("query_id", "memory_id").agg(F.map_from_arrays(F.collect_list(F.lower("space")), F.collect_list("sim")).alias("scores"))
    return own.select("query_id", "memory_id", F.round(F.col("scores")["e5"], 6).alias("e5"), F.size(F.map_filter("scores", lambda _, x: x > 0.5)).alias("n_high"), F.size("scores").alias("n_scores"))


_GROUPS = P + ", g AS (SELECT memory_id // 3 AS grp, count(*)::DOUBLE AS n FROM d GROUP BY 1), mg AS (SELECT memory_id // 3 AS grp, term, sum(w) AS total, count(*) AS k FROM post GROUP BY ALL)"


def sparse_merged(spark, d, how):
    post, _, _ = parts(spark, d)
    group = F.floor(F.col("memory_id") / 3).alias("grp")
    sizes = docs(spark, d).groupBy(group).agg(F.count("*").alias("n"))
    return curation.sparse_merged(post.select(group, "term", "w"), sizes, "grp", how).select("grp", "term", F.round("w", 6).alias("w"))


for _how, _cond in (("union", ""), ("intersection", " WHERE k = n")):

    @register(f"sparse_merge_{_how}", _GROUPS + f" SELECT grp, term, round(total / n, 6) AS w FROM mg JOIN g USING (grp){_cond}")
    def sparse_merge(spark, d, how=_how):
        """Term vectors of three memories merged into one."""
        return sparse_merged(spark, d, how)


@register("document_cube", "SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, grouping_id(source, lang)::BIGINT AS level FROM documents GROUP BY CUBE (source, lang)")
def cube(spark, d):
    """Documents by source, language, both and neither."""
    return t.read(spark, d, "documents").cube("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().cast("long").alias("level"))


@register("event_rollup", "SELECT event_type, hour(ts)::BIGINT AS hour, count(*) AS n, grouping_id(event_type, hour(ts))::BIGINT AS level FROM events GROUP BY ROLLUP (event_type, hour(ts))")
def rollup(spark, d):
    """Events by type and hour, by type, and all."""
    e = t.events(spark, d).select("event_type", F.hour("ts").cast("long").alias("hour"))
    return e.rollup("event_type", "hour").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


@register("event_frames", "SELECT event_id, ntile(4) OVER o AS quarter, round(cume_dist() OVER v, 6) AS share, round(percent_rank() OVER v, 6) AS percent, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS mean_of_three, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts))::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS in_day FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id), v AS (PARTITION BY user_id ORDER BY value)")
def frames(spark, d):
    """Quarters, distributions and moving frames over each user's events."""
    own = W.partitionBy("user_id")
    o, x = own.orderBy("ts", "event_id"), own.orderBy("value")
    day = own.orderBy("s").rangeBetween(-86400, 0)
    e = t.events(spark, d).withColumn("s", F.unix_seconds("ts"))
    return e.select("event_id", F.ntile(4).over(o).cast("long").alias("quarter"), F.round(F.cume_dist().over(x), 6).alias("share"), F.round(F.percent_rank().over(x), 6).alias("percent"), F.round(F.avg("value").over(o.rowsBetween(-2, 0)), 4).alias("mean_of_three"), F.count("*").over(day).alias("in_day"))


@register("day_names", "SELECT dayname(ts) AS day, dayofweek(ts)::BIGINT AS number, count(*) AS n FROM events GROUP BY ALL")
def day_names(spark, d):
    e = t.events(spark, d)
    return e.groupBy(tf.day_name(F.col("ts")).alias("day"), tf.day_of_week(F.col("ts")).cast("long").alias("number")).agg(F.count("*").alias("n"))


_WAVES = " + ".join(f"list_avg(list_transform(range(1, 52), lambda h: cos(2 * pi() * h * dt / {p})))" for p in (3600, 86400, 604800, 2592000, 31536000))


@register("periodic_vector_scores", f"WITH x AS (SELECT event_id, epoch(date_trunc('second', ts))::BIGINT - lag(epoch(date_trunc('second', ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dt FROM events) SELECT event_id, round((1 + ({_WAVES}) / 5) / 2, 4) AS score FROM x WHERE dt IS NOT NULL")
def periodic_vectors(spark, d):
    """Mapped cosine of the periodic encodings of an event and its user's event before."""
    before = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    e = t.events(spark, d).withColumn("before", before).filter("before is not null")
    score = (v.dot(tf.periodic_encoding(F.col("ts")), tf.periodic_encoding(F.col("before"))) + 1) / 2
    return e.select("event_id", F.round(score, 4).alias("score"))


@register("discovery_status", "SELECT event_type, count(*) AS runs, count(*) FILTER (WHERE value > 50) AS found, round(avg(value), 4) AS mean, max(ts) AS last_run FROM events GROUP BY event_type")
def discovery_status(spark, d):
    """Counters over a log of runs, which events stand in for."""
    e = t.events(spark, d)
    return e.groupBy("event_type").agg(F.count("*").alias("runs"), F.count(F.when(F.col("value") > 50, 1)).alias("found"), F.round(F.avg("value"), 4).alias("mean"), F.max("ts").cast("timestamp_ntz").alias("last_run"))


@register("brief_context")
def brief(spark, d):
    """The ten best candidates of each query within 200 tokens, divided among categories as the whole budget is."""
    near = injected(spark, d).withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("priority"), "memory_id"))).filter("n <= 10").drop("n")
    return curation.budgeted(near, total=200, budget=curation.shares(200))


_STRENGTHS = PF + ", tv AS (SELECT topic, " + ", ".join(f"coalesce(max(strength) FILTER (WHERE space = '{s}'), 0) AS s{s[1:]}" for s in ("E1", "E7", "E9", "E10")) + " FROM pf GROUP BY topic), tn AS (SELECT a.topic AS a, b.topic AS b FROM tv a JOIN tv b ON a.topic <> b.topic WHERE (a.s1 * b.s1 + a.s7 * b.s7 + a.s9 * b.s9 + a.s10 * b.s10) / sqrt((a.s1 ** 2 + a.s7 ** 2 + a.s9 ** 2 + a.s10 ** 2) * (b.s1 ** 2 + b.s7 ** 2 + b.s9 ** 2 + b.s10 ** 2)) > 0.7), rs(topic, seen) AS (SELECT topic, topic FROM tv UNION SELECT rs.topic, tn.b FROM rs JOIN tn ON tn.a = rs.seen), rt AS (SELECT topic, min(seen) AS parent, count(*) AS k FROM rs GROUP BY topic)"


@register("topic_hierarchy", _STRENGTHS.replace("WITH ", "WITH RECURSIVE ", 1) + " SELECT topic, CASE WHEN k > 1 THEN parent END AS parent, CASE WHEN k > 1 THEN 1 ELSE 0 END AS depth, k AS siblings FROM rt")
def hierarchy(spark, d):
    """Topics below a parent for those whose profiles have a cosine above .7, named by the smallest topic."""
    mb = members(spark, d)
    p = topics.profiles(topics.synthesise(mb), mb).groupBy("topic").agg(F.map_from_entries(F.collect_list(F.struct("space", "strength"))).alias("p"))
    p = p.select("topic", F.array(*(F.coalesce(F.col("p")[s], F.lit(0.0)) for s in ws.SPACES)).alias("p"))
    return topics.hierarchy(p).select("topic", "parent", "depth", "siblings")


@register("profile_clusters", "WITH RECURSIVE " + M[5:] + ", n AS (SELECT a.memory_id AS a, b.memory_id AS b FROM m a JOIN m b ON a.memory_id <> b.memory_id WHERE (list_cosine_similarity(a.e, b.e) + 1) / 2 >= 0.68), r(node, seen) AS (SELECT memory_id, memory_id FROM m UNION SELECT r.node, n.b FROM r JOIN n ON n.a = r.seen), c AS (SELECT node AS memory_id, min(seen) AS cluster FROM r GROUP BY node) SELECT cluster, count(*) AS n, round(avg(e[1]), 6) AS first FROM c JOIN m USING (memory_id) GROUP BY cluster")
def profile_clusters(spark, d):
    """Groups of memories that are linked by a mapped cosine of .68, and the first dimension of their centroids."""
    m = t.vectors(spark, d)
    own = graph.components(graph.similar_pairs(m.select("memory_id", "E1"), "E1", 0.68).select(F.col("a").alias("source"), F.col("b").alias("target")))
    c = m.join(own, F.col("memory_id") == F.col("node"), "left").withColumn("cluster", F.coalesce("root", "memory_id"))
    return c.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg(F.col("E1")[0]), 6).alias("first"))
