"""Lookups, pair comparison, graph similarity and paths."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import temporal as tf
from ..functions import text as tx
from ..functions import vectors as v
from ..operators import graph, retrieval, wide
from ..plans import weights as ws
from ..sources import tables as t
from . import register
from .graphs import knn, knn_sql
from .search import PAIRS, S, added, s_sql, shown, SIM, SPACES, TOP
from .search import pairs as wide_pairs
from .sparse import docs
from .vectors import M, asked


@register("memory_lookup", "SELECT vec_id AS memory_id, label::BIGINT AS label, length(text) AS chars, source FROM embeddings LEFT JOIN documents ON doc_id = vec_id WHERE vec_id IN (0, 7, 42, 99, 100000)")
def lookup(spark, d):
    """Memories of a stated list of ids, with their content; ids that aren't there give no row."""
    ids = spark.createDataFrame([(i,) for i in (0, 7, 42, 99, 100000)], "memory_id long")
    own = t.read(spark, d, "documents").select(F.col("doc_id").alias("memory_id"), F.length("text").cast("long").alias("chars"), "source")
    return t.vectors(spark, d).join(F.broadcast(ids), "memory_id").join(own, "memory_id", "left").select("memory_id", F.col("label").cast("long").alias("label"), "chars", "source")


@register("prefix_search", "WITH x AS (SELECT page_id, url, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages WHERE starts_with(url, 'https://')), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY url, page_id) AS n FROM x) SELECT page_id, url FROM r WHERE n <= 2")
def prefix(spark, d):
    """The first two keys of each host under a prefix."""
    x = t.read(spark, d, "pages").filter(F.col("url").startswith("https://")).withColumn("host", F.split(F.split("url", "://")[1], "/")[0])
    return x.withColumn("n", F.row_number().over(W.partitionBy("host").orderBy("url", "page_id"))).filter("n <= 2").select("page_id", "url")


@register("latest_page", "SELECT page_id, url, length(html) AS chars FROM pages ORDER BY page_id DESC LIMIT 20 OFFSET 10")
def page(spark, d):
    return t.read(spark, d, "pages").select("page_id", "url", F.length("html").cast("long").alias("chars")).orderBy(F.desc("page_id")).offset(10).limit(20)


def _lang(name: str) -> str:
    return " + ".join("contains(text, '" + m.replace("'", "''") + "')::INT" for m in tx.LANGUAGES[name])


@register("language_detection", f"WITH x AS (SELECT doc_id AS memory_id, {_lang('go')} AS g, {_lang('javascript')} AS j, {_lang('python')} AS p, {_lang('rust')} AS r FROM documents) SELECT memory_id, CASE WHEN greatest(g, j, p, r) = 0 THEN NULL WHEN g = greatest(g, j, p, r) THEN 'go' WHEN j = greatest(g, j, p, r) THEN 'javascript' WHEN p = greatest(g, j, p, r) THEN 'python' ELSE 'rust' END AS lang FROM x")
def language(spark, d):
    return docs(spark, d).select("memory_id", tx.programming_language(F.col("content")).alias("lang"))


@register("temporal_badges", PAIRS + f" SELECT query_id, memory_id, array_to_string(list_filter([CASE WHEN {SIM['E7']} > 0.8 THEN 'same session' END, CASE WHEN {SIM['E9']} > 0.7 THEN 'same day' WHEN {SIM['E9']} > 0.6 THEN 'same period' END, CASE WHEN {SIM['E11']} > 0.6 THEN 'same sequence' END], lambda x: x IS NOT NULL), ', ') AS badges FROM w WHERE {SIM['E7']} > 0.8 OR {SIM['E9']} > 0.6 OR {SIM['E11']} > 0.6")
def badges(spark, d):
    b = retrieval.reached(asked(spark, d), t.vectors(spark, d), ("E7", "E9", "E11"), lambda s: tf.badge_bits(s["E7"], s["E9"], s["E11"]))
    return b.select("query_id", "memory_id", F.array_join(tf.badges_of(F.col("mask")), ", ").alias("badges"))


def labelled(spark, d, space, score):
    """The best ten by a score of one similarity that sees whether both have one label, and whether the memory comes after the query."""
    m = t.vectors(spark, d).select("memory_id", "E1", "label")
    q = m.filter("memory_id % 100 = 0").select(F.col("memory_id").alias("query_id"), F.col("E1").alias("q"), "label")
    sides = lambda c, q, m: (q[c[0]].to_numpy()[:, None], m[c[1]].to_numpy()[None])
    same = lambda q, m: np.equal(*sides(("label", "label"), q, m))
    later = lambda q, m: np.less(*sides(("query_id", "memory_id"), q, m))
    return shown(retrieval.best(q, m, (space,), lambda s, q, m: score(s[space], same(q, m), later(q, m)), 10))


@register("graph_similarity", PAIRS + f", ov AS (SELECT query_id, memory_id, {SIM['E8']} AS e8, (SELECT label FROM m WHERE m.memory_id = w.query_id) = label AS same FROM w), x AS (SELECT query_id, memory_id, e8 * CASE WHEN query_id < memory_id THEN 1.2 ELSE 0.8 END::DOUBLE * (0.7::DOUBLE + 0.3::DOUBLE * CASE WHEN same THEN 1 ELSE 0.5 END) AS score FROM ov)" + TOP.format("x", 10))
def graph_similarity(spark, d):
    """E8 times a direction modifier and .7 + .3 * overlap; a shared label stands in for shared context, .5 is its default."""
    return labelled(spark, d, "E8", lambda s, same, later: s * np.where(later, 1.2, 0.8) * (0.7 + 0.3 * np.where(same, 1.0, 0.5)))


@register("connectivity_rank", PAIRS + f", ov AS (SELECT query_id, memory_id, {SIM['E1']} AS sim, CASE WHEN (SELECT label FROM m WHERE m.memory_id = w.query_id) = label THEN 1 ELSE 0 END AS overlap FROM w), x AS (SELECT query_id, memory_id, sim * 0.7::DOUBLE + overlap * 0.3::DOUBLE AS score FROM ov)" + TOP.format("x", 10))
def connectivity(spark, d):
    return labelled(spark, d, "E1", lambda s, same, later: s * 0.7 + same * 0.3)


@register("shortest_paths", "WITH RECURSIVE " + M[5:] + f", e AS (SELECT source, target FROM ({knn_sql('E1', 3)})), r(start, node, depth) AS (SELECT memory_id, memory_id, 0 FROM m WHERE memory_id % 100 = 0 UNION SELECT start, target, depth + 1 FROM r JOIN e ON source = node WHERE depth < 4) SELECT start, node, min(depth) AS depth FROM r GROUP BY start, node")
def shortest(spark, d):
    e = knn(spark, d, "E1", 3).select("source", "target", F.lit(1.0).alias("weight"))
    starts = t.vectors(spark, d).filter("memory_id % 100 = 0")
    return graph.traverse(e, starts, 4, 0.0).select("start", "node", "depth")


@register("fingerprint_pairs", S + " SELECT query_id, memory_id, round(avg(sim), 6) AS mean, round(max(sim), 6) AS high, round(min(sim), 6) AS low, round(product(greatest(sim, 0.01)), 6) AS product, round(sum(weight * sim) / sum(weight), 6) AS weighted FROM s JOIN c USING (space) GROUP BY query_id, memory_id")
def pairs(spark, d):
    """The stated set against all memories, over all spaces."""
    s, w = wide_pairs(spark, d), ws.PROFILES["default"]
    product = reduce(lambda a, b: a * b, [F.greatest(F.col(x), F.lit(0.01)) for x in SPACES])
    of = lambda how: wide.score(SPACES, how, w).alias(how)
    g = s.select("query_id", "memory_id", of("mean"), F.greatest(*SPACES).alias("high"), F.least(*SPACES).alias("low"), product.alias("product"), of("weighted"))
    return g.select("query_id", "memory_id", *(F.round(c, 6).alias(c) for c in ("mean", "high", "low", "product", "weighted")))


# Predefined search matrices; spaces that no vector stands in for are left out.
MATRICES = {
    "identity": {(s, s): 1.0 for s in (*SPACES, "E11")},
    "semantic_focused": {("E1", "E1"): 1.0, ("E5", "E5"): 0.3, ("E1", "E5"): 0.2, ("E5", "E1"): 0.2},
    "code_heavy": {("E7", "E7"): 1.0, ("E1", "E1"): 0.3, ("E1", "E7"): 0.2, ("E7", "E1"): 0.2},
    "balanced": {(s, s): 0.1 for s in ("E1", "E5", "E7", "E8", "E9", "E10", "E11")},
    "entity_focused": {("E11", "E11"): 1.0, ("E1", "E1"): 0.4, ("E8", "E8"): 0.3},
}


def _matrix_sql(m):
    return "(" + " + ".join(f"{x!r}::DOUBLE * {i if i == j else f'sqrt({i} * {j})'}" for (i, j), x in m.items()) + f") / {sum(m.values())!r}"


@register("search_matrix_presets", s_sql((*SPACES, "E11")) + ", p AS (SELECT query_id, memory_id, " + ", ".join(f"greatest(0, max(sim) FILTER (WHERE space = '{s}')) AS {s}" for s in (*SPACES, "E11")) + " FROM s GROUP BY ALL), x AS (" + " UNION ALL ".join(f"SELECT query_id, memory_id, '{n}' AS preset, {_matrix_sql(m)} AS score FROM p" for n, m in MATRICES.items()) + ") SELECT preset, query_id, memory_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY preset, query_id ORDER BY score DESC, memory_id) AS n FROM x) WHERE n <= 5")
def presets(spark, d):
    x = retrieval.bests(asked(spark, d), t.vectors(spark, d).select("memory_id", "E1"), (*SPACES, "E11"), {n: wide.of_matrix(m) for n, m in MATRICES.items()}, 5)
    return x.select(F.col("name").alias("preset"), "query_id", "memory_id", F.round("score", 6).alias("score"))


@register("relevant_filter", S + " SELECT query_id, count(DISTINCT memory_id) AS n FROM s JOIN hi USING (space) WHERE sim >= high GROUP BY query_id")
def relevant(spark, d):
    n = added(spark, d, ["hits"], lambda s, other: ((wide.masked(s, SPACES) != 0) & other).sum(axis=1, keepdims=True))
    return n.filter("hits > 0").select("query_id", F.col("hits").cast("long").alias("n"))


@register("overlap_with", "WITH a AS (SELECT source, list_distinct(list(lang)) AS ls FROM documents GROUP BY source) SELECT x.source AS a, y.source AS b, round(len(list_intersect(x.ls, y.ls))::DOUBLE / len(list_distinct(list_concat(x.ls, y.ls))), 6) AS jaccard FROM a x JOIN a y ON x.source < y.source")
def overlap(spark, d):
    """Jaccard of the languages of every two sources, which are few."""
    a = t.read(spark, d, "documents").groupBy("source").agg(F.collect_set("lang").alias("ls"))
    x, y = (a.select(F.col("source").alias(n), F.col("ls").alias(f"l{n}")) for n in "ab")
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", F.round(v.jaccard(F.col("la"), F.col("lb")), 6).alias("jaccard"))
