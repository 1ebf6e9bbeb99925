"""k-NN graphs, typed edges, traversal, paths and components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import fusion, graph, retrieval
from ..plans import weights as ws
from ..sources import tables as t
from . import register
from .search import TOP, best, shown
from .vectors import M, asked

K = 5
_SIMS = {"E1": "(list_cosine_similarity(a.e, b.e) + 1) / 2", "E7": "(list_cosine_similarity(a.e[1:16], b.e[1:16]) + 1) / 2", "E9": "(list_cosine_similarity(a.e[17:32], b.e[17:32]) + 1) / 2", "E11": "(list_cosine_similarity(a.e[49:64], b.e[49:64]) + 1) / 2", "E8": "(list_cosine_similarity(a.e[33:48], b.e[49:64]) + 1) / 2"}


def knn_sql(space: str, k: int = K) -> str:
    return f"SELECT source, target, sim FROM (SELECT a.memory_id AS source, b.memory_id AS target, {_SIMS[space]} AS sim, row_number() OVER (PARTITION BY a.memory_id ORDER BY round({_SIMS[space]}, 12) DESC, b.memory_id) AS n FROM m a JOIN m b ON a.memory_id <> b.memory_id) WHERE n <= {k}"


def knn(spark, d, space="E1", k=K):
    m = t.vectors(spark, d)
    if space == "E8":
        return graph.knn(m, k, t.part("E8_source"), target=t.part("E8_target"))
    return graph.knn(m, k, t.part(space))


for _space in ("E1", "E7", "E8"):

    @register(f"knn_graph_{_space.lower()}", f"{M} SELECT source, target, round(sim, 6) AS sim FROM ({knn_sql(_space)})")
    def knn_graph(spark, d, space=_space):
        return knn(spark, d, space).withColumn("sim", F.round("sim", 6))


@register("memory_neighbors", f"{M} SELECT source AS memory_id, target AS neighbor, round(sim, 6) AS sim FROM ({knn_sql('E1', 10)}) WHERE source % 100 = 0")
def neighbors(spark, d):
    near = retrieval.nearest(asked(spark, d), t.vectors(spark, d), ("E1",), 10)
    return near.select(F.col("query_id").alias("memory_id"), F.col("memory_id").alias("neighbor"), F.round("sim", 6).alias("sim"))


G = M + ", g AS (" + " UNION ALL ".join(f"SELECT source, target, '{s}' AS space, sim FROM ({knn_sql(s)})" for s in ("E1", "E7", "E9", "E11")) + ")"


def graphs(spark, d):
    return graph.knn_spaces(t.vectors(spark, d), K, {s: t.SLICES[s] for s in ("E1", "E7", "E9", "E11")}, F.col("E1"))


@register("unified_neighbors", G + ", r AS (SELECT *, row_number() OVER (PARTITION BY source, space ORDER BY round(sim, 12) DESC, target) AS n FROM g), w(space, w) AS (VALUES ('E1', 0.35), ('E7', 0.21), ('E9', 0.02), ('E11', 0.0)), x AS (SELECT source AS query_id, target AS memory_id, sum(w::DOUBLE / (n + 60)) AS score FROM r JOIN w USING (space) WHERE source % 100 = 0 AND w > 0 GROUP BY ALL)" + TOP.format("x", 10))
def unified(spark, d):
    """The stated set's neighbours in the graphs, which need no other memory's lists."""
    w = ws.PROFILES["default"]
    near = retrieval.nearest(asked(spark, d), t.vectors(spark, d), tuple(x for x in ("E1", "E7", "E9", "E11") if w[x] > 0), K)
    return shown(fusion.top(fusion.weighted_rrf(near, w), 10))


PAIR_SPACES = ("E1", "E5", "E7", "E8", "E9", "E10", "E11")


def pair_sims(spark, d):
    """Similarities, a column a space, of the graph's pairs in all spaces, the pairs being those near in any."""
    near = graphs(spark, d).select("source", "target").distinct()
    m = t.vectors(spark, d)
    both = near.join(m.select(F.col("memory_id").alias("source"), F.col("E1").alias("q")), "source").join(m.select(F.col("memory_id").alias("target"), "E1"), "target")
    return retrieval.rowwise(both, PAIR_SPACES, "source", "target")


def _typed_sql() -> str:
    from .search import SIM

    spaces = ("E1", "E5", "E7", "E8", "E9", "E10", "E11")
    edge = ", ".join(f"('{s}', {ws.EDGE[s]!r}::DOUBLE, {ws.CATEGORY[s]!r}::DOUBLE)" for s in spaces)
    rules = [(5, "causal_chain"), (7, "code_related"), (11, "entity_shared"), (8, "graph_connected"), (10, "paraphrase_aligned"), (6, "keyword_overlap"), (1, "semantic_similar")]
    case = " ".join(f"WHEN mask & {1 << (k - 1)} <> 0 THEN '{n}'" for k, n in rules)
    return G + ", pr AS (SELECT DISTINCT source, target FROM g), pq AS (SELECT source, target, a.e AS q, b.e AS e FROM pr JOIN m a ON a.memory_id = source JOIN m b ON b.memory_id = target), s AS (" + " UNION ALL ".join(f"SELECT source, target, '{x}' AS space, {SIM[x]} AS sim FROM pq" for x in spaces) + f"), k(space, edge, cw) AS (VALUES {edge}), a AS (SELECT source, target, sum(CASE WHEN sim >= edge THEN cw ELSE 0 END) AS agreement, coalesce(bit_or(CASE WHEN sim >= edge THEN (1 << (substr(space, 2)::INT - 1))::BIGINT END), 0) AS mask, count(*) FILTER (WHERE sim >= edge) AS n_agree FROM s JOIN k USING (space) GROUP BY source, target), te AS (SELECT source, target, agreement / 8.5::DOUBLE AS weight, mask, n_agree, CASE {case} ELSE 'multi_agreement' END AS edge_type FROM a WHERE agreement >= 2.5)"


TE = _typed_sql()


def typed(spark, d):
    return graph.typed_pairs(pair_sims(spark, d), PAIR_SPACES)


@register("typed_edges", TE + " SELECT source, target, round(weight, 6) AS weight, mask, n_agree, edge_type FROM te")
def typed_edges(spark, d):
    return typed(spark, d).select("source", "target", F.round("weight", 6).alias("weight"), F.col("mask").cast("long").alias("mask"), "n_agree", "edge_type")


@register("edge_statistics", TE + " SELECT edge_type, count(*) AS n, round(avg(weight), 6) AS mean_weight FROM te GROUP BY edge_type")
def edge_statistics(spark, d):
    return typed(spark, d).groupBy("edge_type").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("mean_weight"))


@register("edges_of_memories", TE + " SELECT source AS memory_id, 'out' AS direction, edge_type, count(*) AS n FROM te GROUP BY ALL UNION ALL SELECT target, 'in', edge_type, count(*) FROM te GROUP BY ALL")
def edges_of(spark, d):
    e = typed(spark, d)
    both = e.select(F.col("source").alias("memory_id"), F.lit("out").alias("direction"), "edge_type").unionByName(e.select(F.col("target").alias("memory_id"), F.lit("in").alias("direction"), "edge_type"))
    return both.groupBy("memory_id", "direction", "edge_type").agg(F.count("*").alias("n"))


E1 = f"{M}, e AS (SELECT source, target, sim AS weight, sim FROM ({knn_sql('E1')}))"


@register("traverse_graph", E1 + ", h0 AS (SELECT memory_id AS start, memory_id AS node, 0 AS depth, 1.0::DOUBLE AS weight FROM m WHERE memory_id % 100 = 0), h1 AS (SELECT start, target AS node, 1 AS depth, max(h0.weight * e.weight) AS weight FROM h0 JOIN e ON node = source WHERE e.weight >= 0.3 GROUP BY start, target), h1v AS (SELECT * FROM h1 WHERE node <> start), h2 AS (SELECT start, target AS node, 2 AS depth, max(h1v.weight * e.weight) AS weight FROM h1v JOIN e ON node = source WHERE e.weight >= 0.3 GROUP BY start, target), h2v AS (SELECT h2.* FROM h2 ANTI JOIN (SELECT start, node FROM h0 UNION SELECT start, node FROM h1v) v USING (start, node)) SELECT start, node, depth, round(weight, 6) AS weight FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1v UNION ALL SELECT * FROM h2v)")
def traverse(spark, d):
    e = knn(spark, d).withColumn("weight", F.col("sim"))
    starts = t.vectors(spark, d).filter("memory_id % 100 = 0")
    return graph.traverse(e, starts, 2, 0.3).select("start", "node", "depth", F.round("weight", 6).alias("weight"))


@register("graph_path", M + ", e AS (" + knn_sql("E8") + "), RECURSIVE_".replace(", RECURSIVE_", "") + """, h1 AS (SELECT source AS start, target AS n1, sim AS s1 FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(sim, 12) DESC, target) AS n FROM e WHERE source % 100 = 0 AND sim >= 0.3) WHERE n = 1),
 h2 AS (SELECT start, n1, n2, s2 FROM (SELECT start, n1, target AS n2, sim AS s2, row_number() OVER (PARTITION BY start ORDER BY round(sim, 12) DESC, target) AS n FROM h1 JOIN e ON source = n1 WHERE sim >= 0.3 AND target NOT IN (start, n1)) WHERE n = 1),
 h3 AS (SELECT start, n3, s3 FROM (SELECT start, target AS n3, sim AS s3, row_number() OVER (PARTITION BY start ORDER BY round(sim, 12) DESC, target) AS n FROM h2 JOIN e ON source = n2 WHERE sim >= 0.3 AND target NOT IN (start, n1, n2)) WHERE n = 1)
 SELECT memory_id AS start, 0 AS hop, memory_id AS node, 1.0::DOUBLE AS score FROM m WHERE memory_id % 100 = 0 UNION ALL SELECT start, 1, n1, round(s1 * 0.9::DOUBLE, 6) FROM h1 UNION ALL SELECT start, 2, n2, round(s2 * 0.81::DOUBLE, 6) FROM h2 UNION ALL SELECT start, 3, n3, round(s3 * 0.729::DOUBLE, 6) FROM h3""")  # fmt: skip
def path(spark, d):
    return graph.greedy_path(knn(spark, d, "E8"), t.vectors(spark, d).filter("memory_id % 100 = 0"), 3).withColumn("score", F.round("score", 6))


@register("graph_degrees", E1 + ", u AS (SELECT source AS node, 1 AS o FROM e UNION ALL SELECT target, 0 FROM e) SELECT node, sum(o)::BIGINT AS out_degree, sum(1 - o)::BIGINT AS in_degree FROM u GROUP BY node")
def degrees(spark, d):
    return graph.degrees(knn(spark, d))


@register("connected_components", "WITH RECURSIVE " + M[5:] + f", e0 AS (SELECT source, target FROM ({knn_sql('E1', 1)})), e AS (SELECT source AS a, target AS b FROM e0 UNION SELECT target, source FROM e0), r(node, seen) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen) SELECT node, min(seen) AS root FROM r GROUP BY node")
def components(spark, d):
    return graph.components(knn(spark, d, "E1", 1))


@register("edge_expansion", E1 + ", q AS (SELECT memory_id AS query_id, e AS q FROM m WHERE memory_id % 100 = 0), s AS (SELECT query_id, memory_id, (list_cosine_similarity(q, m.e) + 1) / 2 AS score FROM q JOIN m ON memory_id <> query_id), h AS (SELECT query_id, memory_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS n FROM s) WHERE n <= 5), x AS (SELECT query_id, target AS memory_id, max(score * weight * 0.8::DOUBLE) AS score FROM h JOIN e ON source = memory_id WHERE weight >= 0.4 GROUP BY query_id, target), y AS (SELECT x.* FROM x ANTI JOIN h USING (query_id, memory_id)) SELECT query_id, memory_id, round(score, 6) AS score FROM (SELECT * FROM h UNION ALL SELECT * FROM y)")
def expansion(spark, d):
    hits = retrieval.single_space(asked(spark, d), t.vectors(spark, d), "E1", 5).drop("rank")
    return graph.expand(hits, knn(spark, d).withColumn("weight", F.col("sim"))).withColumn("score", F.round("score", 6))


@register("search_connections", M + ", q AS (SELECT memory_id AS query_id, e AS q FROM m WHERE memory_id % 100 = 0), x AS (SELECT query_id, memory_id, greatest(1.2 * (list_cosine_similarity(q[33:48], e[49:64]) + 1) / 2, 0.8 * (list_cosine_similarity(q[49:64], e[33:48]) + 1) / 2) AS score FROM q JOIN m ON memory_id <> query_id)" + TOP.format("x", 10))
def connections(spark, d):
    out, back = ("E8_source", "E8_target"), ("E8_target", "E8_source")
    return shown(best(spark, d, (out, back), lambda s, q, m: np.maximum(1.2 * s[out], 0.8 * s[back])))
