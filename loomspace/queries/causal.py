"""Causal search, chains and discovery scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import causal, fusion, graph, retrieval
from ..sources import tables as t
from . import register
from .search import PAIRS, SIM, TOP, best, shown
from .vectors import M, asked

_GATE = "CASE WHEN e5 >= 0.04 THEN 1.10 WHEN e5 <= 0.008 THEN 0.85 ELSE 1 END::DOUBLE"
X = PAIRS + f", s0 AS (SELECT query_id, memory_id, q, e, {SIM['E1']} AS e1, {SIM['E5']} AS e5, {SIM['E8']} AS e8, {SIM['E11']} AS e11 FROM w)"


def gated(s, score):
    """As ``retrieval.causal_gate``, of matrices."""
    return score * np.where(s["E5"] >= 0.04, 1.10, np.where(s["E5"] <= 0.008, 0.85, 1.0))


def directed(spark, d, spaces, score):
    """The best ten by a score that sees the direction of query and memory (cause, effect or unknown)."""
    q = asked(spark, d).select("query_id", "q", retrieval.direction(F.col("q")).alias("direction"))
    m = t.vectors(spark, d).select("memory_id", "E1", retrieval.direction(F.col("E1")).alias("direction"))
    sides = lambda q, m: (q["direction"].to_numpy(str)[:, None], m["direction"].to_numpy(str)[None])
    return shown(retrieval.best(q, m, spaces, lambda s, q, m: score(s, *sides(q, m)), 10))


@register("search_causes", X + f", x AS (SELECT query_id, memory_id, (0.8 * e1 + 0.2 * e5) * 0.8 * {_GATE} AS score FROM s0)" + TOP.format("x", 10))
def causes(spark, d):
    return shown(best(spark, d, ("E1", "E5"), lambda s, q, m: gated(s, causal.abduction(s["E1"], s["E5"]))))


@register("search_effects", X + f", x AS (SELECT query_id, memory_id, least(1, (0.8 * e1 + 0.2 * e5) * 1.2) * {_GATE} AS score FROM s0)" + TOP.format("x", 10))
def effects(spark, d):
    return shown(best(spark, d, ("E1", "E5"), lambda s, q, m: gated(s, np.minimum(1, (0.8 * s["E1"] + 0.2 * s["E5"]) * 1.2))))


_DIR = "CASE WHEN list_var_pop({0}[1:16]) > 1.05 * list_var_pop({0}[17:32]) THEN 'cause' WHEN list_var_pop({0}[17:32]) > 1.05 * list_var_pop({0}[1:16]) THEN 'effect' ELSE 'unknown' END"


@register("direction_rerank", X + f", x AS (SELECT query_id, memory_id, least(1, e1 * CASE WHEN {_DIR.format('q')} = {_DIR.format('e')} AND {_DIR.format('q')} <> 'unknown' THEN 1.08 ELSE 1 END::DOUBLE) AS score FROM s0)" + TOP.format("x", 10))
def direction_rerank(spark, d):
    return directed(spark, d, ("E1",), lambda s, a, b: np.minimum(1, s["E1"] * np.where((a == b) & (a != "unknown"), 1.08, 1.0)))


@register("asymmetric_similarity", X + f", x AS (SELECT query_id, memory_id, e5 * CASE WHEN {_DIR.format('q')} = 'cause' AND {_DIR.format('e')} = 'effect' THEN 1.2 WHEN {_DIR.format('q')} = 'effect' AND {_DIR.format('e')} = 'cause' THEN 0.8 ELSE 1 END::DOUBLE AS score FROM s0)" + TOP.format("x", 10))
def asymmetric(spark, d):
    turned = lambda a, b: np.where((a == "cause") & (b == "effect"), 1.2, np.where((a == "effect") & (b == "cause"), 0.8, 1.0))
    return directed(spark, d, ("E5",), lambda s, a, b: s["E5"] * turned(a, b))


_LONG = ", s AS (" + " UNION ALL ".join(f"SELECT query_id, memory_id, '{n}' AS space, {c} AS sim FROM s0" for n, c in (("E1", "e1"), ("E5", "e5"), ("E8", "e8"), ("E11", "e11"))) + "), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, space ORDER BY sim DESC, memory_id) - 1 AS rank FROM s), l AS (SELECT * FROM r WHERE rank < 30), c(space, w) AS (VALUES ('E1', 0.30), ('E5', 0.35), ('E8', 0.15), ('E11', 0.20))"


@register("causal_multi_embedder", X + _LONG + ", f AS (SELECT query_id, memory_id, sum(w::DOUBLE / (61 + rank)) AS score, count(*) FILTER (WHERE sim > 0.5) / 4.0::DOUBLE AS consensus FROM l JOIN c USING (space) GROUP BY query_id, memory_id) SELECT query_id, memory_id, round(score, 6) AS score, consensus FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS n FROM f) WHERE n <= 10")
def multi(spark, d):
    # Weights of the four causal spaces.
    w = {"E1": 0.30, "E5": 0.35, "E8": 0.15, "E11": 0.20}
    lists = retrieval.nearest(asked(spark, d), t.vectors(spark, d), tuple(w), 30)
    fused = fusion.weighted_rrf(lists, w).join(fusion.consensus(lists, tuple(w)), ["query_id", "memory_id"])
    return fusion.top(fused, 10).select("query_id", "memory_id", F.round("score", 6).alias("score"), "consensus")


@register("causal_hybrid", X + ", x AS (SELECT query_id, memory_id, 0.6 * e1 + 0.4 * e5 AS score FROM s0)" + TOP.format("x", 10))
def hybrid(spark, d):
    return shown(best(spark, d, ("E1", "E5"), lambda s, q, m: 0.6 * s["E1"] + 0.4 * s["E5"]))


@register("causal_chain")
def chain(spark, d):
    """Greedy chains over cause -> effect neighbours; each hop takes the best memory not yet in the chain."""
    m = t.vectors(spark, d)
    edges = graph.knn(m, 20, t.part("E5_effect"), 0.3, target=t.part("E5_cause"))
    return graph.greedy_path(edges, m.filter("memory_id % 100 = 0"), 5).withColumn("score", F.round("score", 6))


_HOP = ", h{0} AS (SELECT start, memory_id, sim, seen, f FROM (SELECT start, m.memory_id, round(list_cosine_similarity(h.f, m.e[1:16]), 9) AS sim, list_append(seen, m.memory_id) AS seen, m.e[17:32] AS f, row_number() OVER (PARTITION BY start ORDER BY round(list_cosine_similarity(h.f, m.e[1:16]), 9) DESC, m.memory_id) AS n FROM h{1} h JOIN m ON NOT list_contains(seen, m.memory_id)) WHERE n = 1 AND sim >= 0.5)"


@register("effect_chains", M + ", h0 AS (SELECT memory_id AS start, e[17:32] AS f, []::BIGINT[] AS seen FROM m WHERE memory_id % 100 = 0)" + "".join(_HOP.format(k, k - 1) for k in range(1, 11)) + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT start, {k}::BIGINT AS hop, memory_id, round(sim, 6) AS sim FROM h{k}" for k in range(1, 11)) + ")")
def effect_chains(spark, d):
    """Greedy chains of at most ten memories from the effects of the stated set: each one's cause is the nearest to the last one's effect."""
    m = t.vectors(spark, d).select("memory_id", t.part("E5_cause").alias("cause"), t.part("E5_effect").alias("effect"))
    starts = m.filter("memory_id % 100 = 0").select(F.col("memory_id").alias("start"), F.col("effect").alias("v"))
    return causal.effect_chains(m, starts).select("start", F.col("hop").cast("long").alias("hop"), "memory_id", F.round("sim", 6).alias("sim"))


def _held(phrases) -> str:
    """The SQL of ``phrase_count`` of a column t."""
    words = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
    before = f"substr(t, greatest(1, instr(t, p) - {causal.NEGATED}), least({causal.NEGATED + 1}, instr(t, p)))"
    return f"len(list_filter({words(phrases)}, lambda p: instr(t, p) > 0 AND len(list_filter({words(causal.NEGATIONS)}, lambda n: contains({before}, n))) = 0))"


@register("causal_intent", f"WITH x AS (SELECT doc_id AS memory_id, lower(coalesce(text, '')) AS t FROM documents), y AS (SELECT memory_id, {_held(causal.CAUSE_PHRASES)} AS c, {_held(causal.EFFECT_PHRASES)} AS e FROM x) SELECT memory_id, CASE WHEN c >= e AND c > 0 THEN 'cause' WHEN e > c THEN 'effect' ELSE 'unknown' END AS intent FROM y")
def intent(spark, d):
    return t.read(spark, d, "documents").select(F.col("doc_id").alias("memory_id"), causal.intent(F.col("text")).alias("intent"))


_MARKS = " + ".join(f"contains(t, '{m}')::INT" for m in causal.CAUSE_MARKERS + causal.EFFECT_MARKERS)


@register("causal_pair_scan", M + f""", tm AS (SELECT event_id AS memory_id, user_id, epoch(date_trunc('second', ts))::BIGINT AS s FROM events), y AS (SELECT memory_id, user_id, s, e, length(coalesce(text, '')) AS n, lower(coalesce(text, '')) AS t FROM m JOIN tm USING (memory_id) LEFT JOIN documents ON doc_id = memory_id),
 z AS (SELECT memory_id, user_id, s, e, n, {_MARKS} AS k FROM y),
 p AS (SELECT a.memory_id AS a, b.memory_id AS b, a.k + b.k AS k, round(list_cosine_similarity(a.e, b.e), 9) AS sim, a.user_id = b.user_id AS same, least(a.n, b.n) AS n FROM z a JOIN z b ON b.s - a.s BETWEEN 10 AND 86400)
 SELECT a, b, round(least(1, 0.15 * k + 0.1 + CASE WHEN same THEN 0.1 ELSE 0 END + CASE WHEN n > 100 THEN 0.05 ELSE 0 END + CASE WHEN n > 300 THEN 0.05 ELSE 0 END + CASE WHEN sim BETWEEN 0.5 AND 0.8 THEN 0.1 ELSE 0 END), 6)::DOUBLE AS score FROM p WHERE sim BETWEEN 0.5 AND 0.9""")  # fmt: skip
def pair_scan(spark, d):
    """Memories 10 seconds to a day apart with a cosine in [.5, .9], scored."""
    content = F.coalesce("content", F.lit(""))
    z = t.memories(spark, d).select("memory_id", "user_id", F.unix_seconds("created_at").alias("s"), "E1", F.length(content).alias("n"), causal.markers(content).alias("k"))
    return causal.scan_in_time(z).withColumn("score", F.round("score", 6))
