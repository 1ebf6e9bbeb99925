"""Profile-level services over the 13 leading dimensions, and hyperdimensional codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hyper
from ..operators import teleology as te
from ..sources import tables as t
from . import register

P = "WITH p AS (SELECT vec_id AS memory_id, list_transform(embedding[1:13]::DOUBLE[], lambda x: (x + 1) / 2) AS p FROM embeddings), n AS (SELECT a.memory_id, a.p AS a, b.p AS b FROM p a JOIN p b ON b.memory_id = a.memory_id + 1)"
_G = lambda c: "[" + ", ".join("(" + " + ".join(f"{c}[{k + 1}]" for k in ks) + f") / {len(ks)}" for ks in te.GROUPS.values()) + "]"
_C = lambda c: "[" + ", ".join(f"sqrt(greatest(0, {c}[{i + 1}] * {c}[{j + 1}]))" for i in range(13) for j in range(i + 1, 13)) + "]"


def profiles(spark, d):
    """Thirteen alignments in [0, 1] from the leading dimensions stand in for the 13 spaces' own."""
    return t.vectors(spark, d).select("memory_id", F.transform(F.slice("E1", 1, 13), lambda x: (x + 1) / 2).alias("profile"))


@register("profile_similarities", P + f" SELECT memory_id, round(list_cosine_similarity(a, b), 6) AS cosine, round(1 / (1 + list_distance(a, b)), 6) AS euclidean, round(0.6 * list_cosine_similarity({_G('a')}, {_G('b')}) + 0.4 * list_cosine_similarity(a, b), 6) AS \"grouped\", round(0.75 * list_cosine_similarity({_C('a')}, {_C('b')}) + 0.25 * list_cosine_similarity(a, b), 6) AS correlated FROM n")
def similarities(spark, d):
    p = profiles(spark, d)
    n = p.join(p.select((F.col("memory_id") - 1).alias("memory_id"), F.col("profile").alias("b")), "memory_id")
    return n.select("memory_id", *(F.round(c, 6).alias(k) for k, c in te.strategy_scores(F.col("profile"), F.col("b")).items()))


_RUNS = " + ".join("(" + " + ".join(f"p[{k + 1}]" for k in range(a, b + 1)) + f") / {b - a + 1}" for a, b in te.RUNS)


@register("profile_fusion", P + f", f AS (SELECT memory_id, list_sum(p) / 13 AS mean, ({_RUNS}) / 4 AS runs, len(list_filter(p, lambda x: x > 0.1)) / 13.0::DOUBLE AS share FROM p) SELECT memory_id, round(mean, 6) AS mean, round(runs, 6) AS runs, round((0.5 * mean + 0.5 * runs) * share, 6) AS confidence FROM f")
def fusion(spark, d):
    mean, runs, confidence = te.fused(F.col("profile"))
    return profiles(spark, d).select("memory_id", F.round(mean, 6).alias("mean"), F.round(runs, 6).alias("runs"), F.round(confidence, 6).alias("confidence"))


_GRP = ", ".join(f"('{n}', {[k + 1 for k in ks]!r})" for n, ks in te.GROUPS.items())


@register("group_alignments", P + f", g(grp, ks) AS (VALUES {_GRP}), x AS (SELECT memory_id, grp, p[unnest(ks)] AS x FROM p, g) SELECT memory_id, grp, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation, round(1 / (1 + stddev_pop(x)), 6) AS coherence FROM x GROUP BY memory_id, grp")
def groups(spark, d):
    x = profiles(spark, d).select("memory_id", F.explode(te.group_alignments(F.col("profile"))).alias("g")).select("memory_id", "g.*")
    return x.select("memory_id", "grp", *(F.round(c, 6).alias(c) for c in ("mean", "deviation", "coherence")))


@register("group_aggregators", P + ", x AS (SELECT memory_id, unnest(p[2:4]) AS x FROM p) SELECT memory_id, round(avg(x), 6) AS average, round(max(x), 6) AS maximum, round(min(x), 6) AS minimum, round(exp(avg(ln(greatest(1e-12, x)))), 6) AS geometric, round(sqrt(avg(x * x)), 6) AS rms FROM x GROUP BY memory_id")
def aggregators(spark, d):
    return profiles(spark, d).select("memory_id", *(F.round(c, 6).alias(k) for k, c in te.group_aggregates(F.col("profile"), te.GROUPS["temporal"]).items()))


@register("resolution_levels", P + f", g AS (SELECT memory_id, {_G('p')} AS g FROM p), dm AS (SELECT memory_id, (g[1] + g[6]) / 2 AS knowledge, (g[2] + g[3]) / 2 AS time, (g[4] + g[5]) / 2 AS relations FROM g) SELECT memory_id, round(knowledge, 6) AS knowledge, round(time, 6) AS time, round(relations, 6) AS relations, round((knowledge + time + relations) / 3, 6) AS whole FROM dm")
def levels(spark, d):
    p = F.col("profile")
    g = {n: sum((p[k] for k in ks), F.lit(0.0)) / len(ks) for n, ks in te.GROUPS.items()}
    domains, whole = te.resolution(g)
    return profiles(spark, d).select("memory_id", *(F.round(c, 6).alias(n) for n, c in domains.items()), F.round(whole, 6).alias("whole"))


@register("correlation_pairs", P + ", i AS (SELECT unnest(range(1, 14)) AS i), j AS (SELECT unnest(range(1, 14)) AS j) SELECT memory_id, i, j, round(sqrt(greatest(0, p[i] * p[j])), 6) AS r FROM p, i, j WHERE i < j AND sqrt(greatest(0, p[i] * p[j])) >= 0.6")
def pairs(spark, d):
    """Geometric means of every two alignments, those below .6 left out."""
    x = profiles(spark, d)
    a = x.select("memory_id", "profile", F.posexplode("profile").alias("i", "a"))
    b = a.select("memory_id", (F.col("i") + 1).alias("i"), "a", F.posexplode("profile").alias("j", "b")).withColumn("j", F.col("j") + 1).filter("i < j")
    r = F.sqrt(F.greatest(F.lit(0.0), F.col("a") * F.col("b")))
    return b.select("memory_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round(r, 6).alias("r"), r.alias("raw")).filter("raw >= 0.6").drop("raw")


@register("multi_utl", P + " SELECT memory_id, round(1 / (1 + exp(-2 * (0.5 * p[1] + 0.5 * p[2]) * (0.5 * p[3] + 0.5 * p[4]) * p[5] * cos(p[6]))), 6) AS score FROM p")
def utl(spark, d):
    p = F.col("profile")
    s = te.multi_utl([(0.5, p[0]), (0.5, p[1])], [(0.5, p[2]), (0.5, p[3])], p[4], p[5])
    return profiles(spark, d).select("memory_id", F.round(s, 6).alias("score"))


@register("tucker_cores")
def tucker(spark, d):
    return te.tucker(profiles(spark, d))


@register("hyperdimensional_similarity")
def hyperdimensional(spark, d):
    """Codes of every document, compared with the next document's."""
    c = hyper.coded(t.spread(t.read(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")
    n = t.beside(c, "doc_id", "code").select("doc_id", F.explode("own").alias("code"), "next").select("doc_id", "code", F.explode("next").alias("next"))
    return n.select("doc_id", F.round(hyper.similarity(F.col("code"), F.col("next")), 6).alias("similarity"))


@register("profile_match", "SELECT doc_id, CASE WHEN c >= k AND c >= t AND c > 0 THEN 'code' WHEN k >= t AND k > 0 THEN 'causal' WHEN t > 0 THEN 'temporal' ELSE 'general' END AS profile, round(0.2 * greatest(c, k, t), 6)::DOUBLE AS score FROM (SELECT doc_id, contains(lower(text), 'code')::INT + contains(lower(text), 'function')::INT + contains(lower(text), 'error')::INT AS c, contains(lower(text), 'because')::INT + contains(lower(text), 'cause')::INT + contains(lower(text), 'reason')::INT AS k, contains(lower(text), 'when')::INT + contains(lower(text), 'time')::INT + contains(lower(text), 'recent')::INT AS t FROM documents)")
def match(spark, d):
    """The profile whose keywords a text holds most of, .2 a keyword."""
    low = F.lower("text")
    n = lambda *ws: sum((low.contains(w).cast("int") for w in ws), F.lit(0))
    x = t.read(spark, d, "documents").select("doc_id", n("code", "function", "error").alias("c"), n("because", "cause", "reason").alias("k"), n("when", "time", "recent").alias("t"))
    name = F.when(F.expr("c >= k and c >= t and c > 0"), "code").when(F.expr("k >= t and k > 0"), "causal").when(F.col("t") > 0, "temporal").otherwise("general")
    return x.select("doc_id", name.alias("profile"), F.round(0.2 * F.greatest("c", "k", "t"), 6).alias("score"))



_R = P.replace(", n AS (", ", q AS (SELECT memory_id AS query_id, p AS a FROM p WHERE memory_id % 100 = 0), w AS (SELECT query_id, memory_id, a, p AS b FROM q JOIN p ON memory_id <> query_id), n AS (") + f", s AS (SELECT query_id, memory_id, b, list_cosine_similarity(a, b) AS profile, list_cosine_similarity({_C('a')}, {_C('b')}) AS correlation, list_cosine_similarity({_G('a')}, {_G('b')}) AS grouped FROM w), x AS (SELECT *, round(0.5 * profile + 0.3 * correlation + 0.2 * grouped, 12) AS score FROM s)"
_SHOWN = " SELECT query_id, memory_id, rank, round(score, 6) AS score, round(profile, 6) AS profile, round(correlation, 6) AS correlation, round(grouped, 6) AS \"grouped\" FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) - 1 AS rank FROM x WHERE score >= 0.3{}) WHERE rank < 10"


def retrieved(spark, d, group=None):
    p = profiles(spark, d)
    asked = p.filter("memory_id % 100 = 0").select(F.col("memory_id").alias("query_id"), "profile")
    return te.retrieved(asked, p, group=group).select("query_id", "memory_id", F.col("rank").cast("long").alias("rank"), *(F.round(c, 6).alias(c) for c in ("score", "profile", "correlation", "grouped")))


@register("profile_retrieval", _R + _SHOWN.format(""))
def profile_retrieval(spark, d):
    """The best ten memories by profile, correlations and groups."""
    return retrieved(spark, d)


@register("profile_retrieval_causal", _R + f", g AS (SELECT *, {_G('b')} AS gs FROM x)" + _SHOWN.format(" AND (list_position(gs, list_max(gs)) = 3 OR gs[3] > 0.6)").replace("FROM x WHERE", "FROM g WHERE"))
def profile_retrieval_causal(spark, d):
    """The best ten among memories that are causal above all, or strongly."""
    return retrieved(spark, d, "causal")
