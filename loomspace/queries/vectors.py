"""Scalar functions over vectors, and records of a memory's spaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import retrieval
from ..plans import weights as ws
from ..sources import quantisation
from ..sources import tables as t
from . import register

#: memories with their slices
M = """WITH m AS (SELECT vec_id AS memory_id, label, embedding::DOUBLE[] AS e FROM embeddings)"""


def asked(spark, d):
    """The stated query set: every memory whose id is divisible by 100."""
    return t.vectors(spark, d).filter("memory_id % 100 = 0").select(F.col("memory_id").alias("query_id"), F.col("E1").alias("q"))


def near(spark, d):
    """Every memory beside the one with the next id."""
    m = t.vectors(spark, d)
    return m.join(m.select((F.col("memory_id") - 1).alias("memory_id"), F.col("E1").alias("n")), "memory_id")


NEXT = M + ", p AS (SELECT a.memory_id, a.e AS a, b.e AS b FROM m a JOIN m b ON b.memory_id = a.memory_id + 1)"


@register("vector_similarities", NEXT + """ SELECT memory_id, round(list_cosine_similarity(a, b), 6) AS cosine_raw, round((list_cosine_similarity(a, b) + 1) / 2, 6) AS cosine,
 round(list_dot_product(a, b), 6) AS dot, round(list_distance(a, b), 6) AS euclidean, round(greatest(0, least(1, (2 - list_distance(a, b)) / 2)), 6) AS from_distance,
 round(sqrt(list_dot_product(a, a)), 6) AS norm FROM p""")  # fmt: skip
def similarities(spark, d):
    a, b = F.col("E1"), F.col("n")
    return near(spark, d).select("memory_id", *(F.round(c, 6).alias(n) for n, c in {"cosine_raw": v.cosine_raw(a, b), "cosine": v.cosine(a, b), "dot": v.dot(a, b), "euclidean": v.euclidean(a, b), "from_distance": v.from_distance(v.euclidean(a, b)), "norm": v.norm(a)}.items()))


@register("vector_normalise", M + " SELECT memory_id, round(list_sum(list_transform(e, lambda x: (x / sqrt(list_dot_product(e, e))) ** 2)), 6) AS energy, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first FROM m")
def normalise(spark, d):
    n = t.vectors(spark, d).withColumn("u", v.normalised(F.col("E1")))
    return n.select("memory_id", F.round(v.dot(F.col("u"), F.col("u")), 6).alias("energy"), F.round(F.col("u")[0], 6).alias("first"))


TOKENS = "list_transform(range(0, 4), lambda i: {0}[i * 16 + 1 : i * 16 + 16])"
_MAXSIM = "list_avg(list_transform({q}, lambda x: list_max(list_transform({d}, lambda y: (list_cosine_similarity(x, y) + 1) / 2))))"


def tokens(c):
    """Four token vectors of 16 dimensions stand in for a token matrix."""
    return F.array(*(F.slice(c, 1 + 16 * k, 16) for k in range(4)))


@register("max_sim", NEXT.replace("a.e AS a, b.e AS b", f"{TOKENS.format('a.e')} AS a, {TOKENS.format('b.e')} AS b") + f" SELECT memory_id, round({_MAXSIM.format(q='a', d='b')}, 6) AS max_sim, round(({_MAXSIM.format(q='a', d='b')} + {_MAXSIM.format(q='b', d='a')}) / 2, 6) AS symmetric FROM p")
def max_sim(spark, d):
    p = near(spark, d).select("memory_id", tokens(F.col("E1")).alias("a"), tokens(F.col("n")).alias("b"))
    return p.select("memory_id", F.round(v.max_sim(F.col("a"), F.col("b")), 6).alias("max_sim"), F.round(v.symmetric_max_sim(F.col("a"), F.col("b")), 6).alias("symmetric"))


@register("token_alignments", NEXT.replace("a.e AS a, b.e AS b", f"{TOKENS.format('a.e')} AS a, {TOKENS.format('b.e')} AS b") + """, x AS (SELECT memory_id, i, j, (list_cosine_similarity(a[i + 1], b[j + 1]) + 1) / 2 AS sim FROM p, range(4) r(i), range(4) s(j))
 SELECT memory_id, i AS query_token, arg_max(j, sim) AS doc_token, round(max(sim), 6) AS sim FROM x GROUP BY memory_id, i""")  # fmt: skip
def alignments(spark, d):
    p = near(spark, d).select("memory_id", F.posexplode(tokens(F.col("E1"))).alias("query_token", "a"), tokens(F.col("n")).alias("b"))
    x = p.select("memory_id", "query_token", "a", F.posexplode("b").alias("doc_token", "y")).withColumn("sim", v.cosine(F.col("a"), F.col("y")))
    return x.groupBy("memory_id", F.col("query_token").cast("long").alias("query_token")).agg(F.max_by("doc_token", "sim").cast("long").alias("doc_token"), F.round(F.max("sim"), 6).alias("sim"))


@register("fingerprint_norms", M + """, s AS (SELECT memory_id, unnest(['E1', 'E5_cause', 'E5_effect', 'E7', 'E8_source', 'E8_target', 'E9', 'E10_paraphrase', 'E10_context', 'E11']) AS space,
 unnest([e, e[1:16], e[17:32], e[1:16], e[33:48], e[49:64], e[17:32], e[33:48], e[49:64], e[49:64]]) AS x FROM m) SELECT memory_id, space, len(x)::BIGINT AS dim, round(sqrt(list_dot_product(x, x)), 6) AS norm, len(list_filter(x, lambda y: y <> 0))::BIGINT AS nonzero FROM s""")  # fmt: skip
def norms(spark, d):
    names = list(t.SLICES)
    x = t.vectors(spark, d).select("memory_id", F.explode(F.array(*(F.struct(F.lit(n).alias("space"), t.part(n).alias("x")) for n in names))).alias("s")).select("memory_id", "s.*")
    return x.select("memory_id", "space", F.size("x").cast("long").alias("dim"), F.round(v.norm(F.col("x")), 6).alias("norm"), F.size(F.filter("x", lambda y: y != 0)).cast("long").alias("nonzero"))


@register("fingerprint_validation", M + " SELECT memory_id, len(e) = 64 AS dimension_ok, list_bool_and(list_transform(e, lambda x: NOT isnan(x) AND NOT isinf(x))) AS finite, list_dot_product(e, e) > 0 AS nonzero FROM m")
def validation(spark, d):
    e = F.col("E1")
    finite = F.forall(e, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))
    return t.vectors(spark, d).select("memory_id", (F.size(e) == 64).alias("dimension_ok"), finite.alias("finite"), (v.dot(e, e) > 0).alias("nonzero"))


@register("embedder_indexes", M + """, s AS (SELECT memory_id, unnest(['E1', 'E7', 'E9', 'E11']) AS space, unnest([e, e[1:16], e[17:32], e[49:64]]) AS x FROM m)
 SELECT space, count(*) AS n, max(len(x))::BIGINT AS dim, round(avg(sqrt(list_dot_product(x, x))), 6) AS mean_norm FROM s GROUP BY space""")  # fmt: skip
def indexes(spark, d):
    s = t.vectors(spark, d).select(F.explode(F.array(*(F.struct(F.lit(n).alias("space"), t.part(n).alias("x")) for n in ("E1", "E7", "E9", "E11")))).alias("s")).select("s.*")
    return s.groupBy("space").agg(F.count("*").alias("n"), F.max(F.size("x")).cast("long").alias("dim"), F.round(F.avg(v.norm(F.col("x"))), 6).alias("mean_norm"))


@register("direction_inference", M + " SELECT memory_id, CASE WHEN list_var_pop(e[1:16]) > 1.05 * list_var_pop(e[17:32]) THEN 'cause' WHEN list_var_pop(e[17:32]) > 1.05 * list_var_pop(e[1:16]) THEN 'effect' ELSE 'unknown' END AS direction FROM m")
def directions(spark, d):
    return t.vectors(spark, d).select("memory_id", retrieval.direction(F.col("E1")).alias("direction"))


@register("quantisation_error")
def quantised(spark, d):
    """Scalar, float8, binary and product quantisation of every memory, with their relative errors."""
    return quantisation.errors(t.vectors(spark, d), "E1")


@register("quantise_scalar", M + """, b AS (SELECT memory_id, e, list_min(e) AS lo, list_max(e) AS hi FROM m), r AS (SELECT memory_id, e, list_transform(e, lambda x: lo + round((x - lo) / (hi - lo) * 255) * (hi - lo) / 255) AS y FROM b)
 SELECT memory_id, round(sqrt(list_distance(e, y) ** 2 / 64), 6) AS rmse FROM r""")  # fmt: skip
def scalar(spark, d):
    b = t.vectors(spark, d).withColumn("lo", F.array_min("E1")).withColumn("hi", F.array_max("E1"))
    span = F.col("hi") - F.col("lo")
    y = F.transform("E1", lambda x: F.col("lo") + F.round((x - F.col("lo")) / span * 255) * span / 255)
    return b.select("memory_id", F.round(v.rmse(F.col("E1"), y), 6).alias("rmse"))


@register("token_pruning", M + """, x AS (SELECT memory_id, i + 1 AS pos, sqrt(list_dot_product(e[i * 16 + 1 : i * 16 + 16], e[i * 16 + 1 : i * 16 + 16])) AS importance FROM m, range(4) r(i)), y AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY importance DESC, pos) AS n FROM x)
 SELECT memory_id, pos::BIGINT AS pos, round(importance, 6) AS importance FROM y WHERE n <= 2""")  # fmt: skip
def pruned(spark, d):
    x = t.vectors(spark, d).withColumn("t", F.transform(tokens(F.col("E1")), lambda y, k: F.struct((-v.norm(y)).alias("n"), (k + 1).alias("pos"))))
    return x.select("memory_id", F.explode(F.slice(F.array_sort("t"), 1, 2)).alias("t")).select("memory_id", F.col("t.pos").cast("long").alias("pos"), F.round(-F.col("t.n"), 6).alias("importance"))


_W = ", ".join(f"('{p}', '{s}', {w!r})" for p, x in ws.PROFILES.items() for s, w in x.items())


@register("weight_profiles", f"WITH w(profile, space, w) AS (VALUES {_W}) SELECT profile, count(*) AS n_spaces, count(*) FILTER (WHERE w > 0) AS active, round(sum(w::DOUBLE), 6) AS total, abs(sum(w::DOUBLE) - 1) <= 0.01 AND min(w) >= 0 AND max(w) <= 1 AS valid, max_by(space, (w::DOUBLE, space)) AS main FROM w GROUP BY profile")
def profiles(spark, d):
    w = ws.table(spark)
    ok = (F.abs(F.sum("w") - 1) <= 0.01) & (F.min("w") >= 0) & (F.max("w") <= 1)
    return w.groupBy("profile").agg(F.count("*").alias("n_spaces"), F.count(F.when(F.col("w") > 0, 1)).alias("active"), F.round(F.sum("w"), 6).alias("total"), ok.alias("valid"), F.max_by("space", F.struct("w", "space")).alias("main"))


@register("weights_without_space", f"WITH w(profile, space, w) AS (VALUES {_W}), l AS (SELECT profile, space, w::DOUBLE AS w, sum(w::DOUBLE) OVER (PARTITION BY profile) AS s, sum(CASE WHEN space <> 'E11' THEN w::DOUBLE ELSE 0 END) OVER (PARTITION BY profile) AS rest FROM w) SELECT profile, space, round(CASE WHEN space = 'E11' THEN 0 ELSE w * s / rest END, 6) AS w FROM l")
def without(spark, d):
    return ws.table(spark, {p: ws.without(x, "E11") for p, x in ws.PROFILES.items()}).withColumn("w", F.round("w", 6))
