"""Entities, their graph and translation-based scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as v
from ..operators import entities as en
from ..operators import retrieval
from ..session import written
from ..sources import tables as t
from . import register
from .search import PAIRS, SIM, TOP, best, shown
from .sparse import docs
from .vectors import M

_COMMON = ", ".join(f"'{x}'" for x in tx.COMMON)
_KNOWN = ", ".join(f"('{k}', '{x}')" for k, x in en.KNOWN.items())
E = f"WITH raw AS (SELECT doc_id AS memory_id, regexp_replace(unnest(regexp_split_to_array(text, '\\s+')), '^[^\\p{{L}}\\p{{N}}_-]+|[^\\p{{L}}\\p{{N}}_-]+$', '', 'g') AS w FROM documents), en AS (SELECT DISTINCT memory_id, lower(w) AS entity FROM raw WHERE length(w) >= 2 AND lower(w) NOT IN ({_COMMON}) AND (regexp_matches(w, '^\\p{{Lu}}') OR regexp_matches(w, '[_-]'))), kn(entity, entity_type) AS (VALUES {_KNOWN}), n AS (SELECT count(*) AS n FROM documents)"


@register("extract_entities", E + " SELECT memory_id, entity, coalesce(entity_type, 'unknown') AS entity_type, CASE WHEN entity_type IS NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM en LEFT JOIN kn USING (entity)")
def extract(spark, d):
    return en.extract(docs(spark, d))


@register("entity_graph", E + " SELECT a.entity AS a, b.entity AS b, count(*) AS n, round(count(*)::DOUBLE / max(n.n), 6) AS weight FROM en a JOIN en b ON a.memory_id = b.memory_id AND a.entity < b.entity, n GROUP BY ALL")
def entity_graph(spark, d):
    x = docs(spark, d)
    return en.cooccurrence(en.extract(x), x.count()).select("a", "b", "n", F.round("weight", 6).alias("weight"))


@register("entity_importance", E + " SELECT entity, count(*) AS n, round(ln(1 + count(*)) / 10, 6) AS importance FROM en GROUP BY entity HAVING count(*) >= 2")
def importance(spark, d):
    g = en.extract(docs(spark, d)).groupBy("entity").agg(F.count("*").alias("n")).filter("n >= 2")
    return g.withColumn("importance", F.round(F.log1p("n") / 10, 6))


@register("search_by_entities", PAIRS + ", " + E[5:] + f", sets AS (SELECT memory_id, list(entity) AS es FROM en GROUP BY memory_id), s0 AS (SELECT query_id, memory_id, {SIM['E1']} AS e1, {SIM['E11']} AS e11 FROM w), j AS (SELECT query_id, s0.memory_id, e1, e11, len(list_intersect(a.es, b.es))::DOUBLE / len(list_distinct(list_concat(a.es, b.es))) AS jac FROM s0 JOIN sets a ON a.memory_id = query_id JOIN sets b ON b.memory_id = s0.memory_id WHERE list_has_any(a.es, b.es)), x AS (SELECT query_id, memory_id, (0.30 * e1 + 0.35 * e11 + 0.35 * jac) * CASE (e1 >= 0.3)::INT + (e11 >= 0.3)::INT + (jac >= 0.3)::INT WHEN 3 THEN 1.10 WHEN 2 THEN 1.05 ELSE 1 END::DOUBLE AS score FROM j)" + TOP.format("x", 10))
def by_entities(spark, d):
    own = docs(spark, d).select("memory_id", tx.mentions(F.col("content")).alias("es")).filter(F.size("es") > 0)
    m = written(t.vectors(spark, d).select("memory_id", "E1").join(own, "memory_id"))  # read for the queries and by each block of them
    q = m.filter("memory_id % 100 = 0").select(F.col("memory_id").alias("query_id"), F.col("E1").alias("q"), F.col("es").alias("qs"))
    return shown(retrieval.best(q, m, ("E1", "E11"), en.Shared(), 10))


_REL = ", ".join(f"('{r}', {en.relation_vector(r, 64)!r}::DOUBLE[])" for r in en.RELATIONS)
TR = M + f", rel(name, r) AS (VALUES {_REL}), p AS (SELECT a.memory_id AS head, b.memory_id AS tail, a.e AS h, b.e AS t FROM m a JOIN m b ON b.memory_id = a.memory_id + 1)"
_TE = "-sqrt(list_sum(list_transform(range(1, 65), lambda i: (h[i] + r[i] - t[i]) ** 2)))"


def relations(spark):
    return spark.createDataFrame([(r, en.relation_vector(r, 64)) for r in en.RELATIONS], "name string, r array<double>")


def triples(spark, d):
    m = t.vectors(spark, d)
    p = m.select(F.col("memory_id").alias("head"), F.col("E1").alias("h")).join(m.select((F.col("memory_id") - 1).alias("head"), F.col("memory_id").alias("tail"), F.col("E1").alias("t")), "head")
    return p.crossJoin(F.broadcast(relations(spark)))  # six relations


@register("infer_relationship", TR + ", x AS (SELECT head, tail, name, list_cosine_similarity(list_transform(range(1, 65), lambda i: t[i] - h[i]), r) AS sim FROM p, rel) SELECT head, tail, max_by(name, (round(sim, 12), name)) AS relation, round(max(sim), 6) AS sim FROM x GROUP BY head, tail")
def infer(spark, d):
    sim = v.cosine_raw(F.zip_with("t", "h", lambda a, b: a - b), F.col("r"))
    x = triples(spark, d).withColumn("sim", sim)
    return x.groupBy("head", "tail").agg(F.max_by("name", F.struct(F.round("sim", 12), "name")).alias("relation"), F.round(F.max("sim"), 6).alias("sim"))


@register("validate_knowledge", TR + f", x AS (SELECT head, tail, name AS relation, {_TE} AS s FROM p, rel) SELECT head, tail, relation, round(s, 6) AS score, round(greatest(0, least(1, (s + 15) / 15)), 6) AS confidence, CASE WHEN s > -5 THEN 'valid' WHEN s >= -10 THEN 'uncertain' ELSE 'unlikely' END AS verdict FROM x")
def validate(spark, d):
    s = en.transe(F.col("h"), F.col("r"), F.col("t"))
    x = triples(spark, d).withColumn("s", s)
    return x.select("head", "tail", F.col("name").alias("relation"), F.round("s", 6).alias("score"), F.round(en.confidence(F.col("s")), 6).alias("confidence"), en.verdict(F.col("s")).alias("verdict"))


@register("find_related_entities", M + f", rel(name, r) AS (VALUES {_REL.split('), (')[0]})), x AS (SELECT a.memory_id AS query_id, b.memory_id AS memory_id, {_TE.replace('h[i]', 'a.e[i]').replace('t[i]', 'b.e[i]')} AS score FROM m a JOIN m b ON a.memory_id <> b.memory_id, rel WHERE a.memory_id % 100 = 0)" + TOP.format("x", 10))
def related(spark, d):
    r = np.array(en.relation_vector(next(iter(en.RELATIONS)), 64))

    def score(_, q, m):
        h, x = np.array(q["q"].tolist()) + r, np.array(m["E1"].tolist())
        return -np.sqrt(np.maximum(0, (h * h).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None] - 2 * h @ x.T))

    return shown(best(spark, d, (), score))


@register("entity_types_per_source", E + ", g AS (SELECT source, coalesce(entity_type, 'unknown') AS entity_type, count(*) AS n FROM en LEFT JOIN kn USING (entity) JOIN documents ON doc_id = memory_id GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, entity_type) AS place FROM g")
def per_source(spark, d):
    src = t.read(spark, d, "documents").select(F.col("doc_id").alias("memory_id"), "source")
    g = en.extract(docs(spark, d)).join(src, "memory_id").groupBy("source", "entity_type").agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n"), "entity_type")).cast("long"))
