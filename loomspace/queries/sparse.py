"""Sparse recall over document terms, keyword search and text functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import fusion, retrieval, sparse
from ..plans.chunks import chunked
from ..session import written
from ..sources import tables as t
from ..sources.postings import PostingStore
from . import register
from .indexes import folder
from .search import SIM, TOP, shown
from .vectors import asked

P = "WITH d AS (SELECT doc_id AS memory_id, text FROM documents), tk AS (SELECT memory_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM d), post AS (SELECT memory_id, term, count(*)::DOUBLE AS w FROM tk GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY term), n AS (SELECT count(*)::DOUBLE AS n FROM d), q AS (SELECT memory_id AS query_id, term, w AS q FROM post WHERE memory_id % 100 = 0)"


def docs(spark, d):
    return t.spread(t.read(spark, d, "documents")).select(F.col("doc_id").alias("memory_id"), F.col("text").alias("content"))


def parts(spark, d):
    x = docs(spark, d)
    post = t.spread(written(sparse.postings(x)))  # read for the queries, the frequencies and the recall
    return post, post.filter("memory_id % 100 = 0").select(F.col("memory_id").alias("query_id"), "term", "w"), x.count()


def stated(x):
    """Terms of the stated set's documents."""
    return sparse.postings(x.filter("memory_id % 100 = 0")).select(F.col("memory_id").alias("query_id"), "term", "w")


@register("postings", P + " SELECT term, count(*) AS df, sum(w)::DOUBLE AS total FROM post GROUP BY term HAVING count(*) >= 2")
def postings(spark, d):
    return sparse.postings(docs(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("w").alias("total")).filter("df >= 2")


_TERM = {"bm25": "q * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)", "bm25_norm": "q * w / norm * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)", "tfidf": "q * w * (ln((n + 1) / (df + 1)) + 1)", "overlap": "1.0::DOUBLE"}
for _how in _TERM:
    _skip = " WHERE df / n <= 0.9 OR n < 1000" if _how == "tfidf" else ""

    @register(f"sparse_recall_{_how}", P + f", nm AS (SELECT memory_id, sqrt(sum(w * w)) AS norm FROM post GROUP BY ALL), x AS (SELECT query_id, memory_id, round(sum({_TERM[_how]}), 6) AS score FROM q JOIN df USING (term) JOIN post USING (term) JOIN nm USING (memory_id), n{_skip or ' WHERE true'} AND memory_id <> query_id GROUP BY ALL)".replace("n < 1000 AND", "n < 1000) AND").replace("WHERE df / n", "WHERE (df / n") + TOP.format("x", 10))
    def recall(spark, d, how=_how):
        x = docs(spark, d)
        return shown(fusion.top(sparse.best(stated(x), x, how, 10, x.count()), 10))


@register("keyword_scores", P + ", s AS (SELECT query_id, memory_id, sum(least(q, w)) AS low, count(*) AS n_shared FROM q JOIN post USING (term) WHERE memory_id <> query_id GROUP BY ALL), a AS (SELECT query_id, sum(q) AS a FROM q GROUP BY ALL), b AS (SELECT memory_id, sum(w) AS b FROM post GROUP BY ALL), x AS (SELECT query_id, memory_id, low / (a + b - low) AS score FROM s JOIN a USING (query_id) JOIN b USING (memory_id))" + TOP.format("x", 10))
def keyword(spark, d):
    x = docs(spark, d)
    return shown(fusion.top(sparse.best(stated(x), x, "keyword", 10), 10))


@register("search_by_keywords", P + f", m AS (SELECT vec_id AS memory_id, embedding::DOUBLE[] AS e FROM embeddings), qv AS (SELECT memory_id AS query_id, e AS q FROM m WHERE memory_id % 100 = 0), w1 AS (SELECT query_id, memory_id, q, e FROM qv JOIN m ON memory_id <> query_id), e1 AS (SELECT query_id, memory_id, {SIM['E1']} AS e1 FROM w1), l1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY e1 DESC, memory_id) AS n FROM e1) WHERE n <= 20), s AS (SELECT query_id, memory_id, sum(least(q, w)) AS low FROM q JOIN post USING (term) WHERE memory_id <> query_id GROUP BY ALL), a AS (SELECT query_id, sum(q) AS a FROM q GROUP BY ALL), b AS (SELECT memory_id, sum(w) AS b FROM post GROUP BY ALL), k AS (SELECT query_id, memory_id, low / (a + b - low) AS e6 FROM s JOIN a USING (query_id) JOIN b USING (memory_id)), l6 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY e6 DESC, memory_id) AS n FROM k) WHERE n <= 20), x AS (SELECT coalesce(l1.query_id, l6.query_id) AS query_id, coalesce(l1.memory_id, l6.memory_id) AS memory_id, 0.7 * coalesce(e1, 0) + 0.3 * coalesce(e6, 0) AS score FROM l1 FULL JOIN l6 ON l1.query_id = l6.query_id AND l1.memory_id = l6.memory_id)" + TOP.format("x", 10))
def by_keywords(spark, d):
    """Dense and keyword candidates, joined in full and blended .7 / .3."""
    x = docs(spark, d)
    a = retrieval.single_space(asked(spark, d), t.vectors(spark, d), "E1", 20).select("query_id", "memory_id", F.col("score").alias("e1"))
    b = fusion.top(sparse.best(stated(x), x, "keyword", 20), 20).select("query_id", "memory_id", F.col("score").alias("e6"))
    x = a.join(b, ["query_id", "memory_id"], "full").select("query_id", "memory_id", (0.7 * F.coalesce("e1", F.lit(0.0)) + 0.3 * F.coalesce("e6", F.lit(0.0))).alias("score"))
    return shown(fusion.top(x, 10))


EXPANSIONS = {"the": ["that", "this"], "de": ["la", "les"], "und": ["der"]}  # stands in for a learned expansion table


@register("search_by_expansion", P + ", ex(term, extra) AS (VALUES ('the', 'that'), ('the', 'this'), ('de', 'la'), ('de', 'les'), ('und', 'der')), q2 AS (SELECT query_id, term, max(q) AS q FROM (SELECT query_id, term, q FROM q UNION ALL SELECT query_id, extra, 0.5 * q FROM q JOIN ex USING (term)) GROUP BY ALL), x AS (SELECT query_id, memory_id, round(sum(q * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)), 6) AS score FROM q2 JOIN df USING (term) JOIN post USING (term), n WHERE memory_id <> query_id GROUP BY ALL)" + TOP.format("x", 10))
def by_expansion(spark, d):
    x = docs(spark, d)
    q = stated(x)
    extra = spark.createDataFrame([(a, b) for a, bs in EXPANSIONS.items() for b in bs], "term string, extra string")
    more = q.join(F.broadcast(extra), "term").select("query_id", F.col("extra").alias("term"), (0.5 * F.col("w")).alias("w"))
    return shown(fusion.top(sparse.best(q.union(more).groupBy("query_id", "term").agg(F.max("w").alias("w")), x, "bm25", 10, x.count()), 10))


@register("sparse_similarity", P + ", a AS (SELECT memory_id, term, w FROM post), p AS (SELECT x.memory_id, sum(x.w * y.w) AS dot, count(*) AS shared FROM a x JOIN a y ON x.term = y.term AND y.memory_id = x.memory_id + 1 GROUP BY ALL), n2 AS (SELECT memory_id, sqrt(sum(w * w)) AS norm, count(*) AS terms FROM a GROUP BY ALL) SELECT p.memory_id, round(dot, 6) AS dot, round(dot / (x.norm * y.norm), 6) AS cosine, round(shared::DOUBLE / (x.terms + y.terms - shared), 6) AS jaccard FROM p JOIN n2 x ON x.memory_id = p.memory_id JOIN n2 y ON y.memory_id = p.memory_id + 1")
def sparse_similarity(spark, d):
    """Each document beside the next one, whose terms meet in the row."""
    words = lambda c: F.flatten(F.transform(c, tx.words)).alias(c)
    p = sparse.overlaps(t.beside(docs(spark, d), "memory_id", "content").select("memory_id", words("own"), words("next")))
    return p.select("memory_id", F.round("dot", 6).alias("dot"), F.round(F.col("dot") / (F.col("norm") * F.col("norm2")), 6).alias("cosine"), F.round(F.col("shared") / (F.col("terms") + F.col("terms2") - F.col("shared")), 6).alias("jaccard"))


@register("text_functions", "SELECT doc_id AS memory_id, ceil(len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) * 1.3::DOUBLE)::BIGINT AS tokens, length(array_to_string(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')[1:50], ' ')) AS summary_chars, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS short, sha256(text) AS content_hash FROM documents")
def functions(spark, d):
    c = F.col("content")
    return docs(spark, d).select("memory_id", tx.token_estimate(c).alias("tokens"), F.length(tx.summary(c)).cast("long").alias("summary_chars"), tx.truncated(c).alias("short"), F.sha2(c, 256).alias("content_hash"))


@register("text_chunks")
def chunks(spark, d):
    """Chunks of 200 words, 50 of them shared, ended at a sentence where one ends in the last fifth."""
    return chunked(docs(spark, d), "memory_id", "content")


@register("keyword_boosts", "WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS word FROM documents) SELECT word, round(greatest(0.5, least(2.0, 1.0 + CASE WHEN regexp_matches(word, '/|\\\\|::') THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(word, '^v?[0-9]+\\.[0-9]+') THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(word, '^[A-Z]{2,}$') THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(word, '^[A-Z][a-z]+$') THEN 0.2 ELSE 0 END - CASE WHEN lower(word) IN (" + ", ".join(f"'{x}'" for x in tx.COMMON) + ") THEN 0.3 ELSE 0 END))::DOUBLE, 6) AS boost FROM w WHERE word <> ''")
def boosts(spark, d):
    w = docs(spark, d).select(F.explode(F.split("content", "\\s+")).alias("word")).filter("word <> ''").distinct()
    return w.select("word", F.round(tx.keyword_boost(F.col("word")), 6).alias("boost"))


@register("keyword_tie_breaker", P + ", s AS (SELECT query_id, memory_id, sum(least(q, w)) AS low, count(*) AS n_shared FROM q JOIN post USING (term) WHERE memory_id <> query_id GROUP BY ALL), a AS (SELECT query_id, sum(q) AS a, count(*) AS na FROM q GROUP BY ALL), b AS (SELECT memory_id, sum(w) AS b FROM post GROUP BY ALL), x AS (SELECT query_id, memory_id, low / (a + b - low) AS base, n_shared::DOUBLE / na AS share FROM s JOIN a USING (query_id) JOIN b USING (memory_id)), g AS (SELECT *, lag(base) OVER (PARTITION BY query_id ORDER BY base DESC, memory_id) - base AS gap FROM x), y AS (SELECT query_id, memory_id, base + CASE WHEN gap < 0.01 THEN 0.05 * share ELSE 0 END AS score FROM g)" + TOP.format("y", 10))
def tie_breaker(spark, d):
    """Scores within .01 of the one before gain up to .05 by their share of query terms."""
    x = docs(spark, d)
    q = stated(x)
    s = sparse.best(q, x, "keyword", 10, bonus=0.05).join(F.broadcast(q.groupBy("query_id").agg(F.count("*").alias("na"))), "query_id")
    gap = F.lag("score").over(W.partitionBy("query_id").orderBy(F.desc("score"), "memory_id")) - F.col("score")
    s = s.withColumn("gap", gap).withColumn("score", F.col("score") + F.when(F.col("gap") < 0.01, 0.05 * F.col("n_shared") / F.col("na")).otherwise(0.0))
    return shown(fusion.top(s.select("query_id", "memory_id", "score"), 10))


@register("code_query_types", "SELECT doc_id AS memory_id, CASE WHEN contains(text, 'fn ') OR contains(text, 'def ') OR contains(text, 'class ') OR contains(text, 'import ') OR contains(text, 'return ') OR contains(text, '->') OR contains(text, '=>') OR contains(text, '::') OR contains(text, '();') OR contains(text, '{}') THEN 'code2code' WHEN regexp_matches(lower(text), '\\b(function|code|implement|method|class)\\b') THEN 'text2code' ELSE 'non_code' END AS kind FROM documents")
def code_types(spark, d):
    return docs(spark, d).select("memory_id", tx.code_query_type(F.col("content")).alias("kind"))


@register("stored_recall_bm25", P.replace("FROM documents)", "FROM documents WHERE doc_id % 10 <> 3)", 1) + f", x AS (SELECT query_id, memory_id, round(sum({_TERM['bm25']}), 6) AS score FROM q JOIN df USING (term) JOIN post USING (term), n WHERE memory_id <> query_id GROUP BY ALL)" + TOP.format("x", 10))
def stored_recall(spark, d):
    """BM25 recall from a stored index, after a batch of all documents, one that mends some and one that deletes a tenth."""
    store, x = PostingStore(spark, folder(spark)), docs(spark, d)
    store.upsert(x.withColumn("content", F.when(F.col("memory_id") % 7 == 0, F.lit("wrong words")).otherwise(F.col("content"))), 0)
    store.upsert(x.filter("memory_id % 7 = 0"), 1)
    store.upsert(x.filter("memory_id % 10 = 3").withColumn("content", F.lit(None).cast("string")), 2)
    asked_ = sparse.postings(x.filter("memory_id % 100 = 0")).select(F.col("memory_id").alias("query_id"), "term", "w")
    return shown(fusion.top(store.best(written(asked_), 10), 10))
