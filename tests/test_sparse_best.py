"""The best documents by shared terms, kept per task, against the formulas over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from loomspace.catalog import QUERIES
from loomspace.operators import fusion, retrieval, sparse


@pytest.mark.parametrize("how", ["bm25", "bm25_norm", "tfidf", "overlap", "keyword"])
def test_best(spark, monkeypatch, how):
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    monkeypatch.setattr(sparse, "COMMON", 4)  # common and other terms
    monkeypatch.setattr(sparse, "BATCH", 7)
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdefghij", range(10, 0, -1), k=rng.randrange(0, 25))) for _ in range(80)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "memory_id long, content string").repartition(2).persist()
    post = sparse.postings(docs)
    q = post.filter("memory_id % 9 = 0").select(F.col("memory_id").alias("query_id"), "term", "w")
    mine = fusion.top(sparse.best(q, docs, how, 5, len(texts)), 5)
    all_ = sparse.keyword_scores(q, post) if how == "keyword" else sparse.recall(q, post, len(texts), how).withColumn("score", F.round("score", 6))
    own = lambda df: sorted((r.query_id, r["rank"], r.memory_id, round(r.score, 6)) for r in df.collect())
    assert own(mine) == own(fusion.top(all_, 5)) and mine.count() > 20


def test_no_row_for_every_pair_is_shuffled(spark):
    plan = QUERIES["keyword_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("hashpartitioning(")[1:] if "memory_id" in x.split(")")[0]]


@pytest.mark.parametrize("how", ["bm25", "keyword"])
def test_a_scan_serves_several_blocks_and_hands_out_the_best_alone(spark, monkeypatch, how):
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefghij", range(10, 0, -1), k=rng.randrange(1, 25))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "memory_id long, content string").repartition(2).persist()
    q = sparse.postings(docs.filter("memory_id % 25 = 0")).select(F.col("memory_id").alias("query_id"), "term", "w").persist()
    mine = sparse.best(q, docs, how, 5, len(texts))
    assert mine._jdf.queryExecution().analyzed().toString().count("MapInPandas") == 1
    assert mine.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 5 * docs.rdd.getNumPartitions()
    monkeypatch.setattr(sparse, "SCAN", 2)
    own = lambda df: sorted((r.query_id, r["rank"], r.memory_id, round(r.score, 6)) for r in fusion.top(df, 5).collect())
    assert own(sparse.best(q, docs, how, 5, len(texts))) == own(mine)


def test_bonus_of_close_scores_from_few_rows(spark, monkeypatch):
    """Many documents of like scores: as with all rows, though few leave the tasks."""
    from pyspark.sql import Window as W

    monkeypatch.setattr(sparse, "BATCH", 16)
    rng = random.Random(7)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choices(words, range(60, 20, -1), k=rng.randrange(5, 60))) for _ in range(500)]
    texts += texts[:40]  # equal scores
    docs = spark.createDataFrame(list(enumerate(texts)), "memory_id long, content string").repartition(3).persist()
    post = sparse.postings(docs)
    q = post.filter("memory_id % 50 = 0").select(F.col("memory_id").alias("query_id"), "term", "w")
    found = sparse.best(q, docs, "keyword", 10, bonus=0.05).persist()

    def final(rows):
        s = rows.join(q.groupBy("query_id").agg(F.count("*").alias("na")), "query_id")
        gap = F.lag("score").over(W.partitionBy("query_id").orderBy(F.desc("score"), "memory_id")) - F.col("score")
        s = s.withColumn("gap", gap).withColumn("score", F.col("score") + F.when(F.col("gap") < 0.01, 0.05 * F.col("n_shared") / F.col("na")).otherwise(0.0))
        return sorted((r.query_id, r["rank"], r.memory_id, round(r.score, 9)) for r in fusion.top(s.select("query_id", "memory_id", "score"), 10).collect())

    every = sparse.keyword_scores(q, post)
    assert final(found) == final(every) and found.count() < every.count() / 3
