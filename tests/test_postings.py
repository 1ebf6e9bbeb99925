"""The stored inverted index against postings made anew."""

import random

import pytest
from pyspark.sql import functions as F

from loomspace.operators import fusion, sparse
from loomspace.sources.postings import PostingStore

DOC = "memory_id long, content string"


def test_recall_after_changes_and_deletions(spark, tmp_path):
    r = random.Random(0)
    text = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "Delta", "é", "zz", "q9"]) for _ in range(r.randrange(1, 9)))
    store, held = PostingStore(spark, str(tmp_path / "p")), {}
    assert store.documents().collect() == [] and store.postings().collect() == []
    for batch in range(3):
        rows = [(k, text()) for k in r.sample(range(30), 14)] + ([(k, None) for k in r.sample(range(30), 5)] if batch else [])
        gone = {k for k, t in rows if t is None}
        assert store.upsert(spark.createDataFrame([*rows, *rows[:1], (None, "alpha")], DOC), batch)
        held = {k: t for k, t in (held | dict(x for x in rows if x[1] is not None)).items() if k not in gone}
    assert not store.upsert(spark.createDataFrame([(1, "never")], DOC), 2)
    fresh = sparse.postings(spark.createDataFrame(list(held.items()), DOC))
    pick = lambda frame: sorted((x.memory_id, x.term, x.w) for x in frame.collect())
    assert pick(store.postings()) == pick(fresh) and {x.memory_id for x in store.documents().collect()} == set(held)
    queries = spark.createDataFrame([(0, "alpha", 1.0), (0, "delta", 2.0), (500, "zz", 1.0), (501, "none", 1.0)], "query_id long, term string, w double")
    score = lambda frame: {(x.query_id, x.memory_id): pytest.approx(x.score) for x in frame.collect()}
    for how in ("bm25", "tfidf", "overlap"):
        assert score(store.recall(queries, how)) == score(sparse.recall(queries, fresh, len(held), how))
    with pytest.raises(ValueError, match="all postings"):
        store.recall(queries, "bm25_norm")
    small = store.compact(str(tmp_path / "c"))
    assert pick(small.postings()) == pick(fresh) and not small.upsert(spark.createDataFrame([(1, "x")], DOC), 0)
    assert small.upsert(spark.createDataFrame([(k, None) for k in held], DOC), 9) and small.postings().collect() == []


def test_a_search_reads_the_partitions_of_its_terms(spark, tmp_path):
    store = PostingStore(spark, str(tmp_path / "p"))
    store.upsert(spark.createDataFrame([(k, f"word{k} common") for k in range(40)], DOC), 0)
    plan = store.postings(spark.createDataFrame([("word3",)], "term string"))._jdf.queryExecution().toString()
    scan = next(x for x in plan.split("\n") if "FileScan" in x and "bucket" in x)
    assert "PartitionFilters" in scan and "bucket" in scan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert [x.memory_id for x in store.postings(spark.createDataFrame([("word3",)], "term string")).collect()] == [3]


def test_a_task_hands_out_its_best_by_stored_postings(spark, tmp_path, monkeypatch):
    """As the best of all scores, of which no row for a query and a document is made."""
    r = random.Random(4)
    text = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "zz", "q9", "common"]) for _ in range(r.randrange(1, 9))) + " common"
    store = PostingStore(spark, str(tmp_path / "p"))
    store.upsert(spark.createDataFrame([(k, text()) for k in range(90)], DOC), 0)
    store.upsert(spark.createDataFrame([(k, text() if k % 2 else None) for k in range(40)], DOC), 1)
    queries = spark.createDataFrame([(0, "alpha", 1.0), (0, "delta", 2.0), (3, "common", 1.0), (3, "beta", 0.5), (501, "none", 1.0)], "query_id long, term string, w double")
    rows = lambda frame: [(x.query_id, x.memory_id, x["rank"], round(x.score, 5)) for x in sorted(frame.collect(), key=lambda x: (x.query_id, x["rank"]))]
    for how in ("bm25", "tfidf", "overlap"):
        want = rows(fusion.top(store.recall(queries, how).withColumn("score", F.round("score", 6)), 5))
        with monkeypatch.context() as m:
            m.setattr(sparse, "recall", lambda *args: pytest.fail("all scores"))
            found = store.best(queries, 5, how)
            assert rows(fusion.top(found, 5)) == want and len(want) == 10
    with pytest.raises(ValueError, match="all postings"):
        store.best(queries, 5, "bm25_norm")
