"""The pipeline against a plain version of each stage."""

import random

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from loomspace.llm import quality

from .test_scans import hits
from .test_similarity import lower


def plain_groups(docs, size=5, percent=80):
    sets = {}
    for i, t in docs:
        w = lower(t).split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}
    up = {i: i for i in sets}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i for i in ids if find(i) == i}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(11)
    words = [f"w{k}" for k in range(900)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = [(k, text(r.choice([20, 60, 120]))) for k in range(60)]
    for k in range(60, 90):
        t = r.choice(docs[:60])[1].split()
        for _ in range(r.randrange(3)):
            t[r.randrange(len(t))] = "new"
        docs.append((k, " ".join(t)))
    items = [(k, text(14)) for k in range(5)]
    docs += [(90 + k, f"{text(60)} {items[k % 5][1].upper()} {text(5)}") for k in range(8)]
    docs += [(100, text(80) + " password=abcdef123 " + text(3)), (101, None), (102, "")]
    path = tmp_path_factory.mktemp("tables")
    frame = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 7) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long, kept int")
    frame.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(103)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), docs, items


def test_stages(spark, tables):
    path, docs, items = tables
    frame, left = spark.read.parquet(f"{path}/documents.parquet"), dict(docs)
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "jaccard_join", "decontamination", "secret_scan", "packing"]
    good = {r.doc_id for r in quality.quality(frame, spark.read.parquet(f"{path}/labels.parquet")).collect() if r.kept}
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, frame, path)
        assert out.columns == frame.columns and out.dtypes == frame.dtypes
        rows = out.collect()
        if name == "quality_rules":
            left = {i: t for i, t in left.items() if i in good}
            assert 0 < len(left) < len(docs)
        elif name == "jaccard_join":
            stay = plain_groups(list(left.items()))
            assert len(stay) < len(left)
            left = {i: t for i, t in left.items() if i in stay}
        elif name == "decontamination":
            before = len(left)
            left = {i: t for i, t in left.items() if not hits(t, items)[4]}
            assert len(left) < before
        else:
            left = {i: t.replace("password=abcdef123", cp.MARK) for i, t in left.items()}
        assert sorted((r.doc_id, r.text) for r in rows) == sorted(left.items())
        assert all(r.n_chars == len(r.text) and r.kept == 7 for r in rows)
        frame = spark.createDataFrame(rows, frame.schema)
    packed = cp.STAGES[4][1](spark, frame, path)
    assert {r.doc_id for r in packed.collect()} == set(left)


def test_run(spark, tables):
    path, _, _ = tables
    out = cp.run(spark, path)
    one = out.agg(F.sum("length").alias("n"), F.countDistinct("doc_id").alias("d")).first()
    assert one.d > 30 and one.n == out.groupBy("doc_id").agg(F.max("doc_tokens").alias("t")).agg(F.sum("t").alias("t")).first().t


def written(spark, path, docs, schema, items=(), labels=()):
    spark.createDataFrame(docs, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_empty_tables_pass_every_stage(spark, tmp_path):
    path = written(spark, tmp_path, [], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, path).collect() == []
    assert cp.run(spark, path).collect() == []


def test_long_texts_repeated_rows_and_clashing_columns(spark, tmp_path):
    """Every stage reads a long text whole: a passage and a secret at its end count; of rows of one id one stays."""
    r = random.Random(2)
    text = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    long, item = text(150_000), text(12)
    docs = [(1, long + " token=abcdef12"), (2, text(80)), (2, "a" + text(80)), (3, text(100_000) + " " + item), (None, text(70)), (None, text(70)), (4, None), (5, "")]
    clash = ["part", "kept", "gram", "run", "share", "row", "h1", "_nth", "_rest", "bucket", "item"]
    rows = [(i, t, "en", "s", len(t or ""), *range(len(clash))) for i, t in docs]
    path = written(spark, tmp_path, rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in clash), [(1, item)])
    frame = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in cp.STAGES[:4]:
        out = stage(spark, frame, path)
        assert out.columns == frame.columns
        frame = spark.createDataFrame(out.collect(), frame.schema)
    got = frame.collect()
    assert sorted((x.doc_id or 0) for x in got) == [0, 0, 1, 2] and all(list(x)[5:] == list(range(len(clash))) for x in got)
    by = {x.doc_id: x.text for x in got}
    assert by[1] == long + " " + cp.MARK and by[2] == min(docs[1][1], docs[2][1])
    packed = cp.STAGES[4][1](spark, frame, path).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert all(x.n == x.t for x in packed if x.doc_id is not None)
