"""The incremental graph against full builds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspace.operators import graph, neighbours
from loomspace.sources.graph_store import GraphStore, graph_job

ROW = "memory_id long, v array<double>"


def made(seed, ids, dim=5):
    r = np.random.default_rng(seed)
    return [(int(k), r.normal(size=dim).tolist()) for k in ids]


def edges(frame):
    return sorted((r.source, r.target, round(r.sim, 9)) for r in frame.collect())


def full(spark, rows, k=3):
    return edges(graph.knn(spark.createDataFrame(rows, ROW), k, F.col("v")))


def test_across_blocks(spark):
    a, b = spark.createDataFrame(made(1, range(40)), ROW), spark.createDataFrame(made(2, range(20, 70)), ROW)
    assert edges(neighbours.across(a, b, 4, block=7)) == edges(neighbours.across(a, b, 4))
    x = neighbours.units(a.toPandas()["v"]) @ neighbours.units(b.toPandas()["v"]).T
    x[np.arange(40)[:, None] == np.arange(20, 70)[None]] = -2
    want = {(i, 20 + int(j)): (x[i, j] + 1) / 2 for i in range(40) for j in np.argsort(-x[i], kind="stable")[:4]}
    assert {(i, j): s for i, j, s in edges(neighbours.across(a, b, 4))} == pytest.approx(want)


def test_batches_equal_a_full_build_and_replays_change_nothing(spark, tmp_path):
    rows = made(3, range(50))
    store = GraphStore(spark, str(tmp_path / "g"), 3)
    assert store.edges().collect() == [] and store.committed() == []
    for batch in range(3):
        part = spark.createDataFrame([r for r in rows if r[0] % 3 == batch], ROW)
        assert store.upsert(part, batch)
        assert edges(store.edges()) == full(spark, [r for r in rows if r[0] % 3 <= batch])
    before = edges(store.edges())
    assert not store.upsert(spark.createDataFrame(rows[:5], ROW), 1)
    assert edges(store.edges()) == before == full(spark, rows) and store.committed() == [0, 1, 2]


def test_a_batch_without_its_commit_is_not_read_and_can_be_replayed(spark, tmp_path):
    rows = made(4, range(30))
    store = GraphStore(spark, str(tmp_path / "g"), 3)
    store.upsert(spark.createDataFrame(rows[:20], ROW), 0)
    before = edges(store.edges())

    def broken(batch):
        raise OSError("lost")

    store._commit = broken
    with pytest.raises(OSError):
        store.upsert(spark.createDataFrame(rows[20:], ROW), 1)
    again = GraphStore(spark, store.path, 3)
    assert edges(again.edges()) == before and again.committed() == [0]
    assert again.upsert(spark.createDataFrame(rows[20:], ROW), 1) and edges(again.edges()) == full(spark, rows)


def test_changes_and_removals(spark, tmp_path):
    rows = dict(made(5, range(40)))
    store = GraphStore(spark, str(tmp_path / "g"), 3)
    store.upsert(spark.createDataFrame(list(rows.items()), ROW), 0)
    rows |= dict(made(6, [3, 7, 41, 42]))
    gone = [(k, None) for k in (1, 2, 30)]
    store.upsert(spark.createDataFrame([(k, rows[k]) for k in (3, 7, 41, 42)] + gone + [(None, [1.0] * 5)], ROW), 1)
    rows = {k: v for k, v in rows.items() if k not in (1, 2, 30)}
    assert edges(store.edges()) == full(spark, list(rows.items())) and store.memories().count() == 39
    store.upsert(spark.createDataFrame([(1, rows[5]), (1, rows[5])], ROW), 2)  # one comes back
    rows[1] = rows[5]
    assert edges(store.edges()) == full(spark, list(rows.items()))
    small = store.compact(str(tmp_path / "c"))
    assert edges(small.edges()) == edges(store.edges()) and not small.upsert(spark.createDataFrame([], ROW), 1)
    assert small.upsert(spark.createDataFrame([(k, None) for k in rows], ROW), 3) and small.edges().collect() == []


def test_stream_with_a_restart(spark, tmp_path):
    rows, where = made(7, range(36)), str(tmp_path / "in")
    store = GraphStore(spark, str(tmp_path / "g"), 3)

    def run():
        stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(where)
        graph_job(stream, store, str(tmp_path / "cp")).awaitTermination()

    for part in range(2):
        spark.createDataFrame([r for r in rows if r[0] % 3 == part], ROW).coalesce(1).write.mode("append").parquet(where)
    run()
    assert edges(store.edges()) == full(spark, [r for r in rows if r[0] % 3 < 2])
    spark.createDataFrame([r for r in rows if r[0] % 3 == 2], ROW).coalesce(1).write.mode("append").parquet(where)
    run()
    assert edges(store.edges()) == full(spark, rows) and len(store.committed()) == 3
