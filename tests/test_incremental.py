"""Cluster features and clustering of streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspace.operators import birch
from loomspace.streaming import clusters

ROW = "space string, memory_id long, v array<double>"


def made(n, groups=4, dim=6, seed=0, wide=0.05):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(groups, dim)) * 2
    return [(int(k), (centre[k % groups] + r.normal(size=dim) * wide).tolist()) for k in range(n)]


@pytest.mark.parametrize(("parts", "most", "fan"), [(1, 256, 16), (7, 8, 2), (40, 5, 3)])
def test_sums_are_those_of_the_data(spark, parts, most, fan):
    rows = made(700, wide=0.5)
    frame = spark.createDataFrame(rows + [(999, None)], "memory_id long, v array<double>").repartition(parts)
    got = birch.features(frame, F.col("v"), most=most, fan=fan).collect()
    x = np.array([v for _, v in rows])
    assert 0 < len(got) <= most and sum(r.n for r in got) == 700
    assert np.allclose(sum(np.array(r.ls) for r in got), x.sum(0)) and sum(r.ss for r in got) == pytest.approx(float((x * x).sum()))


def test_clusters_are_found_and_the_threshold_adapts(spark):
    rows = made(400, groups=4)
    frame = spark.createDataFrame(rows, "memory_id long, v array<double>").repartition(6)
    own = birch.clusters(birch.features(frame, F.col("v"))).orderBy("cluster").collect()
    assert [r.n for r in own] == [100] * 4 and all(r.radius < 0.3 for r in own)
    few = birch.features(frame, F.col("v"), threshold=1e-6, most=4).collect()
    assert len(few) <= 4 and all(r.threshold > 1e-6 for r in few)
    assert birch.features(frame.limit(0), F.col("v")).collect() == []


def test_features_must_be_finite():
    with pytest.raises(ValueError, match="finite"):
        birch.Features().add(1.0, np.array([np.nan, 1.0]), 1.0)


def test_a_leaf_keeps_its_id_and_radius():
    f = birch.Features(0.5, 3)
    names = [f.add(1.0, np.array([x, 0.0]), x * x) for x in (0.0, 10.0, 0.1, 20.0, 10.2, 30.0)]
    assert names[:5] == [0, 1, 0, 2, 1] and len(f.n) <= 3 and f.n.sum() == 6 and f.threshold > 0.5


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


def test_stream_equals_its_twin_over_restarts(spark, tmp_path):
    settings = {"after": 25, "held": 60}
    rows = [(s, k, v) for s in ("E1", "E7") for k, v in made(150, seed=len(s), wide=0.02)] + [("E1", None, [1.0]), (None, 3, [1.0]), ("E1", 7000, None)]
    where, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", clusters.PROVIDER)
    try:
        for start in range(0, 150, 40):  # a file and a restart each
            part = [r for r in rows if r[1] is None or start <= r[1] < start + 40 or r[1] == 7000]
            spark.createDataFrame(part, ROW).coalesce(1).orderBy("memory_id").coalesce(1).write.mode("append").parquet(where)
            stream = spark.readStream.schema(ROW).parquet(where)
            q = clusters.clustered(stream, **settings).writeStream.format("parquet").option("checkpointLocation", cp).trigger(availableNow=True).start(out)
            q.awaitTermination()
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = rows_of(spark.read.parquet(out).select("space", "shard", "memory_id", "cluster", "kind"))
    want = rows_of(clusters.in_order(spark.createDataFrame(rows, ROW), F.col("memory_id"), **settings))
    assert got == want
    last = [r for r in got if r[0] == "E1" and r[4] == "recluster"]
    assert len([r for r in got if r[4] == "insert"]) == 300 and len({r[3] for r in last}) >= 4


def test_eviction_and_later_members():
    s = clusters.Space(after=40, held=50)
    out = []
    for k, v in made(130, seed=3, wide=0.02):
        out += s.insert(k, np.array(v))
    assert len(s.ids) <= 50 and s.evicted and s.ids[-1] == 129
    kinds = [k for _, _, k in out]
    assert kinds.count("insert") == 130 and kinds.count("recluster") > 80


def test_shards_split_a_space(spark):
    frame = spark.createDataFrame([("E1", k, v) for k, v in made(80)], ROW)
    got = clusters.in_order(frame, F.col("memory_id"), shards=4, after=1000).collect()
    assert len(got) == 80 and len({r.shard for r in got}) > 1
