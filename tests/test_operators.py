"""Operators on hand-made fixtures: ties, cycles, tombstones, noise, streams."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspace.operators import causal, clustering, curation, entities, fusion, graph, metrics, topics
from loomspace.operators import temporal as ops
from loomspace.plans import weights as ws
from loomspace.sources import quantisation, readers
from loomspace.sources.store import Store
from loomspace.streaming import jobs

SCORES = "query_id long, memory_id long, space string, sim double"


def test_rrf_of_one_list(spark):
    rows = [(0, k, "E1", 1 - k / 1000) for k in range(100)]
    got = {r.memory_id: r.score for r in fusion.plain_rrf(fusion.ranked(spark.createDataFrame(rows, SCORES))).collect()}
    assert got[0] == pytest.approx(1 / 61) and got[5] == pytest.approx(1 / 66) and got[99] == pytest.approx(1 / 160)


def test_rrf_adds_over_lists_and_breaks_ties_by_id(spark):
    rows = [(0, 1, "E1", 0.9), (0, 2, "E1", 0.9), (0, 2, "E7", 0.5), (0, 1, "E7", 0.4)]
    ranks = fusion.ranked(spark.createDataFrame(rows, SCORES))
    got = {(r.memory_id, r.space): r.rank for r in ranks.collect()}
    assert got == {(1, "E1"): 0, (2, "E1"): 1, (2, "E7"): 0, (1, "E7"): 1}
    same = fusion.plain_rrf(ranks).collect()
    assert [r.score for r in same] == pytest.approx([1 / 61 + 1 / 62] * 2)
    assert fusion.plain_rrf(ranks.limit(0)).collect() == []


def test_degenerate_spaces(spark):
    rows = [(0, k, "E5", -1.0) for k in range(4)] + [(0, k, "E7", 0.5) for k in range(4)] + [(0, k, "E1", k / 4) for k in range(4)]
    frame = spark.createDataFrame(rows, SCORES)
    w = {r.space: r.w for r in fusion.suppressed(frame, ws.PROFILES["default"]).collect()}
    assert w["E5"] == 0 and w["E7"] == pytest.approx(0.21 / 4) and w["E1"] == pytest.approx(0.35)
    fused = {r.memory_id: r.score for r in fusion.semantic_fusion(frame, fusion.suppressed(frame, ws.PROFILES["default"])).collect()}
    assert fused[3] == pytest.approx((0.35 * 0.75 + 0.0525 * 0.5) / 0.4025)


def test_normalisation_of_equal_scores(spark):
    frame = spark.createDataFrame([(0, k, "E1", 0.3) for k in range(3)], SCORES)
    assert {r.sim for r in fusion.min_max(frame).collect()} == {1.0}
    assert {r.sim for r in fusion.z_scores(frame).collect()} == {0.5}


EDGE = "source long, target long, weight double, sim double"


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, float(w), float(w)) for a, b, w in pairs], EDGE)


def test_traversal_of_a_diamond_with_a_cycle(spark):
    e = edges(spark, (1, 2, 0.9), (1, 3, 0.8), (2, 4, 0.5), (3, 4, 0.9), (4, 1, 1.0), (4, 5, 0.2))
    got = {r.node: (r.depth, round(r.weight, 6)) for r in graph.traverse(e, spark.createDataFrame([(1,)], "memory_id long"), 4).collect()}
    assert got == {1: (0, 1.0), 2: (1, 0.9), 3: (1, 0.8), 4: (2, 0.72)}


def test_greedy_path_does_not_return(spark):
    e = edges(spark, (1, 2, 0.9), (2, 1, 0.95), (2, 3, 0.6), (3, 2, 0.9), (3, 1, 0.9))
    got = [(r.hop, r.node) for r in graph.greedy_path(e, spark.createDataFrame([(1,)], "memory_id long")).orderBy("hop").collect()]
    assert got == [(0, 1), (1, 2), (2, 3)]


def test_components(spark):
    e = edges(spark, *[(k, k + 1, 1) for k in range(30)], (100, 101, 1), (7, 7, 1))
    got = {r.node: r.root for r in graph.components(e).collect()}
    assert got == {k: 0 for k in range(31)} | {100: 100, 101: 100}


def test_knn_over_blocks_is_the_same(spark):
    r = np.random.default_rng(0)
    m = spark.createDataFrame([(k, r.normal(size=8).tolist()) for k in range(60)], "memory_id long, v array<double>")
    rows = lambda b: sorted((x.source, x.target, round(x.sim, 9)) for x in graph.knn(m, 4, F.col("v"), block=b).collect())
    assert rows(4096) == rows(7) and len(rows(7)) == 240


def test_two_clusters_and_noise(spark):
    r = np.random.default_rng(1)
    point = lambda c: (np.array(c) + r.normal(scale=0.02, size=3)).tolist()
    rows = [("E1", k, point([1, 0, 0])) for k in range(12)] + [("E1", k, point([0, 1, 0])) for k in range(12, 24)] + [("E1", 24, [-1.0, -1.0, 3.0])]
    frame = spark.createDataFrame(rows, "space string, memory_id long, v array<double>")
    got = {x.memory_id: x.cluster for x in clustering.density(frame).collect()}
    assert {got[k] for k in range(12)} == {0} and {got[k] for k in range(12, 24)} == {1} and got[24] == -1
    assert clustering.density(frame).filter("cluster = -1").first().probability == 0


def test_large_spaces_take_the_graph(spark, monkeypatch):
    monkeypatch.setattr(clustering, "EXACT", 5)
    r = np.random.default_rng(2)
    rows = [("E1", k, (np.eye(3)[k % 2] + r.normal(scale=0.01, size=3)).tolist()) for k in range(40)]
    got = {x.memory_id: x.cluster for x in clustering.density(spark.createDataFrame(rows, "space string, memory_id long, v array<double>")).collect()}
    assert all(got[k] != got[k + 1] or got[k] == -1 for k in range(0, 38, 2))


def test_birch_keeps_all_vectors():
    x = np.random.default_rng(3).normal(size=(500, 4))
    leaves = clustering.birch(x, 0.3, 8)
    assert sum(n for n, _, _ in leaves) == 500
    assert np.allclose(sum(ls for _, ls, _ in leaves), x.sum(0))


def test_topics_of_agreeing_clusters(spark):
    rows = [(m, s, c) for m in range(6) for s, c in (("E1", m // 3), ("E7", m // 3), ("E10", m // 3))] + [(9, "E1", 0), (9, "E7", 1), (9, "E10", 0)]
    got = {r.memory_id: r.topic for r in topics.synthesise(spark.createDataFrame(rows, "memory_id long, space string, cluster long")).collect()}
    assert {got[m] for m in range(3)} == {0} and {got[m] for m in range(3, 6)} == {3} and got[9] == 9


@pytest.mark.parametrize(("before", "after", "churn"), [([1, 2], [1, 2], 0.0), ([1, 2], [2, 3], 2 / 3), ([1], [2], 1.0), ([], [], 0.0)])
def test_churn(spark, before, after, churn):
    rows = spark.createDataFrame([(1, before), (2, after)], "ts long, ids array<int>")
    assert [r.churn for r in topics.churn(rows).orderBy("ts").collect()] == [0.0, pytest.approx(churn)]


def test_topic_merge():
    assert topics.merge([(1, 10, [1.0, 0.0]), (2, 5, [0.99, 0.01]), (3, 4, [0.0, 1.0]), (4, 1, [0.0, 0.0])]) == {1: 1, 2: 1, 3: 3, 4: 4}


def test_chain_scores(spark):
    e = [0.0] * 64
    rows = [(1, 1, e), (1, 2, e)] + [(2, 9, e)]
    m = spark.createDataFrame(rows, "chain long, memory_id long, E1 array<double>")
    got = {r.chain: r for r in causal.chain_scores(m).collect()}
    assert got[1].hops == 1 and got[1].product == 0 and got[2].hops == 0 and got[2].product == 1


def test_budget_skips_what_does_not_fit(spark):
    rows = [(0, 1, "divergence", 9.0, 1000), (0, 2, "cluster", 9.0, 300), (0, 3, "cluster", 8.0, 150), (0, 4, "single", 9.0, 100), (0, 5, "single", 1.0, 40)]
    got = curation.budgeted(spark.createDataFrame(rows, "query_id long, memory_id long, category string, priority double, tokens long")).collect()
    assert sorted(r.memory_id for r in got) == [1, 3, 5]


def test_merge_of_vectors(spark):
    m = spark.createDataFrame([(0, [1.0, 0.005], 1.0), (0, [0.0, 1.0], 3.0)], "g long, v array<double>, w double")
    assert curation.merged(m, "g", "intersection").first().vector == [0.0, 0.0]
    assert curation.merged(m, "g", "weighted_average", importance="w").first().vector == pytest.approx([0.25, 0.75125])


def test_entities(spark):
    docs = spark.createDataFrame([(1, "Python and Foo_bar"), (2, "Foo_bar Python"), (3, None)], "memory_id long, content string")
    found = entities.extract(docs)
    assert {(r.memory_id, r.entity, r.confidence) for r in found.collect()} == {(1, "python", 1.0), (1, "foo_bar", 0.5), (2, "python", 1.0), (2, "foo_bar", 0.5)}
    g = entities.cooccurrence(found, 3, most_common=1.0).collect()
    assert [(r.a, r.b, r.n) for r in g] == [("foo_bar", "python", 2)]


def test_metrics_of_a_perfect_ranking(spark):
    rows = [(0, k, int(k < 3)) for k in range(10)] + [(1, k, 0) for k in range(10)]
    got = {r.query_id: r for r in metrics.per_query(spark.createDataFrame(rows, "query_id long, rank int, grade int"), 5).collect()}
    assert (got[0].recall, got[0].mrr, got[0].ndcg, got[0].ap) == (1, 1, 1, 1) and got[0].precision == pytest.approx(0.6)
    assert (got[1].recall, got[1].mrr, got[1].ndcg, got[1].ap) == (0, 0, 0, 0)


def test_ari_of_equal_partitions(spark):
    t = metrics.contingency(spark.createDataFrame([(k % 3, k % 3) for k in range(30)], "c int, l int"), "c", "l")
    assert metrics.ari(t).first().ari == 1 and metrics.nmi(t).first().nmi == pytest.approx(1) and metrics.purity(t).first().purity == 1


def test_as_of(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = spark.createDataFrame([(1, "a", at(5000)), (2, "a", at(100)), (3, "b", at(9000))], "id long, k string, ts timestamp")
    snaps = spark.createDataFrame([("a", at(0), 7), ("a", at(1400), 8), ("a", at(1401), 9)], "k string, ts timestamp, n int")
    assert {r.id: r.n for r in ops.as_of_previous(rows, snaps, 3600, "k").collect()} == {1: 8, 2: None, 3: None}


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    assert s.memories().count() == 0
    at = lambda k: dt.datetime(2024, 1, k)
    rows = lambda *r: spark.createDataFrame(list(r), "memory_id long, content string, created_at timestamp, file_path string, session_id long")
    s.put(rows((1, "a", at(1), "f", 1), (2, "b", at(1), "f", 1), (3, "c", at(1), "g", 2)))
    s.put(rows((2, "b2", at(2), "f", 1)), "update")
    s.forget(spark.createDataFrame([(3,)], "memory_id long"), at(3))
    assert {r.memory_id: r.content for r in s.memories().collect()} == {1: "a", 2: "b2"}
    assert s.by_file("f").count() == 2 and s.lookup([1, 3]).count() == 1 and s.by_session(2).count() == 0
    assert s.table("audit").groupBy("operation").count().count() == 3
    s.compact(at(5), str(tmp_path / "kept"))
    assert Store(spark, str(tmp_path / "kept")).table("memories").count() == 3  # within retention the tombstone stays
    s.compact(at(20), str(tmp_path / "late"))
    late = Store(spark, str(tmp_path / "late"))
    assert late.table("memories").count() == 2 and late.table("tombstones").count() == 0


def test_readers(spark, tmp_path):
    lines = [json.dumps({"id": "1", "text": "t", "chunk_idx": 0}), "{broken", json.dumps({"id": None, "text": "x"})]
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    rows = readers.chunks_jsonl(spark, str(tmp_path / "c.jsonl")).cache()
    assert rows.count() == 3 and [r.id for r in readers.valid(rows).collect()] == ["1"]
    (tmp_path / "a.md").write_text("# é")
    (tmp_path / "b.md").write_text("two")
    files = readers.markdown_files(spark, str(tmp_path / "*.md"))
    assert {r.content for r in files.collect()} == {"# é", "two"}
    known = files.filter("content = 'two'")
    assert [r.content for r in readers.unseen(files, known).collect()] == ["# é"]
    assert readers.orphans(spark.createDataFrame([("gone",)], "file_path string"), files).count() == 1


def test_quantisation_errors():
    x = np.random.default_rng(5).normal(size=(20, 64))
    size = np.linalg.norm(x, axis=1)
    errors = [np.mean(np.linalg.norm(x - f(x), axis=1) / size) for f in (quantisation.float8, quantisation.sign_bits, quantisation.product_codes)]
    assert errors[0] < 0.05 and errors[1] < 0.7 and errors[2] < 1


EVENTS = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * k + 60 * (k // 20)), k % 3, "view" if k % 2 else "error", float(k), "{}") for k in range(120)]


@pytest.fixture
def events(spark, tmp_path):
    frame = spark.createDataFrame(EVENTS, jobs.EVENTS)
    path = str(tmp_path / "events")
    for part in range(3):
        frame.filter(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(path)
    frame.filter("event_id < 10").coalesce(1).write.mode("append").parquet(path)  # late copies
    return frame, path


def test_stream_matches_its_batch_twin(spark, events):
    frame, path = events
    stream = jobs.file_stream(spark, path, jobs.EVENTS, 1)
    once = jobs.run_to_end(jobs.ingested(stream, "30 days"), "w2")
    assert sorted(r.event_id for r in once.collect()) == list(range(120))
    windows = jobs.run_to_end(jobs.windowed(stream, delay="30 days"), "w3", "complete")
    assert sum(r.n for r in windows.collect()) == 130
    assert sum(r.n for r in jobs.windowed(frame).collect()) == 120


def test_trigger_keeps_state_over_batches(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    schema, path = "key string, ts timestamp, entropy double, churn double", str(tmp_path / "t")
    for rows in ([("a", at(0), 0.8, 0.1), ("b", at(0), 0.9, 0.6)], [("a", at(200), 0.9, 0.1)], [("a", at(310), 0.8, 0.1), ("b", at(310), 0.1, 0.9)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    got = jobs.run_to_end(jobs.consolidation_trigger(jobs.file_stream(spark, path, schema)), "t1")
    assert {(r.key, r.reason) for r in got.collect()} == {("a", "high entropy"), ("b", "entropy and churn")}
