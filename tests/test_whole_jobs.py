"""Queries over all of their rows, held against brute force or against their SQL without its cuts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspace.operators import causal, clustering, curation, entities, graph, metrics, temporal, topics
from tests.test_entry import DATA, QUERIES, SQL, duck, plain  # noqa: F401


def test_decay_accuracy_counts_every_pair(spark):
    r = random.Random(1)
    value = lambda: r.choice([None, float("nan"), -0.0, 0.0, 1.5, *[r.random() for _ in range(5)]])
    rows = [(u, r.choice([None, *range(40)]), value()) for u in (0, 0, 0, 1, 2, None) for _ in range(30)] + [(3, 5, 1.0), (4, 5, None), (4, 6, None), (5, 7, 1.0), (5, 7, 2.0)]
    got = {x[0]: x[1] for x in metrics.decay_accuracy(spark.createDataFrame(rows, "u long, age long, value double"), "u", "age", "value").collect()}
    big = lambda v: (v != v, 0 if v != v else v)
    want = {}
    for u in range(6):
        own = [x[1:] for x in rows if x[0] == u and x[1] is not None]
        pairs = [(a, b) for a in own for b in own if a[0] < b[0]]
        both = [big(b[1]) <= big(a[1]) for a, b in pairs if a[1] is not None and b[1] is not None]
        if pairs:
            want[u] = sum(both) / len(both) if both else None
    assert got == pytest.approx(want)


def test_decay_accuracy_over_all_events(spark, duck):  # noqa: F811
    want = duck.sql(SQL["decay_accuracy"]).df()
    assert plain(QUERIES["decay_accuracy"](spark, DATA).toPandas()) == plain(want)


def test_cooccurrence_keeps_frequent_names(spark):
    rows = [(m, "all") for m in range(10)] + [(m, "most") for m in range(8)] + [(0, "one"), (0, "one"), (None, "all"), (1, None)]
    found = spark.createDataFrame(rows, "memory_id long, entity string")
    got = {(x.a, x.b): (x.n, x.weight) for x in entities.cooccurrence(found, 10).collect()}
    assert got == {("all", "most"): (8, 0.8), ("all", "one"): (1, 0.1), ("most", "one"): (1, 0.1)}
    assert [(x.a, x.b) for x in entities.cooccurrence(found, 10, min_relation_score=0.3).collect()] == [("all", "most")]


def test_entity_graph_pairs_all_entities(spark, duck):  # noqa: F811
    want = duck.sql(SQL["entity_graph"]).df()
    assert plain(QUERIES["entity_graph"](spark, DATA).toPandas()) == plain(want)


@pytest.mark.parametrize("block", [1, 7, 2048])
def test_least_cosine_of_all_pairs(spark, block):
    r = np.random.default_rng(block)
    rows = [(int(k % 3), int(k), r.normal(size=4).tolist()) for k in range(60)] + [(3, 1, [1.0] * 4), (None, 2, [1.0] * 4), (4, 3, [0.0] * 4), (4, 4, [1.0] * 4)]
    frame = spark.createDataFrame(rows, "label long, memory_id long, v array<double>")
    got = {x.label: x.low for x in graph.least_cosine(frame, "label", F.col("v"), block).collect()}
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))) if np.any(a) and np.any(b) else 0.0
    assert got == pytest.approx({g: min(cos(a[2], b[2]) for a in rows for b in rows if a[0] == b[0] == g and a[1] < b[1]) for g in (0, 1, 2, 4)})


def test_merge_compatibility_over_all_memories(spark, duck):  # noqa: F811
    want = duck.sql(SQL["merge_compatibility"]).df()
    assert plain(QUERIES["merge_compatibility"](spark, DATA).toPandas()) == plain(want)


def test_fingerprint_pairs_against_all_memories(spark, duck):  # noqa: F811
    want = duck.sql(SQL["fingerprint_pairs"]).df()
    got = QUERIES["fingerprint_pairs"](spark, DATA).toPandas()
    assert len(got) == 5 * 499 and plain(got) == plain(want)


@pytest.mark.parametrize("block", [9, 2048])
def test_pairs_over_all_blocks(spark, block):
    r = np.random.default_rng(block)
    rows = [(int(k), ["cause", "effect", "unknown"][k % 3], r.normal(size=3).tolist(), int(r.integers(0, 3)), int(r.integers(0, 400))) for k in range(60)] + [(100, "cause", [0.0] * 3, 5, 500)]
    frame = spark.createDataFrame(rows, "memory_id long, dir string, E1 array<double>, marks int, n int")
    cos = lambda x, y: float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y))) if np.any(x) and np.any(y) else 0.0
    pairs = [(a, b, cos(a[2], b[2])) for a in rows for b in rows if a[0] < b[0]]
    got = {(x.a, x.b): x.sim for x in graph.similar_pairs(frame, "E1", 0.7, block).collect()}
    assert got == pytest.approx({(a[0], b[0]): (c + 1) / 2 for a, b, c in pairs if (c + 1) / 2 >= 0.7})
    want = {(a[0], b[0]) for a, b, c in pairs if (c + 1) / 2 >= 0.7 and {a[1], b[1]} != {"cause", "effect"}}
    assert {(x.a, x.b) for x in curation.consolidation(frame, 0.7).collect()} == want
    score = lambda a, b, c: round(min(1, min(0.4, 0.1 * (a[3] + b[3])) + 0.05 * (min(a[4], b[4]) > 100) + 0.05 * (min(a[4], b[4]) > 300) + 0.1 * (0.4 <= c <= 0.8)), 9)
    best = sorted((-score(*p), p[0][0], p[1][0]) for p in pairs if 0.3 <= p[2] <= 0.95 and score(*p) >= 0.2)[:20]
    assert [(-x.score, x.a, x.b) for x in graph.scan_pairs(frame, "E1", best=20, block=block).collect()] == best


@pytest.mark.parametrize("seed", range(3))
def test_leader_clusters_are_the_greedy_ones(spark, seed):
    r = random.Random(seed)
    ids = r.sample(range(200), 50)
    pairs = [tuple(r.sample(ids, 2)) for _ in range(70)] + [(ids[0], ids[0])]
    near = {frozenset(p) for p in pairs}
    want, taken = {}, set()
    for i in sorted(ids):
        if i not in taken:
            own = [i] + [j for j in ids if j not in taken and j != i and frozenset((i, j)) in near]
            want |= {j: i for j in own}
            taken |= set(own)
    nodes = spark.createDataFrame([(i,) for i in ids], "memory_id long")
    got = {x.node: x.leader for x in graph.leader_clusters(nodes, spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want
    assert graph.leader_clusters(nodes.limit(0), spark.createDataFrame([], "a long, b long")).collect() == []


def test_topics_merge_as_in_the_plain_version(spark):
    r = np.random.default_rng(4)
    centres = r.random((6, 5))
    rows = [(int(k), int(r.integers(1, 9)), (centres[k % 6] + r.random(5) * 0.3).tolist()) for k in range(40)] + [(90, 3, [0.0] * 5), (91, 3, [0.0] * 5)]
    got = {x.topic: x.merged_into for x in topics.merged(spark.createDataFrame(rows, "topic long, size long, p array<double>"), 0.97).collect()}
    want = topics.merge(rows, 0.97)
    assert got == want and 2 < len(set(want.values())) < 40


def test_scan_clusters(spark):
    got = QUERIES["scan_clusters"](spark, DATA).toPandas()
    assert got.memory_id.is_unique and (got.leader <= got.memory_id).all() and set(got.leader) <= set(got.memory_id)


def test_density_is_the_same_at_either_size(spark, monkeypatch):
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 8))
    x = {"spread": r.normal(size=(60, 8)), "close": np.concatenate([centres[k % 6] + r.normal(size=8) * 0.02 * (1 + k % 5) for k in range(80)]).reshape(80, 8)}
    rows = [(s, k * 7 % 101, v.tolist()) for s, m in x.items() for k, v in enumerate(m)] + [("close", 200, [0.0] * 8)]
    frame = spark.createDataFrame(rows, "space string, memory_id long, v array<double>").cache()
    seen = lambda: {(y.space, y.memory_id): (y.cluster, y.probability, y.core) for y in clustering.density(frame).collect()}
    small = seen()
    assert len(set(small.values())) > 4
    monkeypatch.setattr(clustering, "EXACT", 5)
    monkeypatch.setattr(clustering, "BLOCK", 30)
    assert seen() == small


@pytest.mark.parametrize(("seed", "n"), [(0, 1), (1, 2), (2, 90), (3, 400)])
def test_the_cut_of_a_table_is_that_of_an_array(spark, seed, n):
    r = np.random.default_rng(seed)
    for w in (np.round(r.random(n) * 0.01 * n, 3), np.sort(r.random(n)) * 1e-4 + 0.05, np.concatenate([r.random(n) * 0.01, 0.5 + r.random(n) * 0.01])):
        table = spark.createDataFrame([(float(x),) for x in w], "w double").repartition(3)
        assert clustering.table_cut(table) == pytest.approx(clustering.cut(w), abs=1e-12)


def test_the_tree_of_a_large_space_stays_on_executors():
    import inspect

    source = inspect.getsource(clustering._large)
    assert "toPandas" not in source and ".collect()" not in source


@pytest.mark.parametrize("block", [16, 2048])
def test_pairs_in_time_over_blocks(spark, block):
    """Most rows in one second and one day; every pair once, whatever the blocks."""
    r = np.random.default_rng(block)
    times = [5_000_000] * 60 + [5_000_000 + int(x) for x in r.integers(0, 86_400, 50)] + [int(x) for x in r.integers(0, 10**7, 30)] + [None] * 3
    rows = [(int(k), s, int(r.integers(0, 2)) if k % 5 else None, r.normal(size=3).tolist(), int(r.integers(0, 400)), int(r.integers(0, 4))) for k, s in enumerate(times)]
    frame = spark.createDataFrame(rows, "memory_id long, s long, user_id long, E1 array<double>, n int, k int").repartition(3)

    def found(a, b, cos, ok):
        i, j = np.nonzero(ok & (np.round(cos, 9) >= 0.2))
        assert len(a) <= block and len(b) <= block
        return temporal.pd.DataFrame({"a": a["memory_id"].to_numpy()[i], "b": b["memory_id"].to_numpy()[j], "sim": cos[i, j]})

    cos = lambda x, y: float(np.dot(x[3], y[3]) / np.linalg.norm(x[3]) / np.linalg.norm(y[3]))
    timed = [x for x in rows if x[1] is not None]
    near = [(x, y) for x in timed for y in timed if 10 <= y[1] - x[1] <= 86_400]
    got = temporal.pairs_in_time(frame, "E1", 10, 86_400, found, "a long, b long, sim double", block).collect()
    assert len(got) == len({(x.a, x.b) for x in got})
    assert {(x.a, x.b): x.sim for x in got} == pytest.approx({(x[0], y[0]): cos(x, y) for x, y in near if round(cos(x, y), 9) >= 0.2})
    scan = {(x.a, x.b): x.score for x in causal.scan_in_time(frame).collect()}
    score = lambda x, y, c: min(1, 0.15 * (x[5] + y[5]) + 0.1 + 0.1 * (x[2] is not None and x[2] == y[2]) + 0.05 * (min(x[4], y[4]) > 100) + 0.05 * (min(x[4], y[4]) > 300) + 0.1 * (0.5 <= c <= 0.8))
    assert scan == pytest.approx({(x[0], y[0]): score(x, y, round(cos(x, y), 9)) for x, y in near if 0.5 <= round(cos(x, y), 9) <= 0.9})


def test_density_where_lists_end_inside_components(spark, monkeypatch):
    """Blobs of more memories than a list has: their lists can't tell the edges between them, and one space has a memory without a distance."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(7, 8))
    rows = [("blobs", k * 11 % 307, (centres[k % 7] + r.normal(size=8) * 0.05).tolist()) for k in range(150)] + [("same", k, [1.0] * 8) for k in range(30)]
    rows += [("plain", k, v.tolist()) for k, v in enumerate(r.normal(size=(40, 8)))]
    frame = spark.createDataFrame(rows, "space string, memory_id long, v array<double>").cache()
    seen = lambda: {(y.space, y.memory_id): (y.cluster, y.probability, y.core) for y in clustering.density(frame).collect()}
    small = seen()
    rounds = []
    monkeypatch.setattr(clustering, "EXACT", 5)
    monkeypatch.setattr(clustering, "LIST", 4)
    kept = clustering._least
    monkeypatch.setattr(clustering, "_least", lambda *a: rounds.append(1) or kept(*a))
    assert seen() == small and len({c for (s, _), (c, _, _) in small.items() if s == "blobs"}) >= 7 and 0 < len(rounds) < 6
    odd = frame.union(spark.createDataFrame([("plain", 900, [float("nan")] * 8)], frame.schema))
    found = {y.memory_id: y.cluster for y in clustering.density(odd).filter("space = 'plain'").collect()}
    assert found == {m: c for (s, m), (c, _, _) in small.items() if s == "plain"} | {900: -1}


def test_rows_beside_those_of_the_next_id(spark):
    from loomspace.sources import tables

    ids = [0, 1, 2, 3, 3, 4, 6, 7, 255, 256, 257, -1, None, 511, 512]
    rows = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "id long, x string").repartition(3)
    for run in (2, 3, 256):
        got = {r.id: (sorted(r.own), sorted(r.next)) for r in tables.beside(rows, "id", "x", run).collect()}
        own = {i: sorted(f"t{n}" for n, j in enumerate(ids) if j == i) for i in ids if i is not None}
        assert got == {i: (own[i], own[i + 1]) for i in own if i + 1 in own}


@pytest.mark.parametrize("name", ["hyperdimensional_similarity", "sparse_similarity"])
def test_neighbours_take_one_shuffle(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == 1 and "Join" not in plan


@pytest.mark.parametrize("head", [1, 7, 500])
def test_leaders_without_pairs_are_those_of_the_pairs(spark, head):
    r = np.random.default_rng(6)
    x = r.normal(size=(150, 6))
    x[140:] = x[:10]  # copies aren't paired
    rows = [(int(k) * 7 % 997, v.tolist()) for k, v in enumerate(x)] + [(2000, [0.0] * 6)]
    frame = spark.createDataFrame(rows, "memory_id long, E1 array<double>").repartition(3).cache()
    near = graph.similar_pairs(frame, "E1", 0.65).filter(F.round(2 * F.col("sim") - 1, 9).between(0.3, 0.95))
    want = {y.node: y.leader for y in graph.leader_clusters(frame, near).collect()}
    some = frame if head > 1 else frame.filter("memory_id < 60")
    if head == 1:
        want = {y.node: y.leader for y in graph.leader_clusters(some, near.filter("a < 60 and b < 60")).collect()}
    assert {y.node: y.leader for y in graph.leaders(some, "E1", 0.3, 0.95, head).collect()} == want
    assert graph.leaders(frame.limit(0), "E1", 0.3, 0.95).collect() == []
