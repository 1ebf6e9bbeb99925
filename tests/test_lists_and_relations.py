"""Nearest lists, silhouettes, relations and merges against plain versions."""

import random

import numpy as np
import pytest

from loomspace.operators import clustering, curation, graph, retrieval, topics
from loomspace.plans import relations as rel
from tests.test_entry import DATA, QUERIES

SPACES = ("E1", "E5", "E8", "E9", "E10")


def vectors(n, r):
    """Some of them equal, some without a length in a part or at all."""
    rows = [[r.gauss(0, 1) for _ in range(64)] for _ in range(n)]
    rows[3], rows[5] = rows[4], [0.0] * 64
    rows[6] = [0.0] * 32 + rows[6][32:]
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [1000, 2])
@pytest.mark.parametrize("rows", [2048, 7])
def test_nearest_as_all_pairs(spark, monkeypatch, block, rows):
    monkeypatch.setattr(retrieval, "BLOCK", block)
    monkeypatch.setattr(retrieval, "ROWS", rows)
    m = spark.createDataFrame(vectors(40, random.Random(1)), "memory_id long, E1 array<double>")
    q = m.filter("memory_id % 8 = 5 or memory_id = 3").selectExpr("memory_id as query_id", "E1 as q")
    got = {}
    for x in retrieval.nearest(q, m, SPACES, 6).collect():
        got.setdefault((x.query_id, x.space), []).append((x["rank"], x.memory_id, round(x.sim, 9)))
    every = {}
    for x in retrieval.similarities(q, m, SPACES).collect():
        every.setdefault((x.query_id, x.space), []).append((-round(x.sim, 12), x.memory_id))
    want = {k: [(n, i, round(-s, 9)) for n, (s, i) in enumerate(sorted(v)[:6])] for k, v in every.items()}
    assert {k: sorted(v) for k, v in got.items()} == want
    chosen = retrieval.nearest(q, m, ("E1",), 3).select("query_id", "memory_id")
    own = {(x.query_id, x.memory_id, x.space): x.sim for x in retrieval.of_candidates(chosen, q, m, SPACES).collect()}
    all_ = {(x.query_id, x.memory_id, x.space): x.sim for x in retrieval.similarities(q, m, SPACES).collect()}
    assert len(own) == 3 * len(SPACES) * q.count() and all(all_[k] == pytest.approx(s) for k, s in own.items())


def test_nearest_without_queries_or_memories(spark):
    m = spark.createDataFrame(vectors(10, random.Random(2)), "memory_id long, E1 array<double>")
    q = m.selectExpr("memory_id as query_id", "E1 as q")
    assert retrieval.nearest(q.limit(0), m, SPACES, 3).count() == 0
    assert retrieval.nearest(q, m.limit(0), SPACES, 3).count() == 0
    assert retrieval.single_space(q, m, "E1", 3, 2.0).count() == 0


@pytest.mark.parametrize("block", [1000, 1])
def test_silhouette_as_all_pairs(spark, block):
    r = random.Random(3)
    rows = [(i, r.choice("abc"), [r.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    rows += [(60, "alone", [1.0, 0.0, 0.0, 0.0]), (61, "a", [0.0] * 4), (62, None, [1.0] * 4)]
    got = {x.memory_id: x.s for x in clustering.silhouette(spark.createDataFrame(rows, "memory_id long, label string, v array<double>"), "label", block).collect()}

    def apart(x, y):
        size = np.linalg.norm(x) * np.linalg.norm(y)
        return 1 - (np.dot(x, y) / size if size else 0)

    want, own = {}, [x for x in rows if x[1]]
    for i, c, x in own:
        mean = {g: np.mean(d) for g in {y[1] for y in own} if (d := [apart(x, y[2]) for y in own if y[1] == g and y[0] != i])}
        a, b = mean.get(c), min((d for g, d in mean.items() if g != c), default=None)
        want[i] = 0.0 if a is None or b is None else (b - a) / max(a, b)
    assert got == pytest.approx(want)


def test_equal_points_have_no_silhouette(spark):
    rows = [(i, "ab"[i % 2], [1.0, 2.0, 3.0]) for i in range(8)]
    got = clustering.silhouette(spark.createDataFrame(rows, "memory_id long, label string, v array<double>"), "label").collect()
    assert [x.s for x in got] == [0.0] * 8


def test_named_relations(spark):
    rows = [(" Contains ",), ("CONSUMED BY",), ("uses",), ("gibberish",), (None,), ("",)]
    got = [(x.type, x.category) for x in rel.named(spark.createDataFrame(rows, "w string"), "w").collect()]
    none = ("none", "invocation")
    assert sorted(got) == sorted([("contains", "containment"), ("used_by", "invocation"), ("imports", "dependency"), none, none, none])
    assert len({k for kinds in rel.TYPES.values() for k in kinds}) == 19
    raw = spark.createDataFrame([("LOOP",), ("indirect",), ("Sequence",), ("other",), (None,)], "m string")
    assert [x[0] for x in raw.select(rel.mechanism(raw.m)).collect()] == ["feedback", "mediated", "temporal", "direct", "direct"]


def test_sparse_merges(spark):
    terms = spark.createDataFrame([(0, "a", 2.0), (0, "a", 4.0), (0, "b", 3.0), (1, "c", 1.0)], "grp long, term string, w double")
    sizes = spark.createDataFrame([(0, 2), (1, 3), (2, 1)], "grp long, n long")
    run = lambda how: sorted(map(tuple, curation.sparse_merged(terms, sizes, "grp", how).collect()))
    assert run("union") == [(0, "a", 3.0), (0, "b", 1.5), (1, "c", pytest.approx(1 / 3))]
    assert run("intersection") == [(0, "a", 3.0)]


def test_graph_edits(spark):
    e = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.6), (3, 1, 0.7)], "source long, target long, weight double")
    gone = spark.createDataFrame([(1, 2), (1, 2), (2, 1)], "source long, target long")
    assert sorted((x.source, x.target) for x in graph.without_edges(e, gone).collect()) == [(2, 3), (3, 1)]
    assert [(x.source, x.target) for x in graph.without_nodes(e, spark.createDataFrame([(3,), (9,)], "memory_id long")).collect()] == [(1, 2)]
    more = spark.createDataFrame([(1, 2, 9.0), (2, 1, 9.0)], "source long, target long, weight double")
    assert sorted(map(tuple, graph.with_edges(e, more).collect())) == [(1, 2, 0.5), (2, 1, 9.0), (2, 3, 0.6), (3, 1, 0.7)]


def test_hierarchy_links_through_others(spark):
    p = {5: [1.0, 0.0, 0.0], 6: [1.0, 0.9, 0.0], 7: [0.0, 1.0, 0.0], 8: [0.0, 0.0, 1.0], 9: [0.0, 0.0, 0.0]}
    got = {x.topic: (x.parent, x.depth, x.siblings) for x in topics.hierarchy(spark.createDataFrame(list(p.items()), "topic long, p array<double>"), 0.6).collect()}
    assert got == {5: (5, 1, 3), 6: (5, 1, 3), 7: (5, 1, 3), 8: (None, 0, 1), 9: (None, 0, 1)}


def test_brief_context_keeps_its_budget(spark):
    assert curation.shares(200) == {"divergence": 33, "cluster": 66, "single": 50, "session": 33}
    got = QUERIES["brief_context"](spark, DATA).groupBy("query_id").sum("tokens").collect()
    assert got and all(x[1] <= 200 for x in got)


def test_topics_of_density_clusters(spark):
    r = random.Random(4)
    blob = lambda k: [float(j == k) + r.gauss(0, 0.02) for j in range(6)]
    rows = [(i, s, blob(i % 3)) for i in range(30) for s in ("E1", "E5", "E7")]
    own = clustering.density(spark.createDataFrame(rows, "memory_id long, space string, v array<double>"))
    got = {x.memory_id: x.topic for x in topics.synthesise(own.selectExpr("memory_id", "space", "cast(cluster as bigint) as cluster")).collect()}
    assert got == {i: i % 3 for i in range(30)}


@pytest.mark.parametrize("block", [1000, 1])
def test_new_vectors_join_the_nearest_cluster(spark, block):
    new = spark.createDataFrame([(1, [1.0, 0.1]), (2, [-1.0, -1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "memory_id long, v array<double>")
    centres = spark.createDataFrame([("y", [0.0, 2.0]), ("x", [2.0, 0.0])], "c string, centroid array<double>")
    got = {x.memory_id: (x.c, x.recluster) for x in clustering.assigned(new, centres, "c", 0.3, 4, block).collect()}
    assert got == {1: ("x", True), 2: (None, True), 3: ("x", True), 4: (None, True)}  # ties by the smaller name
    assert not any(x.recluster for x in clustering.assigned(new, centres, "c", 0.3, 5, block).collect())
