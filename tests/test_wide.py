"""Scores of all pairs as wide rows, and the best by a score over spaces, against the long ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspace.operators import fusion, graph, metrics, retrieval, wide
from loomspace.catalog import QUERIES

SPACES = ("E1", "E5", "E7", "E10")
WEIGHTS = {"E1": 0.5, "E5": 0.2, "E7": 0.3, "E10": 0.0}


@pytest.fixture(scope="module")
def sides(spark):
    x = np.random.default_rng(3).normal(size=(60, 64)).round(1)
    x[40:] = x[:20]  # copies, so that scores tie
    x[9] = 0
    m = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "memory_id long, E1 array<double>").repartition(3)
    return m.filter("memory_id % 10 = 7").select(F.col("memory_id").alias("query_id"), F.col("E1").alias("q")).persist(), m.persist()


@pytest.fixture(scope="module")
def long(sides):
    s = retrieval.similarities(*sides, SPACES)
    return s.withColumn("sim", F.round("sim", 12)).persist()


def rows(df, *keys):
    return {tuple(r[k] for k in keys): tuple(r[c] for c in df.columns if c not in keys) for r in df.collect()}


def same(a, b, *keys):
    a, b = rows(a.select(*b.columns), *keys), rows(b, *keys)
    assert a.keys() == b.keys() and len(a)
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-9, nan_ok=True), k


@pytest.mark.parametrize("how", ["none", "minmax", "zscore", "rank"])
@pytest.mark.parametrize("agg", ["max", "sum", "mean", "weighted"])
def test_normalised(sides, long, how, agg):
    mine = wide.aggregate(wide.normalise(retrieval.wide(*sides, SPACES), SPACES, how), SPACES, agg, WEIGHTS)
    same(mine, fusion.aggregate(fusion.normalise(long, how), agg, WEIGHTS), "query_id", "memory_id")


def test_statistics_and_ranks(sides, long):
    own = retrieval.wide(*sides, SPACES)
    same(wide.suppressed(own, SPACES, WEIGHTS), fusion.suppressed(long, WEIGHTS), "query_id", "space")
    same(wide.correlations(own, SPACES), fusion.correlations(long), "query_id", "a", "b")
    for mine, theirs in ((wide.reciprocal_ranks(wide.ranked(own, SPACES), WEIGHTS), fusion.weighted_rrf), (wide.reciprocal_ranks(wide.ranked(own, SPACES), WEIGHTS, "E5"), fusion.score_weighted_rrf)):
        same(mine, theirs(fusion.ranked(long), WEIGHTS), "query_id", "memory_id")


@pytest.mark.parametrize("agg", ["max", "sum", "mean", "weighted"])
def test_scores_of_whole_rankings(sides, long, monkeypatch, agg):
    for name, value in (("BLOCK", 4), ("RUN", 7), ("RANKED", 120)):
        monkeypatch.setattr(retrieval, name, value)
    spaces = (*SPACES, "E8")  # as E10
    mine = retrieval.over_ranks(*sides, spaces, wide.of_ranks(spaces, agg, WEIGHTS))
    twice = long.unionByName(long.filter("space = 'E10'").withColumn("space", F.lit("E8")))
    same(mine, fusion.aggregate(fusion.normalise(twice, "rank"), agg, WEIGHTS | {"E8": 1.0}), "query_id", "memory_id")


def test_best_of_whole_rankings(sides, long):
    for times, theirs in ((None, fusion.weighted_rrf), ("E5", fusion.score_weighted_rrf)):
        mine = retrieval.over_ranks(*sides, SPACES, wide.of_reciprocal_ranks(WEIGHTS, times), 5)
        both = theirs(fusion.ranked(long), WEIGHTS).withColumn("score", F.round("score", 12))
        same(mine.withColumn("score", F.round("score", 12)), fusion.top(both, 5).drop("rank"), "query_id", "memory_id")


@pytest.mark.parametrize("name", ["aggregate_rank_max", "aggregate_rank_weighted", "fusion_weighted_rrf"])
def test_rankings_travel_by_runs_of_memories(spark, name):
    """No window sorts a row for every query and memory."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and plan.count("Window [") <= (name == "fusion_weighted_rrf")


def test_best_of_a_score(sides, long, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 4)
    monkeypatch.setattr(retrieval, "ROWS", 7)
    mine = retrieval.best(*sides, ("E1", "E7"), lambda s, q, m: np.where(s["E7"] > 0.4, s["E1"] + s["E7"], -np.inf), 5, ("E7",))
    both = long.groupBy("query_id", "memory_id").agg(F.max(F.when(F.col("space") == "E1", F.col("sim"))).alias("E1"), F.max(F.when(F.col("space") == "E7", F.col("sim"))).alias("E7"))
    theirs = fusion.top(both.filter("E7 > 0.4").select("query_id", "memory_id", F.round(F.col("E1") + F.col("E7"), 12).alias("score"), "E7"), 5)
    same(mine, theirs, "query_id", "memory_id")


@pytest.mark.parametrize("name", ["aggregate_minmax_sum", "aggregate_none_max", "fingerprint_pairs", "cross_space_correlation", "degenerate_suppression", "aggregate_rank_max"])
def test_pairs_are_not_shuffled_to_meet_their_spaces(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not [y for y in plan.split("hashpartitioning(")[1:] if "memory_id" in y.split(")")[0]]


def test_nearest_columns_are_those_of_doubles(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 16)).round(1)
    x[600:] = x[:100]  # ties
    x[[3, 650]] = 0
    ids = rng.permutation(700)
    size = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
    sim = np.round(np.where(size > 0, (np.clip(x @ x.T / np.where(size > 0, size, 1), -1, 1) + 1) / 2, 0.0), 12)
    np.fill_diagonal(sim, -1)
    for k in (1, 5, 699, 800):
        r, c, s = graph.nearest_columns(x, x, ids, ids, k, tile=128)
        expected = [np.lexsort((ids, -row))[: min(k, 699)] for row in sim]
        assert (c.reshape(700, -1) == np.array(expected)).all()
        assert np.allclose(s, sim[r, c], atol=1e-12)


def test_two_blocks_meet_once(spark):
    m = spark.range(200).select(F.col("id").alias("memory_id"), F.array(*(F.sin(F.col("id") * k) for k in range(1, 9))).alias("v"))
    rows = graph.knn(m, 3, F.col("v"), block=50)._jdf.queryExecution().optimizedPlan().toString()
    assert "least" in rows and "CoGroup" not in rows
    assert {tuple(r) for r in graph.knn(m, 3, F.col("v"), block=50).select("source", "target").collect()} == {tuple(r) for r in graph.knn(m, 3, F.col("v"), target=F.col("v"), block=70).select("source", "target").collect()}


def test_a_tile_of_products_fits_a_cache():
    """Products of a block's rows are read several times; beyond the cache a pair takes twice as long."""
    import inspect

    assert inspect.signature(graph.nearest_columns).parameters["tile"].default * graph.BLOCK * 4 <= 2**23


@pytest.mark.parametrize("name", ["unified_neighbors", "memory_neighbors"])
def test_neighbours_of_the_stated_set_need_no_whole_graph(spark, name):
    """Memories are scanned for the queries' lists, no two blocks of memories meet."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan


def test_nearest_hands_out_what_a_task_has_not_seen_better(sides, monkeypatch):
    monkeypatch.setattr(retrieval, "ROWS", 6)
    q, m = sides
    long_ = retrieval.similarities(q, m, SPACES).withColumn("sim", F.round("sim", 12))
    same(retrieval.nearest(q, m, SPACES, 4).drop("rank"), fusion.top(long_, 4, ("query_id", "space"), "sim").drop("rank"), "query_id", "memory_id", "space")
    held, own = np.full((1, 2), -np.inf), np.arange(4)[::-1]
    assert [x.tolist() for x in retrieval.first(np.array([[0.5, 0.9, 0.9, 0.9]]), held, own)][1] == [3, 2]
    assert not len(retrieval.first(np.array([[0.5, 0.8, 0.7, -np.inf]]), held, own)[0])


def test_similar_takes_the_queries_lengths_once(monkeypatch):
    x = np.random.default_rng(6).normal(size=(40, 64)).round(1)
    x[[4, 30]], x[7, :16] = 0, 0
    spaces = ("E1", "E5", "E7", "E8", "E9", "E10", "E11", ("E7", "E9"))
    run, norm, taken = retrieval.similar(x[:10], spaces), np.linalg.norm, []
    monkeypatch.setattr(np.linalg, "norm", lambda y, **a: taken.append(len(y)) or norm(y, **a))
    for m in (x[:15], x[15:30], x[30:]):
        found = {s: y.copy() for s, y in run(m).items()}
        assert set(taken) == {len(m)}
        for s in spaces:
            assert found[s] == pytest.approx(retrieval.products(s)(x[:10], m), abs=1e-14), s
        taken.clear()


def test_tiles_fit_a_cache_and_hold_every_row(sides):
    rows = sides[1].toPandas()
    for n in (1, 1000, 10**9):
        seen = [(len(r), own, m) for r, own, m in retrieval.tiles(iter([rows[:25], rows[25:25], rows[25:]]), n)]
        assert all(len(m) == k and (k == 1 or k * n <= retrieval.TILE) for k, _, m in seen)
        assert np.concatenate([own for _, own, _ in seen]).tolist() == rows["memory_id"].tolist()


@pytest.fixture(scope="module")
def apart(spark):
    """As ``sides``, far from 0, and with queries whose vectors have no length in a space."""
    x = np.random.default_rng(8).normal(1, 0.05, size=(90, 64))
    x[[7, 17]], x[37, :16] = 0, 0
    m = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "memory_id long, E1 array<double>").repartition(5)
    return m.filter("memory_id % 10 = 7").select(F.col("memory_id").alias("query_id"), F.col("E1").alias("q")).persist(), m.persist()


@pytest.mark.parametrize("block, tile", [(1000, 2**17), (4, 20), (1000, 1)])
def test_moments_are_those_of_all_pairs(sides, apart, monkeypatch, block, tile):
    monkeypatch.setattr(retrieval, "BLOCK", block)
    monkeypatch.setattr(retrieval, "TILE", tile)
    spaces = ("E8", *SPACES)
    for q, m in (sides, apart):
        pairs = retrieval.wide(q, m, spaces).toPandas()
        found = retrieval.moments(q, m, spaces).toPandas().set_index("query_id")
        assert sorted(found.index) == sorted(set(pairs["query_id"]))
        for i, own in pairs.groupby("query_id"):
            assert found.loc[i, "n"] == len(own)
            for a in spaces:
                for name in ("min", "max", "mean"):
                    assert found.loc[i, {"min": "low", "max": "high"}.get(name, name) + f"_{a}"] == pytest.approx(getattr(own[a], name)(), abs=1e-11)
                for b in (x for x in spaces if x >= a):
                    assert found.loc[i, f"of_{a}_{b}"] == pytest.approx(np.cov(own[a], own[b], bias=True)[0, 1] * len(own), abs=1e-9)


def test_correlations_of_moments(sides, long, apart):
    same(wide.correlated(retrieval.moments(*sides, SPACES), SPACES), fusion.correlations(long), "query_id", "a", "b")
    found = {(r.query_id, r.a, r.b): r.r for r in wide.correlated(retrieval.moments(*apart, SPACES), SPACES).collect()}
    assert np.isnan(found[7, "E1", "E5"]) and np.isnan(found[37, "E1", "E7"]) and not np.isnan(found[37, "E1", "E10"])


def test_weights_adapted_to_moments(sides, long, apart):
    same(wide.adapted(retrieval.moments(*sides, SPACES), SPACES, WEIGHTS), fusion.suppressed(long, WEIGHTS), "query_id", "space")
    mine = wide.adapted(retrieval.moments(*apart, SPACES), SPACES, WEIGHTS)
    same(mine, wide.suppressed(retrieval.wide(*apart, SPACES), SPACES, WEIGHTS), "query_id", "space")
    assert {r.w for r in mine.collect()} >= {0.5, 0.125}


@pytest.mark.parametrize("name", ["cross_space_correlation", "pattern_detection", "degenerate_suppression"])
def test_no_pair_leaves_a_task_to_be_correlated(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "corr(" not in plan and "var_samp" not in plan and "mean_E1" in plan


@pytest.mark.parametrize("how", ["none", "minmax", "zscore"])
@pytest.mark.parametrize("agg", ["max", "sum", "mean", "weighted"])
def test_scores_leave_a_task_without_their_spaces(sides, apart, monkeypatch, how, agg):
    monkeypatch.setattr(retrieval, "TILE", 50)
    for q, m in (sides, apart):
        theirs = wide.aggregate(wide.normalise(retrieval.wide(q, m, SPACES), SPACES, how), SPACES, agg, WEIGHTS)
        own = q if how == "none" else q.join(wide.bounds(retrieval.moments(q, m, SPACES), SPACES, how), "query_id")
        same(retrieval.scored(own, m, SPACES, wide.of_scores(SPACES, how, agg, WEIGHTS)), theirs, "query_id", "memory_id")


def test_scores_are_rounded_half_up():
    x = {"E1": np.array([[0.0078125, 0.1234564, 0.0, 1.0, 0.9999996]])}
    assert wide.of_scores(("E1",), "none", "max", None, 6)(x, None)[0].tolist() == [0.007813, 0.123456, 0.0, 1.0, 1.0]


@pytest.mark.parametrize("name", ["aggregate_none_max", "aggregate_minmax_mean", "aggregate_minmax_sum", "aggregate_zscore_mean", "aggregate_zscore_weighted"])
def test_a_pair_is_one_score(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "round(" not in plan and "Join" not in plan and "E10" not in plan


def test_vectors_travel_to_rankings_and_not_similarities(sides, monkeypatch):
    """What comes together for whole rankings is a row of vectors a part of the queries and run of memories; metrics of a ranking are a row a query."""
    q, m = sides
    labelled = lambda x, c: x.withColumn("label", F.when(F.col(c) != 13, F.col(c) % 3))
    sim = retrieval.similarities(q, m, ("E1",)).withColumn("sim", F.round("sim", 12))
    r = fusion.ranked(sim, ("query_id",)).join(labelled(m, "memory_id").select("memory_id", "label"), "memory_id").join(labelled(q, "query_id").select("query_id", F.col("label").alias("ql")), "query_id")
    want = metrics.per_query(r.select("query_id", "rank", (F.col("label") == F.col("ql")).cast("int").alias("grade")), 5)
    for name, value in (("BLOCK", 4), ("RUN", 7), ("RANKED", 120)):
        monkeypatch.setattr(retrieval, name, value)
    same(metrics.of_rankings(labelled(q, "query_id"), labelled(m, "memory_id"), "E1", "label", 5), want, "query_id")
    plan = retrieval.of_rankings(q, m, ("E1", "E7"), lambda *a: None, "query_id long")._jdf.queryExecution().toString()
    assert "low#" not in plan and "v#" in plan.split("FlatMapGroupsInPandas")[1]
