"""Approximate neighbours and stored indexes against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspace.operators import graph, neighbours, retrieval
from loomspace.sources import cells, codes

ROW = "memory_id long, E1 array<double>"


def clustered(n=900, dim=12, seed=0, groups=9):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(groups, dim))
    x = [centre[k % groups] + r.normal(size=dim) * 0.25 for k in range(n)]
    return [(int(k), v.tolist()) for k, v in enumerate(x)]


@pytest.fixture(scope="module")
def table(spark):
    rows = clustered() + [(5000, [0.0] * 12), (5001, clustered()[3][1]), (5002, None), (None, [1.0] * 12)]
    return spark.createDataFrame(rows, ROW).repartition(5).cache()


@pytest.fixture(scope="module")
def asked(table):
    return table.filter("memory_id % 41 = 0 or memory_id >= 5000").filter("E1 is not null").select(F.col("memory_id").alias("query_id"), F.col("E1").alias("q"))


def exact(table, k=10):
    """The best k of every memory by brute force, ties by the smaller id."""
    rows = {r.memory_id: np.array(r.E1) for r in table.collect() if r.memory_id is not None and r.E1 is not None}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids])
    size = np.linalg.norm(x, axis=1)
    some = size > 0
    u = x / np.where(some, size, 1)[:, None]
    sim = np.round(np.where(some[:, None] & some[None], (np.clip(u @ u.T, -1, 1) + 1) / 2, 0), 9)
    np.fill_diagonal(sim, -1)
    order = np.lexsort((np.broadcast_to(ids, sim.shape), -sim), axis=1)[:, :k]
    return {int(i): [(int(ids[j]), float(sim[a, j])) for j in own] for a, (i, own) in enumerate(zip(ids, order))}


def found(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((r.memory_id, round(r.score, 9)))
    return out


def same(got, want):
    """Equal up to the order of scores that differ in their last places."""
    assert set(got) == set(want)
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-9)
        last = want[q][-1][1]
        assert {m for m, s in got[q] if s > last + 1e-8} == {m for m, s in want[q] if s > last + 1e-8}


def test_descent_finds_most_neighbours(spark, table):
    edges = neighbours.nn_descent(table, 6, F.col("E1"), pool=12)
    got = {}
    for r in edges.collect():
        got.setdefault(r.source, {})[r.target] = r.sim
    want = exact(table, 6)
    assert set(got) == set(want) and all(len(v) == 6 for v in got.values())
    true = {(i, j): s for i, own in exact(table, 904).items() for j, s in own}
    assert all(abs(true[i, j] - s) < 1e-8 and i != j for i, own in got.items() for j, s in own.items())
    hits = sum(j in got[i] for i, own in want.items() for j, _ in own if i != 5000)
    assert hits >= 0.95 * 6 * (len(want) - 1)
    knn = graph.knn(table.filter("memory_id is not null and E1 is not null"), 6, F.col("E1"))
    r = neighbours.recall(edges, knn).first()
    assert r.n_exact == 6 * len(want) and r.recall >= 0.95


def test_descent_compares_fewer_pairs_than_all(spark, monkeypatch):
    """The pairs of a round grow with the memories, not with their square."""
    r = np.random.default_rng(3)
    sizes = []
    for n in (400, 1600):
        rows = [(int(k), r.normal(size=4).tolist()) for k in range(n)]
        frame = spark.createDataFrame(rows, ROW)
        own = neighbours.started(frame.select("memory_id", F.col("E1").alias("v")), n, 8, 2)
        sizes.append(own.count() / n)
    assert sizes[1] <= 1.2 * sizes[0]


def test_descent_of_few_repeated_and_no_rows(spark):
    few = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], ROW)
    assert {(r.source, r.target, r.sim) for r in neighbours.nn_descent(few, 3, F.col("E1")).collect()} == {(1, 2, 0.5), (2, 1, 0.5)}
    assert neighbours.nn_descent(few.limit(0), 3, F.col("E1")).collect() == []


def test_cells_hold_every_row_and_searches_prune(spark, table, asked, tmp_path):
    index = cells.CellIndex.build(table, F.col("E1"), str(tmp_path / "cells"), cells=24)
    rows = index.vectors().collect()
    assert sorted(r.memory_id for r in rows) == sorted(r.memory_id for r in table.collect() if r.memory_id is not None and r.E1 is not None)
    ids = {r.query_id for r in asked.collect()}
    want = {q: own for q, own in exact(table).items() if q in ids}
    same(found(index.search_exact(asked, 10, probes=2)), want)
    got = found(index.search(asked, 10))
    hits = sum(len({m for m, _ in got[q]} & {m for m, _ in own}) for q, own in want.items() if q != 5000)
    assert hits >= 0.9 * 10 * (len(want) - 1) and index.probes < 24
    plan = index.vectors(np.array([1, 2]))
    assert "PartitionFilters" in plan._jdf.queryExecution().toString() and 0 < len({f.split("cell=")[1].split("/")[0] for f in plan.inputFiles()}) <= 24
    read = plan.select("cell").distinct().collect()
    assert {r.cell for r in read} <= {1, 2}


def test_exact_cell_search_leaves_far_cells_unread(spark, tmp_path):
    frame = spark.createDataFrame(clustered(600, 12, 4, 6), ROW)
    index = cells.CellIndex.build(frame, F.col("E1"), str(tmp_path / "cells"), cells=6)
    q = neighbours.units(frame.filter("memory_id < 6").toPandas()["E1"])
    near = index._hits(np.arange(6), q, index._near(q, 1), 10)
    bar = near.groupBy("query_id").agg(F.min("sim").alias("s")).orderBy("query_id").toPandas()["s"].to_numpy()
    assert index._reach(q, bar).sum() < 6 * 6


def test_codes_search_the_same(spark, table, asked, tmp_path):
    index = codes.CodeIndex.build(table, F.col("E1"), str(tmp_path / "codes"), parts=6)
    assert index.codes().filter(F.octet_length("codes") == 6).count() == 902
    ids = {r.query_id for r in asked.collect()}
    want = {q: own for q, own in exact(table).items() if q in ids}
    same(found(index.search_exact(asked, table, F.col("E1"), 10)), want)
    got = found(index.search(asked, table, F.col("E1"), 10))
    equal = [q for q, own in want.items() if q != 5000 and {m for m, _ in got[q]} == {m for m, _ in own}]
    assert len(equal) >= 0.8 * (len(want) - 1)  # the stated share of queries with the same ten
    again = codes.CodeIndex(spark, index.path)  # the books are read from their table
    x = neighbours.units(table.filter("memory_id < 50").toPandas()["E1"])
    assert (codes.encoded(x, again.books) == codes.encoded(x, index.books)).all()


def test_exact_search_by_codes_shuffles_no_candidates(spark, tmp_path, monkeypatch):
    """Vectors without structure: nearly all pairs are candidates, of which each task hands out its best."""
    r = np.random.default_rng(4)
    rows = [(k, r.normal(size=64).tolist()) for k in range(600)] + [(601, [0.0] * 64), (602, None)]
    frame = spark.createDataFrame(rows, ROW).repartition(3)
    asked = frame.filter("memory_id % 100 = 1").select(F.col("memory_id").alias("query_id"), F.col("E1").alias("q"))
    index = codes.CodeIndex.build(frame, F.col("E1"), str(tmp_path / "codes"))
    sizes, top = [], codes.fusion.top
    monkeypatch.setattr(codes.fusion, "top", lambda df, *a, **b: sizes.append(df.count()) or top(df, *a, **b))
    got = found(index.search_exact(asked, frame, F.col("E1"), 5))
    assert len(got) == 7 and max(sizes) <= 7 * 120
    same(got, {q: own for q, own in exact(frame, 5).items() if q in got})


def test_codes_lose_less_with_more_parts(spark, tmp_path):
    frame = spark.createDataFrame(clustered(500, 12, 7), ROW)
    lost = [codes.CodeIndex.build(frame, F.col("E1"), str(tmp_path / f"c{p}"), parts=p).codes().agg(F.avg("lost")).first()[0] for p in (2, 4, 12)]
    assert lost[0] > lost[1] > lost[2]


def test_searches_without_rows_or_queries(spark, tmp_path):
    none = spark.createDataFrame([], ROW)
    index = cells.CellIndex.build(none, F.col("E1"), str(tmp_path / "cells"))
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, q array<double>")
    assert index.search(asked.limit(0)).collect() == []
    with pytest.raises(ValueError, match="no vectors"):
        codes.CodeIndex.build(none, F.col("E1"), str(tmp_path / "codes"))


def test_queries_agree_with_retrieval(spark):
    frame = spark.createDataFrame(clustered(200, 64, 2), ROW)
    asked = frame.filter("memory_id % 20 = 0").select(F.col("memory_id").alias("query_id"), F.col("E1").alias("q"))
    want = found(retrieval.single_space(asked, frame, "E1", 10))
    assert len(want) == 10 and all(len(v) == 10 for v in want.values())


def test_lists_without_structure_are_exact_below_few(spark):
    """Random vectors: rounds over short lists miss neighbours, blocks of products don't."""
    r = np.random.default_rng(8)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(r.normal(size=(700, 64)))], "memory_id long, E1 array<double>").persist()
    exact = graph.knn(table, 5, F.col("E1"))
    share = lambda few: neighbours.recall(neighbours.nn_descent(table, 5, F.col("E1"), pool=5, rounds=2, few=few), exact).first()["recall"]
    assert share(0) < 0.9 and share(700) == 1.0
