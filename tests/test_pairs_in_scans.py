"""Queries over all pairs whose scores, counts and masks come from the scan: no row for a pair and space is made."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspace.catalog import QUERIES
from loomspace.functions import temporal as tf
from loomspace.functions import vectors as v
from loomspace.operators import entities, fusion, retrieval, wide
from loomspace.plans import weights as ws

SPACES = ("E1", "E5", "E7", "E8", "E9", "E10")
DATA = "/root/testdata/sf0.001"
#: finding: query
SCANNED = [
    "embedder_masks",
    "matching_spaces",
    "relevance_score",
    "matrix_weighted_score",
    "relevant_filter",
    "result_coherence",
    "search_matrix_presets",
    "semantic_fusion",
    "search_by_tokens",
    "synergy_boost",
    "temporal_badges",
    "threshold_hits",
    "weighted_agreement",
    "search_by_entities",
]


@pytest.fixture(scope="module")
def sides(spark):
    x = np.random.default_rng(5).normal(size=(70, 64)).round(1)
    x[40:60] = x[:20]  # copies, so that scores tie
    x[9] = 0
    m = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "memory_id long, E1 array<double>").repartition(3)
    return m.filter("memory_id % 10 in (7, 9)").select(F.col("memory_id").alias("query_id"), F.col("E1").alias("q")).persist(), m.persist()


@pytest.fixture(scope="module")
def long(sides):
    return retrieval.similarities(*sides, SPACES).withColumn("sim", F.round("sim", 12)).persist()


@pytest.fixture(autouse=True)
def small(monkeypatch):
    for name, value in (("BLOCK", 5), ("TILE", 60)):
        monkeypatch.setattr(retrieval, name, value)


def rows(df, *keys):
    return {tuple(r[k] for k in keys): tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in df.columns if c not in keys) for r in df.collect()}


@pytest.mark.parametrize("name", SCANNED)
def test_no_pair_is_a_row_of_the_plan(spark, monkeypatch, name):
    def never(*args):
        raise AssertionError("a row for every pair")

    for kernel in ("pairs", "long", "wide"):
        monkeypatch.setattr(retrieval, kernel, never)
    assert QUERIES[name](spark, DATA).count() > 0


def test_best_by_scores(sides, long):
    weights, matrix = {"E1": 0.5, "E5": 0.2, "E7": 0.3}, {("E1", "E1"): 1.0, ("E1", "E10"): 0.5}
    q, m = sides
    adapted = q.join(wide.adapted_to(retrieval.moments(q, m, SPACES), SPACES, weights), "query_id")
    both = {
        "relevance": (wide.of_relevance(SPACES), fusion.relevance(long)), "matrix": (wide.of_matrix(matrix), fusion.matrix_score(long, matrix)),
        "synergy": (wide.of_synergy(SPACES, weights), fusion.synergy_boost(long, weights)), "semantic": (wide.of_semantics(SPACES), fusion.semantic_fusion(long, fusion.suppressed(long, weights))),
    }
    mine = retrieval.bests(adapted, m, SPACES, {n: f for n, (f, _) in both.items()}, 7)
    for name, (_, theirs) in both.items():
        want = rows(fusion.top(theirs.withColumn("score", F.round("score", 12)), 7), "query_id", "rank")
        assert rows(mine.filter(F.col("name") == name).select("query_id", "memory_id", "score", "rank"), "query_id", "rank") == want and want


def test_best_by_tokens(sides):
    parts = [(1 + 16 * k, 16) for k in range(4)]
    tokens = lambda c: F.array(*(F.slice(c, a, n) for a, n in parts))
    s = retrieval.pairs(*sides).select("query_id", "memory_id", F.round(v.max_sim(tokens(F.col("q")), tokens(F.col("E1"))), 12).alias("score"))
    spaces, score = wide.of_tokens(parts, 0.6)
    want = rows(fusion.top(s.filter("score >= 0.6"), 9), "query_id", "rank")
    assert rows(retrieval.best(*sides, spaces, score, 9), "query_id", "rank") == want and want


def test_masks_and_badges(sides, long):
    mine = retrieval.reached(*sides, SPACES, lambda s: wide.masked(s, SPACES))
    want = fusion.agreement(long).filter("mask <> 0").select("query_id", "memory_id", F.col("mask").cast("long").alias("mask"))
    assert rows(mine, "query_id", "memory_id") == rows(want, "query_id", "memory_id")
    got = retrieval.reached(*sides, ("E7", "E9", "E8"), lambda s: tf.badge_bits(s["E7"], s["E9"], s["E8"])).select("query_id", "memory_id", tf.badges_of(F.col("mask")).alias("b"))
    s = long.groupBy("query_id", "memory_id").pivot("space", list(SPACES)).max("sim")
    want = s.select("query_id", "memory_id", tf.badges(F.col("E7"), F.col("E9"), F.col("E8")).alias("b")).filter(F.size("b") > 0)
    assert rows(got, "query_id", "memory_id") == rows(want, "query_id", "memory_id")


def test_sums_of_a_query(sides, long):
    def counted(s, other):
        return np.stack([(wide.coherent(s, SPACES) * other).sum(axis=1), ((wide.masked(s, SPACES) != 0) & other).sum(axis=1)], axis=1)

    mine = retrieval.added(*sides, SPACES, ["total", "hits"], counted)
    want = fusion.coherence(long).join(fusion.agreement(long).groupBy("query_id").agg(F.count(F.when(F.col("mask") != 0, 1)).alias("hits")), "query_id")
    assert rows(mine.select("query_id", (F.col("total") / F.col("n")).alias("coherence"), F.col("hits").cast("long").alias("hits")), "query_id") == rows(want, "query_id")
    assert {r.n for r in mine.collect()} == {69} and ws.HIGH["E1"] == 0.75


def test_best_by_shared_entities(spark, sides, long):
    names, r = ["ada", "berlin", "c-3", "d_4", "e"], np.random.default_rng(6)
    es = spark.createDataFrame([(i, [x for x in names if r.random() < 0.4]) for i in range(70)], "memory_id long, es array<string>").filter(F.size("es") > 0)
    m = sides[1].join(es, "memory_id")
    q = sides[0].join(es.select(F.col("memory_id").alias("query_id"), F.col("es").alias("qs")), "query_id")
    s = retrieval.long(retrieval.pairs(*sides), ("E1", "E11")).withColumn("sim", F.round("sim", 12)).groupBy("query_id", "memory_id").pivot("space", ["E1", "E11"]).max("sim")
    s = s.join(q.select("query_id", "qs"), "query_id").join(es, "memory_id").filter(entities.match(F.col("qs"), F.col("es")))
    score = F.round(entities.combined(F.col("E1"), F.col("E11"), v.jaccard(F.col("qs"), F.col("es"))), 12)
    want = rows(fusion.top(s.select("query_id", "memory_id", score.alias("score")), 6), "query_id", "rank")
    assert rows(retrieval.best(q, m, ("E1", "E11"), entities.Shared(), 6), "query_id", "rank") == want and want


def test_chosen_pairs_do_not_go_through_the_driver(sides):
    """What is broadcast are a block's queries, and not the pairs that were chosen for them."""
    q, m = sides
    chosen = q.select("query_id").crossJoin(m.select("memory_id")).filter("(query_id + memory_id) % 3 = 0 and query_id <> memory_id")
    met = retrieval.met(chosen, q, m)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("leftHint=(strategy=broadcast)") + plan.count("rightHint=(strategy=broadcast)") == 2 * plan.count("(strategy=merge)") > 2
    same = lambda x: sorted((r.query_id, r.memory_id, tuple(r.q), tuple(r.E1)) for r in x.collect())
    assert same(met.select("query_id", "memory_id", "q", "E1")) == same(chosen.join(q, "query_id").join(m, "memory_id"))
