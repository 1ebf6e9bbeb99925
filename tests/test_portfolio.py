"""Saved portfolios come back as they were."""

import datetime as dt

import pytest

from loomspace.sources.portfolio import PortfolioStore


def test_saves_and_restores(spark, tmp_path):
    at = lambda k: dt.datetime(2024, 1, k)
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "memory_id long, topic long")
    profiles = spark.createDataFrame([(1, "E1", 1.0), (1, "E7", 1.0), (1, "E10", 0.75), (1, "E2", 0.9), (3, "E1", 0.5)], "topic long, space string, strength double")
    store = PortfolioStore(spark, str(tmp_path / "p"))
    assert store.latest() is None
    assert store.save(members, profiles, "a", at(1), 0, churn=1.7)
    assert store.save(members.filter("topic = 3"), profiles.filter("topic = 3"), "b", at(2), 1, churn=float("nan"), entropy=-1.0)
    assert not store.save(members.limit(0), profiles.limit(0), "a", at(3), 0)
    assert (store.latest("a"), store.latest("b"), store.latest(), store.latest("c")) == (0, 1, 1, None)
    assert {r.batch: (r.session_id, r.churn, r.entropy, r.unstable) for r in store.saves().collect()} == {0: ("a", 1.0, 1.0, True), 1: ("b", 0.0, 0.0, False)}
    again = PortfolioStore(spark, store.path)
    own, parts = again.restored(0)
    assert sorted(map(tuple, own.collect())) == [(1, 1), (2, 1), (3, 3), (4, 3)] and {r.space for r in parts.collect()} == {"E1", "E7", "E10"}
    assert {r.topic: (r.size, r.agreement, r.valid) for r in again.summary(0).collect()} == {1: (2, pytest.approx(2.75), True), 3: (2, pytest.approx(0.5), False)}
    assert [r.topic for r in again.summary(1).collect()] == [3]
