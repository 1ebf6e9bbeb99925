"""Saved topic portfolios: members, profiles and stability of a session's topics, each save a batch that can be restored."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import topics
from ..plans import weights as ws
from ..session import written
from .batches import BatchStore

MEMBERS = "memory_id long, topic long"
PROFILES = "topic long, space string, strength double"
METRICS = "session_id string, churn double, entropy double, saved_at timestamp"
UNSTABLE = 0.5  #: churn from which a portfolio counts as unstable


def clamped(x: Column) -> Column:
    """Within [0, 1], 0 for what is no number."""
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


class PortfolioStore(BatchStore):
    def save(self, members: DataFrame, profiles: DataFrame, session_id: str, saved_at: dt.datetime, batch: int, churn: float = 0.0, entropy: float | None = None) -> bool:
        """Write the topics (memory_id, topic) and profiles (topic, space, strength) of a session; False if the batch is already in. Without
        an entropy it is that of the members."""
        if batch in self.committed():
            return False
        members = written(members.select("memory_id", "topic"))
        metrics = self.spark.createDataFrame([(session_id, float(churn), None if entropy is None else float(entropy), saved_at)], METRICS)
        own = topics.entropy(members).select(F.col("entropy").alias("own"))
        metrics = metrics.crossJoin(F.broadcast(own)).select("session_id", clamped(F.col("churn")).alias("churn"), clamped(F.coalesce("entropy", "own")).alias("entropy"), "saved_at")
        self._write(members, "members", batch)
        self._write(profiles.select("topic", "space", F.col("strength").cast("double").alias("strength")), "profiles", batch)
        self._write(metrics.coalesce(1), "metrics", batch)
        self._commit(batch)
        return True

    def saves(self) -> DataFrame:
        """(batch, session_id, churn, entropy, saved_at, unstable) of every save."""
        return self._rows("metrics", METRICS).withColumn("unstable", F.col("churn") >= UNSTABLE)

    def latest(self, session_id: str | None = None) -> int | None:
        """The last save, of a session or of all."""
        own = self.saves() if session_id is None else self.saves().filter(F.col("session_id") == session_id)
        return own.agg(F.max_by("batch", F.struct("saved_at", "batch"))).first()[0]

    def restored(self, batch: int) -> tuple[DataFrame, DataFrame]:
        """Members and profiles of a save; spaces without a category weight, as the temporal ones, are left out."""
        profiles = self._rows("profiles", PROFILES).filter(F.col("batch") == batch).filter(ws.looked_up(F.col("space"), ws.CATEGORY) > 0)
        return self._rows("members", MEMBERS).filter(F.col("batch") == batch).drop("batch"), profiles.drop("batch")

    def summary(self, batch: int) -> DataFrame:
        """(topic, size, agreement, confidence, valid) of a save's topics; valid ones agree by 2.5 or more."""
        members, profiles = self.restored(batch)
        size = members.groupBy("topic").agg(F.count("*").alias("size"))
        return topics.agreement(profiles).join(size, "topic").withColumn("valid", F.col("agreement") >= ws.AGREEMENT)
