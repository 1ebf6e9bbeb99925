"""Cluster features (n, linear sum, square sum) that merge: a tree's leaves a partition, joined up in rounds.

A vector or feature joins the nearest leaf if the joint radius stays within the threshold, else it opens one. Beyond ``most`` leaves the
threshold is raised, at least to the radius at which the two nearest leaves join, and the leaves are inserted anew, until a quarter
of the places is free. So the threshold adapts to the number of clusters that is asked for, and a task holds ``most`` leaves of its
own, or ``fan`` times as many while it joins those of others. Sums are never lost: n, linear and square sums over all leaves are those of the
data, whatever the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

THRESHOLD, MOST, FAN = 0.3, 256, 16
LEAVES = "part int, n long, ls array<double>, ss double, threshold double"


class Features:
    """Leaves in the order of their creation; ``ids`` stay theirs, and joined ones keep the smaller."""

    def __init__(self, threshold: float = THRESHOLD, most: int = MOST):
        self.threshold, self.most, self.made = threshold, most, 0
        self.n, self.ss, self.ids, self.ls = np.zeros(0), np.zeros(0), np.zeros(0, np.int64), None

    def add(self, n: float, ls: np.ndarray, ss: float, name: int | None = None) -> int:
        """The id of the leaf that the feature is in now."""
        if not np.isfinite(ls).all():
            raise ValueError("vectors must be finite")
        if self.ls is None:
            self.ls = np.zeros((0, len(ls)))
        if len(self.n):
            far = ((self.ls / self.n[:, None] - ls / n) ** 2).sum(1)
            k = int(far.argmin())
            if radius(self.n[k] + n, self.ls[k] + ls, self.ss[k] + ss) <= self.threshold:
                self.n[k] += n
                self.ls[k] += ls
                self.ss[k] += ss
                if name is not None:
                    self.ids[k] = min(self.ids[k], name)
                return int(self.ids[k])
        if name is None:
            name, self.made = self.made, self.made + 1
        self.n, self.ss, self.ids = np.append(self.n, n), np.append(self.ss, ss), np.append(self.ids, name)
        self.ls = np.vstack([self.ls, ls])
        if len(self.n) > self.most:
            at = ls / n
            self._widen()
            return int(self.ids[int(((self.ls / self.n[:, None] - at) ** 2).sum(1).argmin())])
        return name

    def _widen(self) -> None:
        """A greater threshold, until a quarter of the leaves' places is free."""
        while len(self.n) > max(1, self.most * 3 // 4):
            own = list(zip(self.n, self.ls, self.ss, self.ids))
            self.threshold = max(1.25 * self.threshold, self._nearest())
            self.n, self.ss, self.ids, self.ls = np.zeros(0), np.zeros(0), np.zeros(0, np.int64), None
            most, self.most = self.most, len(own)
            for n, ls, ss, name in own:
                self.add(n, ls.copy(), ss, name)
            self.most = most

    def _nearest(self) -> float:
        """The radius at which the two nearest leaves join."""
        c = self.ls / self.n[:, None]
        far = (c * c).sum(1)[:, None] - 2 * c @ c.T + (c * c).sum(1)[None]
        np.fill_diagonal(far, np.inf)
        i, j = np.unravel_index(int(far.argmin()), far.shape)
        return radius(self.n[i] + self.n[j], self.ls[i] + self.ls[j], self.ss[i] + self.ss[j]) * (1 + 1e-12)

    def rows(self, part: int) -> pd.DataFrame:
        return pd.DataFrame({"part": np.full(len(self.n), part, np.int32), "n": self.n.astype(np.int64), "ls": [] if self.ls is None else self.ls.tolist(), "ss": self.ss, "threshold": self.threshold})


def radius(n: float, ls: np.ndarray, ss: float) -> float:
    return float(np.sqrt(max(0.0, ss / n - float(ls @ ls) / n / n)))


def features(vectors: DataFrame, vector: Column, threshold: float = THRESHOLD, most: int = MOST, fan: int = FAN) -> DataFrame:
    """(n, ls, ss, threshold): at most ``most`` features of all vectors; null vectors are skipped."""

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Features(threshold, most)
        for batch in batches:
            for x in batch["v"]:
                own.add(1.0, np.array(x, float), float(np.dot(x, x)))
        yield own.rows(TaskContext.get().partitionId())

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        own = Features(float(rows["threshold"].max()), most)
        order = np.lexsort((rows["ls"].map(lambda x: x[0]), -rows["n"]))  # large leaves first
        for k in order:
            own.add(float(rows["n"].iloc[k]), np.array(rows["ls"].iloc[k]), float(rows["ss"].iloc[k]))
        return own.rows(int(rows["part"].iloc[0]))

    made = written(vectors.select(vector.alias("v")).filter("v is not null").mapInPandas(leaves, LEAVES))
    parts = made.agg(F.max("part")).first()[0] or 0
    while parts:
        made = written(made.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy("part").applyInPandas(joined, LEAVES))
        parts //= fan
    return made.select("n", "ls", "ss", "threshold")


def clusters(found: DataFrame) -> DataFrame:
    """(cluster, n, centroid, radius) of features, numbered by size."""
    norm = F.aggregate("ls", F.lit(0.0), lambda a, x: a + x * x)
    r = F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - norm / F.col("n") / F.col("n")))
    own = found.select("n", F.transform("ls", lambda x: x / F.col("n")).alias("centroid"), r.alias("radius"))
    every = own.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "centroid", "n", "radius"))).alias("all"))  # at most MOST rows
    return every.select(F.posexplode("all").alias("cluster", "x")).select("cluster", "x.n", "x.centroid", "x.radius")
