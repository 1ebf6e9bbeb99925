"""A stored index of vectors in k-means cells: one Parquet partition a cell, so that a search reads the cells it probes and no others.

Centres are fitted on a bounded sample (``SAMPLE`` rows, the least by the hash of their id); every row is indexed. A cell of many rows is
written by several tasks. Two searches share the files:

``search`` probes the cells whose centres are nearest to a query: not exact. How many is measured when the index is built: the least
number that holds ``RECALL`` of the exact ``TUNED_K`` nearest of ``TUNED`` of its rows, taken by hash. Vectors with clusters need few.

``search_exact`` gives the exact best k. A cell keeps its radius, the greatest angle between its centre and a row, so the angle
between query and centre less the radius bounds every row's from below; cells whose bound can't reach the k-th best of the probed
cells are left out, and all others are read in a second step. It saves reading where the vectors have clusters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fusion
from ..operators.neighbours import mapped, units
from ..operators.retrieval import ROWS, blocks

SAMPLE = 20_000
MOST_CELLS = 4096
PER_FILE = 250_000
TUNED, TUNED_K, RECALL = 64, 10, 0.95
ROW = "memory_id long, v array<double>, angle double, cell int"
HITS = "query_id long, memory_id long, sim double"


def fitted(x: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Centres of spherical k-means of unit rows; first ones are rows far apart, empty cells take the worst placed row."""
    centre = [x[0]]
    worst = x @ x[0]
    for _ in range(1, min(cells, len(x))):
        centre.append(x[int(worst.argmin())])
        worst = np.maximum(worst, x @ centre[-1])
    c = np.array(centre)
    for _ in range(rounds):
        sim = x @ c.T
        own = sim.argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(c)) == 0)
        total[empty] = x[np.argsort(sim.max(axis=1), kind="stable")[: len(empty)]]
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.divide(total, size, out=c.copy(), where=size > 0)
    return c


class CellIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        held = spark.read.parquet(f"{self.path}/centres").orderBy("cell").toPandas()  # at most MOST_CELLS rows
        self.cells = held["cell"].to_numpy()
        self.centres, self.radius = np.stack(held["centre"].to_numpy()), held["radius"].to_numpy()
        try:
            self.probes = spark.read.parquet(f"{self.path}/probes").first()["probes"]
        except AnalysisException:  # while it is being built
            self.probes = len(self.cells)

    @classmethod
    def build(cls, memories: DataFrame, vector: Column, path: str, cells: int | None = None, sample: int = SAMPLE) -> CellIndex:
        """Index all memories (memory_id and ``vector``) under ``path``."""
        spark, path = memories.sparkSession, path.rstrip("/")
        own = memories.select("memory_id", vector.alias("v")).filter("memory_id is not null and v is not null")
        n = own.count()
        cells = max(1, min(MOST_CELLS, cells or round(n**0.5)))
        rows = own.orderBy(F.xxhash64("memory_id"), "memory_id").limit(sample).toPandas()
        centres = fitted(units(rows["v"]), cells) if len(rows) else np.zeros((1, 1))

        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), ROWS):
                    part = batch.iloc[at : at + ROWS]
                    sim = units(part["v"]) @ centres.T
                    cell = sim.argmax(axis=1)
                    angle = np.arccos(np.clip(sim[np.arange(len(cell)), cell], -1, 1))
                    yield pd.DataFrame({"memory_id": part["memory_id"], "v": part["v"], "angle": angle, "cell": cell.astype("int32")})

        dealt = own.mapInPandas(placed, ROW)
        # rebalancing brings the rows of a cell together and splits a large one
        dealt.hint("rebalance", "cell").write.mode("overwrite").option("maxRecordsPerFile", PER_FILE).partitionBy("cell").parquet(f"{path}/vectors")
        held = spark.read.schema(ROW).parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
        table = list(enumerate(centres.tolist()))
        whole = spark.createDataFrame(table, "cell int, centre array<double>").join(held, "cell", "left")
        whole.select("cell", "centre", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("radius", F.lit(0.0)).alias("radius")).coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        index = cls(spark, path)
        spark.createDataFrame([(index._tuned(rows.head(TUNED)),)], "probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/probes")
        return cls(spark, path)

    def _tuned(self, rows: pd.DataFrame) -> int:
        if not len(rows):
            return len(self.cells)
        ids, q = rows["memory_id"].to_numpy("int64"), units(rows["v"])
        near = _ranked(self._hits(ids, q, np.ones((len(ids), len(self.cells)), bool), TUNED_K), TUNED_K)
        met = self.vectors().select("memory_id", "cell").join(F.broadcast(near.select("query_id", "memory_id")), "memory_id").toPandas()  # TUNED * TUNED_K rows
        place = np.argsort(np.argsort(-(q @ self.centres.T), axis=1, kind="stable"), axis=1)  # of each cell in a query's order
        number, query = {int(c): j for j, c in enumerate(self.cells)}, {int(i): k for k, i in enumerate(ids)}
        need = np.sort([place[query[i], number[c]] for i, c in zip(met["query_id"], met["cell"])])
        return int(need[min(len(need) - 1, int(np.ceil(RECALL * len(need))) - 1)]) + 1 if len(need) else len(self.cells)

    def vectors(self, cells: np.ndarray | None = None) -> DataFrame:
        """The rows of some cells, read from their partitions alone."""
        own = self.spark.read.schema(ROW).parquet(f"{self.path}/vectors")
        return own if cells is None else own.filter(F.col("cell").isin([int(self.cells[c]) for c in cells]))

    def _hits(self, ids: np.ndarray, q: np.ndarray, wanted: np.ndarray, k: int) -> DataFrame:
        """The best k of each query among the cells that ``wanted`` (query, cell) marks; a batch shuffles its own best k."""
        number = {int(c): j for j, c in enumerate(self.cells)}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for cell, rows in batch.groupby("cell", sort=True):
                    asked = np.flatnonzero(wanted[:, number[int(cell)]])
                    rows = rows.sort_values("memory_id")
                    for at in range(0, len(rows), ROWS):
                        part = rows.iloc[at : at + ROWS]
                        m, own = units(part["v"]), part["memory_id"].to_numpy()
                        p = q[asked]
                        sim = mapped(p @ m.T, p.any(axis=1)[:, None] & m.any(axis=1)[None])
                        sim[ids[asked][:, None] == own[None]] = -1
                        best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                        i = np.repeat(np.arange(len(asked)), best.shape[1])
                        out = pd.DataFrame({"query_id": ids[asked][i], "memory_id": own[best.ravel()], "sim": sim[i, best.ravel()]})
                        yield out[out["sim"] >= 0]

        return self.vectors(np.flatnonzero(wanted.any(axis=0))).select("memory_id", "v", "cell").mapInPandas(run, HITS)

    def _near(self, q: np.ndarray, probes: int) -> np.ndarray:
        order = np.argsort(-(q @ self.centres.T), axis=1, kind="stable")[:, :probes]
        wanted = np.zeros((len(q), len(self.cells)), bool)
        np.put_along_axis(wanted, order, True, axis=1)
        return wanted

    def _asked(self, queries: DataFrame):
        for block in blocks(queries.select("query_id", "q")):
            rows = block.toPandas()
            if len(rows):
                yield rows["query_id"].to_numpy("int64"), units(rows["q"])

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """(query_id, memory_id, score, rank): the best k of the nearest cells, ``probes`` or as many as the build found, for queries
        (query_id, q)."""
        probes = probes or self.probes
        out = self.spark.createDataFrame([], HITS)
        for ids, q in self._asked(queries):
            out = out.unionByName(self._hits(ids, q, self._near(q, probes), k))
        return _ranked(out, k)

    def search_exact(self, queries: DataFrame, k: int = 10, probes: int = 8) -> DataFrame:
        """The best k of all memories, cells that can't hold any left unread."""
        out = self.spark.createDataFrame([], HITS)
        for ids, q in self._asked(queries):
            first = self._near(q, probes)
            found = _ranked(self._hits(ids, q, first, k), k).select("query_id", "memory_id", F.col("score").alias("sim"))
            last = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("sim").alias("sim")).toPandas().set_index("query_id")  # a row a query of the block
            bar = np.array([last["sim"].get(i, 0.0) if last["n"].get(i, 0) >= k else 0.0 for i in ids.tolist()])
            more = self._reach(q, bar) & ~first
            out = out.unionByName(found).unionByName(self._hits(ids, q, more, k))
        return _ranked(out, k)

    def _reach(self, q: np.ndarray, bar: np.ndarray) -> np.ndarray:
        """Cells that may hold a mapped cosine of ``bar``; vectors without length are everywhere."""
        angle = np.arccos(np.clip(q @ self.centres.T, -1, 1)) - self.radius[None]
        bound = (np.cos(np.clip(angle, 0, np.pi)) + 1) / 2
        return (bound + 1e-9 >= bar[:, None]) | ~q.any(axis=1)[:, None]


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    return fusion.top(hits.withColumnRenamed("sim", "score"), k, ("query_id",), "score")
