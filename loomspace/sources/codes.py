"""Product-quantised vectors: codebooks kept as a table, codes of a byte a part, and searches over the codes.

Codebooks are fitted by k-means a part on a bounded sample (``SAMPLE`` rows, the least by the hash of their id) and written; every row is
encoded. A search makes a table of part products a query (parts * 256 numbers) and adds up looked-up numbers per row, so a scan
reads the codes, an eighth of a byte a bit of the vectors, and the vectors of the candidates alone.

``search`` re-ranks the ``held`` best candidates by their vectors: recall is to be measured. ``search_exact`` meets every row whose
product with the decoded vector, plus the length of what decoding loses, reaches the least product of the k best by codes: by Cauchy's
inequality no row of the best k is left out. Codes and vectors lie in one row there, as those candidates are many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fusion
from ..operators.neighbours import mapped, units
from ..operators.retrieval import ROWS, TILE, blocks, first
from ..session import written

SAMPLE = 20_000
LEVELS = 256
MANY = 16  #: where so great a share of the pairs is met, one in so many, a product of matrices is the way


def book(x: np.ndarray, levels: int = LEVELS, rounds: int = 10) -> np.ndarray:
    """Centres of k-means of the rows, the first ones spread over the rows in their order."""
    c = x[np.unique(np.linspace(0, len(x) - 1, min(levels, len(x))).astype(int))].copy()
    for _ in range(rounds):
        far = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]
        own = far.argmin(axis=1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def encoded(x: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """The nearest level of each part."""
    out, at = np.empty((len(x), len(books)), np.uint8), 0
    for k, c in enumerate(books):
        own = x[:, at : at + c.shape[1]]
        out[:, k] = ((c * c).sum(1)[None] - 2 * own @ c.T).argmin(axis=1)
        at += c.shape[1]
    return out


def decoded(codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([c[codes[:, k]] for k, c in enumerate(books)], axis=1)


class CodeIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        held = spark.read.parquet(f"{self.path}/books").orderBy("part", "level").toPandas()  # parts * 256 rows
        self.books = [np.stack(rows["centre"].to_numpy()) for _, rows in held.groupby("part", sort=True)]

    @classmethod
    def build(cls, memories: DataFrame, vector: Column, path: str, parts: int = 16, sample: int = SAMPLE) -> CodeIndex:
        """Fit, write and encode all memories (memory_id and ``vector``) under ``path``."""
        spark, path = memories.sparkSession, path.rstrip("/")
        own = memories.select("memory_id", vector.alias("v")).filter("memory_id is not null and v is not null")
        rows = own.orderBy(F.xxhash64("memory_id"), "memory_id").limit(sample).toPandas()
        if not len(rows):
            raise ValueError("no vectors to fit codebooks on")
        books = [book(x) for x in np.array_split(units(rows["v"]), parts, axis=1)]
        table = [(k, j, c.tolist()) for k, b in enumerate(books) for j, c in enumerate(b)]
        spark.createDataFrame(table, "part int, level int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/books")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), ROWS):
                    part = batch.iloc[at : at + ROWS]
                    x = units(part["v"])
                    codes = encoded(x, books)
                    lost = np.linalg.norm(x - decoded(codes, books), axis=1)
                    yield pd.DataFrame({"memory_id": part["memory_id"], "codes": [c.tobytes() for c in codes], "lost": lost.astype("float64"), "none": ~x.any(axis=1)})

        own.mapInPandas(run, "memory_id long, codes binary, lost double, none boolean").write.mode("overwrite").parquet(f"{path}/codes")
        return cls(spark, path)

    def codes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/codes")

    def _best(self, ids: np.ndarray, q: np.ndarray, n: int) -> DataFrame:
        """The n best by their codes, of each task; a row without length counts as 0."""
        books = self.books

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            near, held = _products(q, books), np.full((len(ids), n), -np.inf)
            for rows in _tiles(batches, len(ids)):
                value, own = near(rows), rows["memory_id"].to_numpy("int64")
                value[:, rows["none"].to_numpy()] = -1.0
                value[ids[:, None] == own[None]] = -np.inf
                i, j, value = first(value, held, own)
                yield pd.DataFrame({"query_id": ids[i], "memory_id": own[j], "sim": value})

        return fusion.top(self.codes().mapInPandas(run, "query_id long, memory_id long, sim double"), n, ("query_id",), "sim")

    def _reach(self, rows: DataFrame, ids: np.ndarray, q: np.ndarray, bar: np.ndarray, k: int) -> DataFrame:
        """The k best of each task among rows that reach ``bar`` or what the task has found, by their products with the decoded vectors and what
        decoding loses; those alone are met by their vectors, in the scan, so that no candidate is shuffled."""
        books, known = self.books, q.any(axis=1)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            near, held = _products(q, books), np.full((len(ids), k), -np.inf)
            for part in _tiles(batches, len(ids)):
                own, none, v = part["memory_id"].to_numpy("int64"), part["none"].to_numpy(), units(part["v"])
                value = near(part) + part["lost"].to_numpy()[None]
                value[:, none] = -1.0
                low = np.maximum(bar, np.where(known, 2 * held.min(axis=1) - 1, -np.inf))
                met = (value + 1e-9 >= low[:, None]) & (ids[:, None] != own[None])
                i, j = np.nonzero(met)
                cos = (q @ v.T)[i, j] if len(i) * MANY > met.size else np.einsum("ij,ij->i", q[i], v[j])
                sim = np.full(met.shape, -np.inf)
                sim[i, j] = mapped(cos, known[i] & ~none[j])
                i, j, sim = first(sim, held, own)
                yield pd.DataFrame({"query_id": ids[i], "memory_id": own[j], "score": sim})

        return fusion.top(rows.mapInPandas(run, "query_id long, memory_id long, score double"), k)

    def _asked(self, queries: DataFrame):
        for block in blocks(queries.select("query_id", "q")):
            rows = block.toPandas()
            if len(rows):
                yield block, rows["query_id"].to_numpy("int64"), units(rows["q"])

    def _reranked(self, found: DataFrame, queries: DataFrame, memories: DataFrame, vector: Column, k: int) -> DataFrame:
        """Candidates by their vectors: they meet the memories' vectors and a block of queries."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                if len(rows):
                    a, b = units(rows["q"]), units(rows["v"])
                    sim = mapped((a * b).sum(1), a.any(axis=1) & b.any(axis=1))
                    yield pd.DataFrame({"query_id": rows["query_id"], "memory_id": rows["memory_id"], "score": sim})

        own = memories.select("memory_id", vector.alias("v")).join(found.select("query_id", "memory_id"), "memory_id").join(F.broadcast(queries.select("query_id", "q")), "query_id")
        return fusion.top(own.select("query_id", "memory_id", "q", "v").mapInPandas(run, "query_id long, memory_id long, score double"), k, ("query_id",), "score")

    def search(self, queries: DataFrame, memories: DataFrame, vector: Column, k: int = 10, held: int = 100) -> DataFrame:
        """(query_id, memory_id, score, rank): the best k of the ``held`` best by codes."""
        out = None
        for block, ids, q in self._asked(queries):
            own = self._reranked(self._best(ids, q, held), block, memories, vector, k)
            out = own if out is None else out.unionByName(own)
        return out if out is not None else _none(self.spark)

    def search_exact(self, queries: DataFrame, memories: DataFrame, vector: Column, k: int = 10) -> DataFrame:
        """The best k of all memories."""
        out = None
        rows = written(self.codes().join(memories.select("memory_id", vector.alias("v")), "memory_id"))  # read by every block
        for block, ids, q in self._asked(queries):
            few = self._reranked(self._best(ids, q, k), block, memories, vector, k)
            low = few.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("score")).toPandas().set_index("query_id")  # a row a query
            bar = np.array([2 * low["score"].get(i, -np.inf) - 1 if low["n"].get(i, 0) >= k else -np.inf for i in ids.tolist()])
            bar[~q.any(axis=1)] = -np.inf
            own = self._reach(rows, ids, q, bar, k)
            out = own if out is None else out.unionByName(own)
        return out if out is not None else _none(self.spark)


def _tiles(batches: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    """Rows of codes in the order of ids, so many at once that they and ``n`` queries are a tile of pairs."""
    step = min(ROWS, max(1, TILE // max(1, n)))
    for batch in batches:
        batch = batch.sort_values("memory_id")
        for at in range(0, len(batch), step):
            yield batch.iloc[at : at + step]


def _products(q: np.ndarray, books: list[np.ndarray]):
    """Products of queries with the decoded vectors of rows of codes."""
    tables, at = [], 0
    for c in books:
        tables.append(q[:, at : at + c.shape[1]] @ c.T)
        at += c.shape[1]

    def run(rows: pd.DataFrame) -> np.ndarray:
        code = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1)
        out = np.zeros((len(q), len(rows)))
        for k, table in enumerate(tables):
            out += table[:, code[:, k]]
        return out

    return run


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "query_id long, memory_id long, score double, rank int")
