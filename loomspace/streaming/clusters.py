"""Incremental clustering of a stream, with keyed state: cluster features, a bounded buffer and the count of updates.

Each memory joins the nearest feature of its space or opens one, and enters the space's buffer; beyond ``held`` memories the
older half of the buffer is evicted. Every ``after`` memories the space is clustered anew by density over its buffer: clusters
become the features that later memories join, and members get their cluster. Rows of a space are taken in the order in which they
come, so the results don't depend on how they fall into micro-batches, nor on restarts.

A space is one key. Where one space holds most rows, give ``shards``: memories are dealt over that many states by id, which cluster on
their own and whose features ``birch`` joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import clustering
from ..operators.birch import MOST, THRESHOLD, Features

#: memories between two clusterings (a fixed value), and of a buffer: its distances are one matrix of 128 MB
AFTER, HELD = 100, 4_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "space string, shard int, memory_id long, cluster long, kind string"


class Space:
    """One space's state, and what a memory does to it."""

    def __init__(self, after: int = AFTER, held: int = HELD, threshold: float = THRESHOLD, most: int = MOST, min_size: int = 3, k: int = 2):
        self.after, self.held, self.min_size, self.k = after, held, min_size, k
        self.features, self.updates, self.ids, self.vectors = Features(threshold, most), 0, [], []
        self.evicted = False

    def insert(self, memory_id: int, v: np.ndarray) -> list[tuple[int, int, str]]:
        """(memory, cluster, kind) rows: its own, and those of a new clustering if one is due; a cluster below 0 is noise."""
        out = [(memory_id, self.features.add(1.0, v.copy(), float(v @ v)), "insert")]
        self.ids.append(memory_id)
        self.vectors.append(v)
        self.updates += 1
        if len(self.ids) > self.held:
            keep = len(self.ids) // 2
            self.ids, self.vectors, self.evicted = self.ids[keep:], self.vectors[keep:], True
        if self.updates >= self.after:
            out += self.reclustered()
        return out

    def reclustered(self) -> list[tuple[int, int, str]]:
        self.updates = 0
        if len(self.ids) < self.min_size:
            return []
        x = np.stack(self.vectors)
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        own = clustering.labels(clustering.apart(unit, unit), self.min_size, self.k)
        fresh = Features(self.features.threshold, self.features.most)
        for c in range(own.max() + 1):
            mine = x[own == c]
            fresh.n, fresh.ss, fresh.ids = np.append(fresh.n, float(len(mine))), np.append(fresh.ss, float((mine * mine).sum())), np.append(fresh.ids, c)
            fresh.ls = mine.sum(0)[None] if fresh.ls is None else np.vstack([fresh.ls, mine.sum(0)])
            fresh.made = c + 1
        self.features = fresh
        return [(i, int(c), "recluster") for i, c in zip(self.ids, own)]


class Processor(StatefulProcessor):
    """Keeps a ``Space`` a key in the state store: features and counts as one value, the buffer as a list that is appended to."""

    def __init__(self, **settings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("features", "n array<double>, ls array<double>, ss array<double>, ids array<long>, threshold double, made long, updates long")
        self.buffer = handle.getListState("buffer", "memory_id long, v array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        space = Space(**self.settings)
        held = list(self.buffer.get()) if self.buffer.exists() else []
        space.ids, space.vectors = [r[0] for r in held], [np.array(r[1], float) for r in held]
        if self.value.exists():
            n, ls, ss, ids, threshold, made, space.updates = self.value.get()
            f = space.features
            f.n, f.ss, f.ids, f.threshold, f.made = np.array(n, float), np.array(ss, float), np.array(ids, np.int64), threshold, made
            f.ls = np.array(ls, float).reshape(len(n), -1) if len(n) else None
        out, before = [], len(held)
        for batch in rows:
            for i, v in zip(batch["memory_id"].tolist(), batch["v"]):
                out += space.insert(i, np.array(v, float))
        keep = [(int(i), v.tolist()) for i, v in zip(space.ids, space.vectors)]
        if space.evicted:
            self.buffer.put(keep)
        else:
            self.buffer.appendList(keep[before:])
        f = space.features
        self.value.update((f.n.tolist(), [] if f.ls is None else f.ls.ravel().tolist(), f.ss.tolist(), f.ids.tolist(), float(f.threshold), int(f.made), int(space.updates)))
        if out:
            ids, cluster, kind = zip(*out)
            yield pd.DataFrame({"space": key[0], "shard": np.full(len(ids), key[1], np.int32), "memory_id": ids, "cluster": cluster, "kind": kind})

    def close(self) -> None:
        pass


def keyed(vectors: DataFrame, shards: int = 1, *more: Column) -> DataFrame:
    """(space, shard, memory_id, v) of vectors (space, memory_id, v); null ids and vectors are skipped."""
    own = vectors.filter("space is not null and memory_id is not null and v is not null")
    shard = F.pmod(F.xxhash64("memory_id"), F.lit(shards)).cast("int").alias("shard")
    return own.select("space", shard, "memory_id", F.col("v").cast("array<double>").alias("v"), *more)


def clustered(stream: DataFrame, shards: int = 1, **settings) -> DataFrame:
    """Rows (space, shard, memory_id, cluster, kind) of a stream (space, memory_id, v): kind insert when a memory comes, kind recluster
    for a space's buffered memories whenever it is clustered anew. The session needs the state store ``PROVIDER``."""
    return keyed(stream, shards).groupBy("space", "shard").transformWithStateInPandas(Processor(**settings), OUT, "Append", "None")


def in_order(vectors: DataFrame, order: Column, shards: int = 1, **settings) -> DataFrame:
    """The batch twin: the same rows for a table whose rows came in the order of ``order``. A shard's rows are one group."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        space, out = Space(**settings), []
        rows = rows.sort_values(["o", "memory_id"])
        for i, v in zip(rows["memory_id"].tolist(), rows["v"]):
            out += space.insert(i, np.array(v, float))
        ids, cluster, kind = zip(*out)
        return pd.DataFrame({"space": key[0], "shard": np.full(len(ids), key[1], np.int32), "memory_id": ids, "cluster": cluster, "kind": kind})

    return keyed(vectors, shards, order.alias("o")).groupBy("space", "shard").applyInPandas(run, OUT)
