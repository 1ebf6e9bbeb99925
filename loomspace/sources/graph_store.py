"""A stored exact k-NN graph that takes batches of memories: the sink of an incremental graph build.

Two tables by batch: ``memories`` (memory_id, v; null v: removed) and ``lists`` (source, near: its k nearest with their similarities; null:
removed). A batch writes its memories and the lists that it changes, then its commit.

A batch meets the stored memories once in blocks of products: new memories find their k nearest among all, and a list takes new memories that
beat its last. Memories whose vector changes, or that are removed, go from all lists; a list that loses one is made anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import neighbours
from ..session import written
from ..streaming import jobs
from .batches import BatchStore

MEMORIES = "memory_id long, v array<double>"
LISTS = "source long, near array<struct<target: long, sim: double>>"


class GraphStore(BatchStore):
    def __init__(self, spark: SparkSession, path: str, k: int = 5):
        super().__init__(spark, path)
        self.k = k

    def memories(self) -> DataFrame:
        return self._latest("memories", MEMORIES, "memory_id", "v").select("memory_id", "v")

    def lists(self) -> DataFrame:
        return self._latest("lists", LISTS, "source", "near").select("source", "near")

    def edges(self) -> DataFrame:
        """(source, target, sim)."""
        return self.lists().select("source", F.explode("near").alias("x")).select("source", "x.target", "x.sim")

    def upsert(self, rows: DataFrame, batch: int, vector: Column | None = None) -> bool:
        """Take a batch (memory_id, ``vector`` or column v; null: remove); False if it is already in. Of repeated ids one row counts,
        removals first."""
        if batch in self.committed():
            return False
        vector = F.col("v") if vector is None else vector
        first = W.partitionBy("memory_id").orderBy(F.col("v").isNotNull(), F.xxhash64("v"))
        rows = rows.select(F.col("memory_id").cast("long").alias("memory_id"), vector.cast("array<double>").alias("v")).filter("memory_id is not null")
        rows = written(rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n"))
        new = rows.filter("v is not null")
        old, lists = self.memories(), self.lists()
        stale = written(old.select("memory_id").join(rows.select("memory_id"), "memory_id"))  # changed or removed
        left = written(old.join(stale, "memory_id", "left_anti"))
        kept = lists.join(stale.withColumnRenamed("memory_id", "source"), "source", "left_anti")
        gone = kept.select("source", F.explode("near.target").alias("memory_id")).join(stale, "memory_id").select("source").distinct()
        broken = written(gone)
        # new memories and broken lists meet all memories, whole lists the new ones
        whole = left.join(broken.withColumnRenamed("source", "memory_id"), "memory_id", "left_anti")
        renew = new.unionByName(written(left.join(broken.withColumnRenamed("source", "memory_id"), "memory_id")))
        fresh = neighbours.across(renew, left.unionByName(new), self.k)
        more = neighbours.across(whole, new, self.k)
        held = kept.join(broken, "source", "left_anti").select("source", F.explode("near").alias("x"), F.size("near").alias("n"), F.element_at("near", -1)["sim"].alias("last"))
        bar = held.select("source", "n", "last").distinct()
        # only lists that a new memory enters are written again
        enter = more.join(bar, "source", "left").filter((F.coalesce("n", F.lit(0)) < self.k) | (F.col("sim") >= F.col("last"))).select("source", "target", "sim")
        changed = enter.select("source").distinct()
        merged = neighbours.best(held.join(changed, "source").select("source", "x.target", "x.sim").unionByName(enter), self.k)
        near = F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("less"), "target", "sim")))
        made = written(fresh).unionByName(written(merged)).groupBy("source").agg(F.transform(near, lambda x: F.struct(x["target"].alias("target"), x["sim"].alias("sim"))).alias("near"))
        made = written(made)
        removed = stale.join(new, "memory_id", "left_anti").select(F.col("memory_id").alias("source"), F.lit(None).cast("array<struct<target: long, sim: double>>").alias("near"))
        # a list that has lost all its members is empty, not absent
        empty = renew.select(F.col("memory_id").alias("source")).join(made, "source", "left_anti").select("source", F.array().cast("array<struct<target: long, sim: double>>").alias("near"))
        self._write(rows, "memories", batch)
        self._write(made.unionByName(written(removed)).unionByName(written(empty)), "lists", batch)
        self._commit(batch)
        return True

    def compact(self, path: str) -> GraphStore:
        """The latest rows as one batch of a new store, numbered as the last one of this."""
        batches, out = self.committed(), GraphStore(self.spark, path, self.k)
        if batches:
            out._write(self.memories(), "memories", batches[-1])
            out._write(self.lists(), "lists", batches[-1])
            for batch in batches:  # replays of any of them are still known
                out._commit(batch)
        return out


def graph_job(stream: DataFrame, store: GraphStore, checkpoint: str, every: str | None = None):
    """Keep ``store`` up to date with a stream of memories (memory_id, v)."""
    return jobs.each_batch(stream, lambda rows, batch: store.upsert(rows, batch), checkpoint, every)
