"""The memory store: append-only Parquet tables under one path, with tombstones and versions.

Every table is derived from appends; reads take the newest version of a record and leave tombstoned ones out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curation

MEMORIES = "memory_id long, content string, content_hash string, E1 array<double>, importance double, session_id long, seq long, file_path string, created_at timestamp, version long"
TOMBSTONES = "memory_id long, deleted_at timestamp, hard boolean"
AUDIT = "memory_id long, operation string, ts timestamp, parameters string"
EDGES = "source long, target long, sim double, space string"
SCHEMAS = {"memories": MEMORIES, "tombstones": TOMBSTONES, "audit": AUDIT, "knn_edges": EDGES}


class Store:
    """Tables of memories, tombstones, audit entries and k-NN edges."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMAS[name])

    def append(self, name: str, rows: DataFrame, partition: str | None = None) -> None:
        wanted = (f.split(" ", 1) for f in SCHEMAS[name].split(", "))
        fields = [(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in wanted]
        w = rows.select(*fields).write.mode("append")
        (w.partitionBy(partition) if partition else w).parquet(f"{self.path}/{name}")

    def put(self, memories: DataFrame, operation: str = "store") -> None:
        """Insert or replace memories, hashed and audited; a later version replaces earlier ones."""
        rows = memories.withColumn("content_hash", F.sha2("content", 256)).withColumn("version", F.coalesce(F.col("version") if "version" in memories.columns else F.lit(None), F.unix_micros("created_at")))
        self.append("memories", rows)
        self.append("audit", rows.select("memory_id", F.lit(operation).alias("operation"), F.col("created_at").alias("ts"), F.to_json(F.struct("content_hash")).alias("parameters")))

    def forget(self, ids: DataFrame, at, hard: bool = False) -> None:
        rows = ids.select("memory_id", F.lit(at).cast("timestamp").alias("deleted_at"), F.lit(hard).alias("hard"))
        self.append("tombstones", rows)
        self.append("audit", rows.select("memory_id", F.lit("forget").alias("operation"), F.col("deleted_at").alias("ts")))

    def memories(self) -> DataFrame:
        """The newest live version of every memory."""
        return curation.live(curation.latest(self.table("memories"), "memory_id", "version"), self.table("tombstones"))

    def as_of(self, at) -> DataFrame:
        """The newest version by ``at`` of every memory that had no tombstone by then."""
        when = F.lit(at).cast("timestamp")
        known = self.table("memories").filter(F.col("created_at") <= when)
        return curation.live(curation.latest(known, "memory_id", "version"), self.table("tombstones").filter(F.col("deleted_at") <= when))

    def lookup(self, ids: list[int]) -> DataFrame:
        return self.memories().filter(F.col("memory_id").isin([int(i) for i in ids]))

    def by_file(self, path: str) -> DataFrame:
        return self.memories().filter(F.col("file_path") == path)

    def by_session(self, session_id: int) -> DataFrame:
        return self.memories().filter(F.col("session_id") == session_id)

    def status(self) -> DataFrame:
        m = self.memories()
        return m.agg(F.count("*").alias("memories"), F.count_distinct("session_id").alias("sessions"), F.sum(F.octet_length("content")).alias("content_bytes"))

    def compact(self, as_of, to: str, days: int = 7) -> None:
        """Write a copy without old versions and without memories whose tombstone is past retention."""
        stones = self.table("tombstones")
        gone = curation.expired(stones, F.lit(as_of).cast("timestamp"), days).unionByName(stones.filter("hard"))
        out = Store(self.spark, to)
        out.append("memories", curation.live(curation.latest(self.table("memories"), "memory_id", "version"), gone))
        out.append("tombstones", stones.join(gone.select("memory_id").distinct(), "memory_id", "left_anti"))
        out.append("audit", self.table("audit"))

    def write_edges(self, edges: DataFrame) -> None:
        self.append("knn_edges", edges, "space")
