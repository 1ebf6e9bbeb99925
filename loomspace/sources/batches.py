"""Tables of Parquet that take numbered batches: a batch is read once its commit is written, and the latest row of a key counts.

Each table has a folder a batch. A batch that fails midway leaves nothing that is read, one that is replayed after its commit is
skipped, and one replayed before it overwrites its own files with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def buckets(wanted: DataFrame) -> list[int]:
    """The numbers in the column ``bucket``, of which a store has a fixed few, for a filter that reaches the partitions."""
    return [r.bucket for r in wanted.select("bucket").distinct().collect()]


class BatchStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, table: str, schema: str) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], f"{schema}, batch long")
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{table}")

    def _write(self, rows: DataFrame, table: str, batch: int, *partition_by: str) -> None:
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/{table}/batch={batch}")

    def _commit(self, batch: int) -> None:
        self._write(self.spark.createDataFrame([(1,)], "done int").coalesce(1), "commits", batch)

    def _commits(self) -> DataFrame:
        return self._read("commits", "done int").select("batch").distinct()

    def committed(self) -> list[int]:
        return sorted(r.batch for r in self._commits().collect())  # a row a batch

    def _rows(self, table: str, schema: str) -> DataFrame:
        """Rows of committed batches."""
        return self._read(table, schema).join(F.broadcast(self._commits()), "batch")

    def _latest(self, table: str, schema: str, key: str, value: str) -> DataFrame:
        """The latest committed value of each key; null values are removals."""
        own = self._rows(table, schema).groupBy(key).agg(F.max_by(value, "batch").alias(value))
        return own.filter(F.col(value).isNotNull())
