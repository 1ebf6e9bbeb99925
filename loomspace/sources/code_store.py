"""A store of code entities with secondary indexes by name, by signature and by file.

Entities and index rows are tables by batch. A batch finds the stored versions of its ids, and writes for each index what goes (the old
keys) and what comes (the new ones), so that an index is right by itself after updates and deletes. Index tables are
partitioned by a hash of their key and sorted by it: a look-up reads one of ``BUCKETS`` partitions, a prefix search skips row groups
by their bounds. Entities are partitioned by a hash of their id, read with the buckets of the ids that an index gave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from .batches import BatchStore, buckets

BUCKETS = 32
ENTITY = "entity_type string, name string, code string, language string, file_path string, line_start long, line_end long, signature string"
STORED = f"id long, entity struct<{', '.join(c.replace(' ', ': ', 1) for c in ENTITY.split(', '))}>, bucket int"
INDEX = "key string, id long, live boolean, bucket int"
#: index -> the entity's column
KEYS = {"by_name": "name", "by_signature": "signature", "by_file": "file_path"}


def bucket(key) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class CodeStore(BatchStore):
    def upsert(self, rows: DataFrame, batch: int, deleted: DataFrame | None = None) -> bool:
        """Store entities (id and the columns of ``ENTITY``) and delete those of ``deleted`` (id); False if the batch is already in. An id
        counts once: a deletion before a row, of several rows the least."""
        if batch in self.committed():
            return False
        names = [c.split(" ")[0] for c in ENTITY.split(", ")]
        own = rows.filter("id is not null").select(F.col("id").cast("long").alias("id"), F.struct(*(F.col(c) for c in names)).cast(STORED.split("entity ")[1].rsplit(", bucket", 1)[0]).alias("entity"))
        if deleted is not None:
            own = own.unionByName(deleted.select(F.col("id").cast("long").alias("id"), F.lit(None).cast(own.schema["entity"].dataType).alias("entity")))
        first = W.partitionBy("id").orderBy(F.col("entity").isNotNull(), "entity")
        own = written(own.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("id", "entity", bucket("id").alias("bucket")))
        old = self._latest("entities", STORED, "id", "entity").join(own.select("id"), "id")
        both = own.select("id", F.col("entity").alias("new")).join(written(old.select("id", F.col("entity").alias("old"))), "id", "left")
        self._write(own.repartition("bucket"), "entities", batch, "bucket")
        for index, column in KEYS.items():
            new, gone = F.col(f"new.{column}"), F.col(f"old.{column}")
            moves = F.array(F.struct(gone.alias("key"), F.lit(False).alias("live")), F.struct(new.alias("key"), F.lit(True).alias("live")))
            delta = both.select("id", F.explode(F.when(new.eqNullSafe(gone), F.array().cast("array<struct<key: string, live: boolean>>")).otherwise(moves)).alias("x"))
            delta = delta.select("x.key", "id", "x.live", bucket("x.key").alias("bucket")).filter("key is not null")
            self._write(delta.repartition("bucket").sortWithinPartitions("bucket", "key"), index, batch, "bucket")
        self._commit(batch)
        return True

    def _index(self, index: str, wanted: Column) -> DataFrame:
        """(key, id) of the live rows of an index; ``wanted`` reaches its files."""
        own = self._rows(index, INDEX).filter(wanted).groupBy("key", "id").agg(F.max_by("live", "batch").alias("live"))
        return own.filter("live").select("key", "id")

    def entities(self) -> DataFrame:
        """All entities as stored now."""
        return self._latest("entities", STORED, "id", "entity").select("id", "entity.*")

    def _of(self, found: DataFrame) -> DataFrame:
        """The entities of ids that an index gave, read from the partitions of those ids."""
        ids = written(found.select("id", bucket("id").alias("bucket")).distinct())
        own = self._rows("entities", STORED).filter(F.col("bucket").isin(buckets(ids))).join(ids, ["bucket", "id"]).groupBy("id").agg(F.max_by("entity", "batch").alias("entity"))
        return own.filter("entity is not null").select("id", "entity.*")

    def get(self, ids: DataFrame) -> DataFrame:
        return self._of(ids)

    def by_key(self, index: str, key: str) -> DataFrame:
        """Entities with one name, signature or file."""
        where = self.spark.range(1).select(bucket(F.lit(key))).first()[0]
        return self._of(self._index(index, (F.col("bucket") == where) & (F.col("key") == key)))

    def by_name_prefix(self, prefix: str, limit: int | None = None) -> DataFrame:
        """Entities whose name begins with ``prefix``, in the order of name and id."""
        found = self._index("by_name", F.col("key").startswith(prefix))
        return self._of(found.orderBy("key", "id").limit(limit) if limit else found).orderBy("name", "id")

    def files(self) -> DataFrame:
        """(file_path, n): entities of each file."""
        return self._index("by_file", F.lit(True)).groupBy(F.col("key").alias("file_path")).agg(F.count("*").alias("n"))

    def of_files(self, files: DataFrame) -> DataFrame:
        """(file_path, id) of many files at once, such as those to delete."""
        wanted = files.select(F.col("file_path").alias("key"), bucket("file_path").alias("bucket")).distinct()
        own = self._rows("by_file", INDEX).filter(F.col("bucket").isin(buckets(wanted))).join(wanted, ["bucket", "key"]).groupBy("key", "id").agg(F.max_by("live", "batch").alias("live"))
        return own.filter("live").select(F.col("key").alias("file_path"), "id")

    def delete_files(self, files: DataFrame, batch: int) -> bool:
        return self.upsert(self.entities().limit(0), batch, self.of_files(files).select("id"))
