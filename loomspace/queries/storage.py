"""The memory store end to end: inserts, updates, tombstones, purges, snapshots and files, with their audit."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import tables as t
from ..sources.store import Store
from . import register

# documents are stored at a first moment, every second one again at the next with a longer text, and every seventh forgotten
# at the third, every fourteenth for good
AT = ("2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-03 00:00:00", "2024-01-20 00:00:00")
V = "WITH v AS (SELECT doc_id AS memory_id, 1 AS version, coalesce(text, '') AS content, source AS file_path FROM documents UNION ALL SELECT doc_id, 2, coalesce(text, '') || ' (edited)', source FROM documents WHERE doc_id % 2 = 0)"
NEWEST = V + ", x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY version DESC) AS n FROM v) WHERE n = 1)"


def filled(spark, d) -> Store:
    """A store in the shared folder that has lived through these moments."""
    s = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    docs = t.read(spark, d, "documents").select(F.col("doc_id").alias("memory_id"), F.coalesce("text", F.lit("")).alias("content"), F.col("source").alias("file_path"))
    at = lambda k: F.lit(AT[k]).cast("timestamp")
    s.put(docs.withColumn("created_at", at(0)).withColumn("version", F.lit(1)))
    s.put(docs.filter("memory_id % 2 = 0").withColumn("content", F.concat("content", F.lit(" (edited)"))).withColumn("created_at", at(1)).withColumn("version", F.lit(2)), "update")
    s.forget(docs.filter("memory_id % 14 = 0"), AT[2], hard=True)
    s.forget(docs.filter("memory_id % 14 = 7"), AT[2])
    return s


@register("store_memories", NEWEST + " SELECT memory_id, version::BIGINT AS version, sha256(content) AS content_hash FROM x WHERE memory_id % 7 <> 0")
def store(spark, d):
    """The newest live version of every memory, hashed."""
    return filled(spark, d).memories().select("memory_id", "version", "content_hash")


@register("store_audit", V + " SELECT CASE version WHEN 1 THEN 'store' ELSE 'update' END AS operation, count(*) AS n, count(DISTINCT sha256(content)) AS contents FROM v GROUP BY 1 UNION ALL SELECT 'forget', count(*), 0 FROM documents WHERE doc_id % 7 = 0 HAVING count(*) > 0")
def audit(spark, d):
    """Audit entries by operation, with the number of contents they name."""
    a = filled(spark, d).table("audit")
    return a.groupBy("operation").agg(F.count("*").alias("n"), F.count_distinct(F.get_json_object("parameters", "$.content_hash")).alias("contents"))


@register("store_purged", NEWEST + " SELECT memory_id, version::BIGINT AS version FROM x WHERE memory_id % 7 <> 0")
def purged(spark, d):
    """What a compaction after the tombstones' retention leaves on disk."""
    s = filled(spark, d)
    to = f"{s.path}-compact"
    s.compact(AT[3], to)
    return Store(spark, to).table("memories").select("memory_id", "version")


@register("store_within_retention", NEWEST + " SELECT memory_id, version::BIGINT AS version FROM x WHERE memory_id % 14 <> 0")
def retained(spark, d):
    """What a compaction within retention leaves: soft tombstones may still be lifted, hard ones are gone."""
    s = filled(spark, d)
    to = f"{s.path}-compact"
    s.compact(AT[2], to)
    return Store(spark, to).table("memories").select("memory_id", "version")


@register("store_snapshot", V + " SELECT memory_id, version::BIGINT AS version, sha256(content) AS content_hash FROM v WHERE version = 1")
def snapshot(spark, d):
    """The store as it was at its first moment, before any update or tombstone."""
    return filled(spark, d).as_of(AT[0]).select("memory_id", "version", "content_hash")


@register("delete_file_content", NEWEST + ", f AS (SELECT min(source) AS one FROM documents) SELECT memory_id, file_path FROM x, f WHERE memory_id % 7 <> 0 AND file_path <> one")
def delete_file(spark, d):
    """Live memories after the content of one file has been forgotten."""
    s = filled(spark, d)
    one = t.read(spark, d, "documents").agg(F.min("source")).first()[0]
    s.forget(s.by_file(one), AT[3])
    return s.memories().select("memory_id", "file_path")
