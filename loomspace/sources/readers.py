"""Readers of memory files, retrieval benchmarks and audit logs; corrupt rows are kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "id string, doc_id string, title string, text string, topic_hint string, chunk_idx long, word_count long, start_word long, end_word long, source_dataset string"


def chunks_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records of a JSON-lines file; rows that don't parse are in ``_corrupt_record``."""
    return spark.read.schema(CHUNKS + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def valid(rows: DataFrame) -> DataFrame:
    """Rows that parsed and have an id and a text."""
    return rows.filter(F.col("_corrupt_record").isNull() & F.col("id").isNotNull() & F.col("text").isNotNull()).drop("_corrupt_record")


def queries_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("_id string, text string").json(path).select(F.col("_id").alias("query_id"), "text")


def judgements_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).schema("query_id string, doc_id string, grade int").csv(path)


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, content, content_hash, modified) of text files."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.col("path").alias("file_path"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("modified"))


def unseen(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content isn't stored yet."""
    return files.join(known.select("content_hash").distinct(), "content_hash", "left_anti")


def orphans(indexed: DataFrame, files: DataFrame) -> DataFrame:
    """Indexed files that are no longer there."""
    return indexed.select("file_path").distinct().join(files.select("file_path"), "file_path", "left_anti")
