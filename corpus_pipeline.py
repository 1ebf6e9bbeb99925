"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

1. quality rules: rejected documents go;
2. n-gram Jaccard join over five words at 0.8: the document with the smallest id of each group stays;
3. benchmark decontamination: documents with a benchmark window go;
4. secret scans: every secret found is replaced by a mark;
5. packing: the pieces of the documents that are left, in sequences.

All stages but the last return the columns of documents. Rows keep their other columns whatever they are called.

Defined results: documents with a null or empty text have no words and go in stage 1; an empty table passes every stage as an
empty table, and without labels or benchmark items only the base rules decide and nothing is contaminated; of repeated
rows of one id the least stays after stage 2, rows without an id are documents of their own; ties go to the smaller id; texts of
any length are read whole in every stage.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspace.llm import decontamination, packing, quality, secrets, similarity
from loomspace.llm._shared import materialise
from loomspace.session import ship

MARK = "[SECRET]"


def stage(function):
    """A stage that first gives the executors the package."""

    @wraps(function)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return function(ship(spark), docs, sf_dir)

    return call


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the group's smallest id; rows without an id stay."""
    found = similarity.jaccard_components(docs, size=5, percent=80)
    leave = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("id"))
    # whole rows as one column, so that no name can clash
    rows = docs.select(F.col("doc_id").alias("id"), F.struct("*").alias("row"))
    left = rows.filter("id is not null").join(leave.hint("merge"), "id", "left_anti")
    # of rows of one id the least; the join has brought them together
    least = W.partitionBy("id").orderBy(F.struct(*(f"row.`{c}`" for c, kind in docs.dtypes if "map<" not in kind)))
    left = left.withColumn("nth", F.row_number().over(least)).filter("nth = 1")
    return left.select("row.*").union(docs.filter("doc_id is null"))


@stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced and n_chars counted anew."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at)
            own = pa.array([new if old.is_valid else None for old, new in zip(text, secrets.redact(text, MARK))], text.type)
            yield pa.RecordBatch.from_arrays([own if k == at else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminated),
    ("secret_scan", without_secrets),
    ("packing", packed),
]
#: SQL has neither the tokenizer nor the hashed ratio; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what its predecessor wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
