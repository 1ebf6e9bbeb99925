"""The driver's tables as the engine's model.

``embeddings`` stand in for learned spaces: E1 is the whole vector, other dense spaces are slices of it. Sliced spaces
are no learned spaces; they are deterministic and SQL can express them. A memory's content is the document, and its
time the event, of the same id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import doubles

#: space or directional part -> first dimension (from 1) and length
SLICES = {"E1": (1, 64), "E5_cause": (1, 16), "E5_effect": (17, 16), "E7": (1, 16), "E8_source": (33, 16), "E8_target": (49, 16), "E9": (17, 16), "E10_paraphrase": (33, 16), "E10_context": (49, 16), "E11": (49, 16)}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores if the files give fewer tasks, as one row group does; large tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def beside(rows: DataFrame, key: str, column: str, run: int = 256) -> DataFrame:
    """(key, own, next): the values of each id, and those of the next id, as arrays, for ids that have a next one. Ids are dealt in runs, of which
    the first goes to the run before as well, so rows are shuffled once and not for either side of a join."""
    part = F.floor(F.col(key) / run)
    both = F.when(F.col(key) % run == 0, F.array(part, part - 1)).otherwise(F.array(part))
    dealt = rows.filter(F.col(key).isNotNull()).select(key, column, part.alias("part"), F.explode(both).alias("run"))
    w = W.partitionBy("run").orderBy(key)
    seen = dealt.select(key, "part", "run", F.lag(key).over(w).alias("before"), *(F.collect_list(F.struct(column)).over(w.rangeBetween(k, k)).alias(n) for n, k in (("own", 0), ("next", 1))))
    first = F.col("before").isNull() | (F.col("before") < F.col(key))
    return seen.filter((F.col("run") == F.col("part")) & (F.size("next") > 0) & first).select(key, F.col(f"own.{column}").alias("own"), F.col(f"next.{column}").alias("next"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(memory_id, label, E1): one row per memory."""
    return spread(read(spark, sf_dir, "embeddings")).select(F.col("vec_id").alias("memory_id"), "label", doubles(F.col("embedding")).alias("E1"))


def part(name: str, column: str = "E1"):
    """A space's vector within E1."""
    at, n = SLICES[name]
    return F.col(column) if name == "E1" else F.slice(column, at, n)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``ts`` as a timestamp of the session's time zone, which is UTC."""
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(memory_id, label, E1, created_at, user_id, content, lang, source)."""
    seen = events(spark, sf_dir).select(F.col("event_id").alias("memory_id"), F.col("ts").alias("created_at"), "user_id")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("memory_id"), F.col("text").alias("content"), "lang", "source")
    return vectors(spark, sf_dir).join(seen, "memory_id").join(docs, "memory_id", "left")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, seq, role, content)."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))
