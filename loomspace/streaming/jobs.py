"""Structured Streaming: ingest, windows, sessions and stateful triggers.

Every job takes a streaming (or, for tests, a static) DataFrame and returns one; sinks and triggers are the caller's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def file_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def ingested(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event once, late copies within ``delay`` dropped; the state is bounded by the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed(stream: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts and sums by event type and window."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = stream.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of each user by a gap."""
    out = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def consolidation_trigger(stream: DataFrame, high: float = 0.7, churn: float = 0.5, seconds: int = 300) -> DataFrame:
    """(key, ts, reason) whenever entropy and churn are high at once, or entropy stays high for ``seconds``.

    Rows are (key, ts, entropy, churn); the state of a key is when its entropy became high.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        since = state.get[0] if state.exists else -1
        out = []
        rows = pd.concat(list(batches)).sort_values("ts")
        for r in rows.itertuples():
            now = int(r.ts.timestamp())
            if r.entropy <= high:
                since = -1
                continue
            since = now if since < 0 else since
            if r.churn > churn:
                out.append((key[0], r.ts, "entropy and churn"))
            elif now - since >= seconds:
                out.append((key[0], r.ts, "high entropy"))
                since = now
        state.update((since,))
        yield pd.DataFrame(out, columns=["key", "ts", "reason"])

    return stream.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, reason string", "since long", "append", "NoTimeout")


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Start a micro-batch job, such as an incremental graph build; ``checkpoint`` keeps its cursor."""
    w = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a table in memory; for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
