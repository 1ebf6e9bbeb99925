"""Temporal filters and boosts applied to hits, and sequence scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from .neighbours import units


def within(df: DataFrame, ts: str, start: Column, end: Column) -> DataFrame:
    """Rows of a closed time window; pushed below any limit, unlike a filter on finished results."""
    return df.filter(F.col(ts).between(start, end))


def as_of_previous(rows: DataFrame, snapshots: DataFrame, gap_s: int, key: str, ts: str = "ts", bucket_s: int = 86400) -> DataFrame:
    """Each row with the latest snapshot of its key at least ``gap_s`` older. Rows and snapshots are merged by key and
    time, so the join is one shuffle and a running last."""
    seen = snapshots.select(key, F.col(ts).alias("at"), F.struct(F.col(ts).alias("snapshot_ts"), *[c for c in snapshots.columns if c not in (key, ts)]).alias("snap"), F.lit(None).alias("row"), F.lit(0).alias("kind"))
    asks = rows.select(key, (F.col(ts) - F.make_dt_interval(secs=F.lit(gap_s))).alias("at"), F.lit(None).alias("snap"), F.struct(*rows.columns).alias("row"), F.lit(1).alias("kind"))
    w = W.partitionBy(key).orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    both = seen.unionByName(asks).withColumn("snap", F.last("snap", ignorenulls=True).over(w))
    return both.filter("kind = 1").select("row.*", "snap.*")


def position_label(current: Column, seq: Column) -> Column:
    d = current - seq
    return F.when(d == 0, "current turn").when(d == 1, "previous turn").when(d == -1, "next turn").when(d > 0, F.concat(d.cast("string"), F.lit(" turns ago"))).otherwise(F.concat((-d).cast("string"), F.lit(" turns ahead")))


def timeline(turns: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of every session's turns in order, with labels seen from its last turn."""
    w = W.partitionBy("session_id").orderBy("seq", "role")
    last = F.max("seq").over(W.partitionBy("session_id"))
    page = turns.withColumn("n", F.row_number().over(w)).withColumn("label", position_label(last, F.col("seq")))
    return page.filter(F.col("n").between(offset + 1, offset + limit))


def context(turns: DataFrame, anchors: DataFrame, before: int = 10, after: int = 0) -> DataFrame:
    """Turns around each anchor (session_id, anchor_seq)."""
    joined = turns.join(anchors, "session_id")
    return joined.filter((F.col("seq") >= F.col("anchor_seq") - before) & (F.col("seq") <= F.col("anchor_seq") + after) & (F.col("seq") != F.col("anchor_seq")))


def compare_states(turns: DataFrame, before: int, after: int) -> DataFrame:
    """Turns up to ``before`` and those in (before, after], by session."""
    early, late = F.col("seq") <= before, (F.col("seq") > before) & (F.col("seq") <= after)
    return turns.groupBy("session_id").agg(F.count(F.when(early, 1)).alias("n_before"), F.count(F.when(late, 1)).alias("n_added"), F.count_distinct(F.when(late, F.col("role"))).alias("roles_added"))


def pairs_in_time(rows: DataFrame, vector: str, low: int, high: int, found, schema: str, block: int = 2048) -> DataFrame:
    """Rows of ``found`` over all pairs of rows (s, vector and others) of which the second comes ``low`` to ``high`` seconds after the
    first. It gets two blocks, the raw cosines of their vectors and which pairs count, and gives rows of ``schema``.

    Rows are sorted by time over range partitions and cut into blocks of ``block`` in that order; two blocks meet, in one product and
    one task, if their spans can hold a pair. So a time with most of the rows is as many blocks as it needs, and no day or second
    is a key. Rows without a time meet nothing."""
    own = rows.filter("s is not null")
    nth = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    spread = F.xxhash64(F.struct(*[c for c in own.columns if c != vector]))
    own = written(own.repartitionByRange("s", spread).sortWithinPartitions("s").withColumn("_p", F.spark_partition_id()).withColumn("_n", nth))
    # places over all partitions, so that blocks are full however many there are
    starts, total = [], 0
    for r in own.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect():  # a row a partition
        starts.append((r["_p"], total))
        total += r["n"]
    before = F.broadcast(own.sparkSession.createDataFrame(starts, "_p int, _o long"))
    own = own.join(before, "_p").withColumn("_b", F.floor((F.col("_o") + F.col("_n")) / block)).drop("_p", "_n", "_o")
    spans = own.groupBy("_b").agg(F.min("s").alias("first"), F.max("s").alias("last"))
    step = max(1, high)
    slots = lambda a, b: F.explode(F.sequence(F.floor(a / step), F.floor(b / step))).alias("slot")
    one = spans.select(F.col("_b").alias("_x"), F.col("first").alias("f1"), F.col("last").alias("l1"), slots(F.col("first") + low, F.col("last") + high))
    two = spans.select(F.col("_b").alias("_y"), F.col("first").alias("f2"), F.col("last").alias("l2"), slots(F.col("first"), F.col("last")))
    meet = written(one.join(two, "slot").filter("l2 - f1 >= %d and f2 - l1 <= %d" % (low, high)).select("_x", "_y").distinct())

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.rename(columns={f"r_{c}": c for c in a.columns})
        if not len(a) or not len(b):
            return found(a, b, np.zeros((len(a), len(b))), np.zeros((len(a), len(b)), bool))
        p, q = units(a[vector]), units(b[vector])
        gap = b["s"].to_numpy()[None] - a["s"].to_numpy()[:, None]
        return found(a, b, np.clip(p @ q.T, -1, 1), (gap >= low) & (gap <= high))

    left = own.withColumnRenamed("_b", "_x").join(meet, "_x")
    # the same table under other names, so that the sides can be told apart
    other = own.select(F.col("_b").alias("y_"), *(F.col(c).alias(f"r_{c}") for c in own.columns if c != "_b"))
    right = other.join(meet.select(F.col("_x").alias("x_"), F.col("_y").alias("y_")), "y_")
    return left.groupBy("_x", "_y").cogroup(right.groupBy("x_", "y_")).applyInPandas(run, schema)
