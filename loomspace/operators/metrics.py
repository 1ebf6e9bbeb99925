"""Retrieval, clustering and temporal quality metrics as aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import retrieval

NO_LABEL = -(2**63)


def per_query(ranked: DataFrame, k: int) -> DataFrame:
    """(query_id, precision, recall, mrr, ndcg, ap) of (query_id, rank from 0, grade): grades above 0 are relevant. The ideal order
    is that of all grades of the query."""
    ideal = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("grade"), "rank"))
    seen = F.sum((F.col("grade") > 0).cast("int")).over(W.partitionBy("query_id").orderBy("rank"))
    x = ranked.withColumn("ideal", ideal).withColumn("seen", seen)
    hit, within = F.col("grade") > 0, F.col("rank") < k
    gain = lambda place: (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(place + 1)
    relevant = F.sum(hit.cast("int"))
    dcg, idcg = F.sum(F.when(within, gain(F.col("rank") + 1)).otherwise(0.0)), F.sum(F.when(F.col("ideal") <= k, gain(F.col("ideal"))).otherwise(0.0))
    return x.groupBy("query_id").agg(
        (F.sum((hit & within).cast("int")) / k).alias("precision"),
        F.when(relevant > 0, F.sum((hit & within).cast("int")) / relevant).otherwise(0.0).alias("recall"),
        F.coalesce(1 / (F.min(F.when(hit, F.col("rank"))) + 1), F.lit(0.0)).alias("mrr"),
        F.when(idcg > 0, dcg / idcg).otherwise(0.0).alias("ndcg"),
        F.when(relevant > 0, F.sum(F.when(hit, F.col("seen") / (F.col("rank") + 1)).otherwise(0.0)) / relevant).otherwise(0.0).alias("ap"),
    )


def of_rankings(queries: DataFrame, memories: DataFrame, space: str, label: str, k: int) -> DataFrame:
    """As ``per_query``, of the queries' whole rankings by a space, in which memories with the query's label, a whole number, are relevant. A task
    that has a query's ranking makes a row of it."""

    def run(query: int, asked: dict, ids: np.ndarray, ranks: dict, sims: dict, labels: np.ndarray) -> pd.DataFrame:
        rank, known = np.sort(ranks[space][labels == asked[label]]), asked[label] != NO_LABEL
        rank = rank if known else rank[:0]
        n, within = len(rank), rank[rank < k]
        gain = lambda place: float((1 / np.log2(place + 1)).sum())
        out = {"recall": len(within) / n, "mrr": 1 / (rank[0] + 1), "ndcg": gain(within + 1) / gain(np.arange(1, min(n, k) + 1)), "ap": (np.arange(1, n + 1) / (rank + 1)).sum() / n} if n else dict.fromkeys(("recall", "mrr", "ndcg", "ap"), 0.0)
        return pd.DataFrame([{"query_id": query, "precision": len(within) / k if known else None, **out}] if len(ids) else [], columns=["query_id", "precision", *out])

    labelled = lambda x: x.withColumn(label, F.coalesce(F.col(label).cast("long"), F.lit(NO_LABEL)))
    schema = "query_id long, precision double, recall double, mrr double, ndcg double, ap double"
    return retrieval.of_rankings(labelled(queries), labelled(memories), (space,), run, schema, label)


def contingency(rows: DataFrame, cluster: str, label: str) -> DataFrame:
    return rows.groupBy(F.col(cluster).alias("c"), F.col(label).alias("l")).agg(F.count("*").alias("n"))


def purity(table: DataFrame) -> DataFrame:
    return table.groupBy("c").agg(F.max("n").alias("top"), F.sum("n").alias("n")).agg((F.sum("top") / F.sum("n")).alias("purity"))


def nmi(table: DataFrame) -> DataFrame:
    """Mutual information over the mean of both entropies; 1 if both have one group."""
    t = table.withColumn("a", F.sum("n").over(W.partitionBy("c"))).withColumn("b", F.sum("n").over(W.partitionBy("l")))
    total = table.agg(F.sum("n").alias("t"))
    t = t.crossJoin(F.broadcast(total))
    mi = t.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"))
    entropy = lambda c, name: table.groupBy(c).agg(F.sum("n").alias("n")).crossJoin(F.broadcast(total)).agg(F.sum(-F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t"))).alias(name))
    both = mi.crossJoin(entropy("c", "hc")).crossJoin(entropy("l", "hl"))  # three single rows
    return both.select(F.when(F.col("hc") + F.col("hl") > 0, 2 * F.col("mi") / (F.col("hc") + F.col("hl"))).otherwise(1.0).alias("nmi"))


def ari(table: DataFrame) -> DataFrame:
    """Adjusted Rand index from the contingency table."""
    two = lambda n: n * (n - 1) / 2
    cells = table.agg(F.sum(two(F.col("n"))).alias("i"), F.sum("n").alias("t"))
    rows = table.groupBy("c").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("a"))
    cols = table.groupBy("l").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("b"))
    x = cells.crossJoin(rows).crossJoin(cols)  # three single rows
    expected = F.col("a") * F.col("b") / two(F.col("t"))
    most = (F.col("a") + F.col("b")) / 2
    return x.select(F.when(most != expected, (F.col("i") - expected) / (most - expected)).otherwise(1.0).alias("ari"))


def kendall(rows: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, tau) over all pairs of a group; groups are a stated set of small sizes."""
    a, b = (rows.select(by, F.col(x).alias(f"x{s}"), F.col(y).alias(f"y{s}")) for s in "ab")
    p = a.join(b, by).filter("xa < xb").withColumn("s", F.signum(F.col("yb") - F.col("ya")))
    return p.groupBy(by).agg((F.sum("s") / F.count("*")).alias("tau"))


def ordered(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, share) of neighbours whose value doesn't fall."""
    prev = F.lag(value).over(W.partitionBy(by).orderBy(order))
    return rows.withColumn("p", prev).filter("p is not null").groupBy(by).agg(F.avg((F.col(value) >= F.col("p")).cast("double")).alias("share"))


def decay_accuracy(rows: DataFrame, by: str, age: str, value: str) -> DataFrame:
    """(by, accuracy): over all pairs of a group of unequal age, how often the newer has a value no smaller; null where no pair has
    both values. No pair is made: two ages part at just one highest bit, so at each bit the rows that share all higher bits of
    their age are counted by value, in bins of value first so that no group is one task."""
    rows = rows.select(by, F.col(age).cast("long").alias("age"), F.col(value).cast("double").alias("value")).filter(F.col(by).isNotNull() & F.col("age").isNotNull())
    known = rows.filter("value is not null")
    bits = max(1, int(known.agg(F.max("age")).first()[0] or 0).bit_length())
    cuts = sorted(set(known.stat.approxQuantile("value", [k / 64 for k in range(1, 64)], 0.001)))
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("value"))) if cuts else F.lit(0)
    x = known.withColumn("bin", place).withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    key = [by, "bit", "above"]
    x = x.withColumn("above", F.expr("shiftright(age, bit + 1)")).withColumn("older", F.expr("shiftright(age, bit) & 1"))
    cells = x.groupBy(*key, "bin", "value").agg(F.sum(1 - F.col("older")).alias("newer"), F.sum("older").alias("older"))
    up = W.partitionBy(*key, "bin").orderBy(F.desc("value")).rowsBetween(W.unboundedPreceding, 0)
    bins = cells.withColumn("met", F.col("older") * F.sum("newer").over(up)).groupBy(*key, "bin").agg(*(F.sum(c).alias(c) for c in ("met", "newer", "older")))
    over, whole = W.partitionBy(*key).orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*key)
    met = F.col("met") + F.col("older") * F.coalesce(F.sum("newer").over(over), F.lit(0))
    pairs = bins.withColumn("all", F.col("older") * F.sum("newer").over(whole)).withColumn("met", met).groupBy(by).agg(F.sum("met").alias("met"), F.sum("all").alias("all"))
    parted = rows.groupBy(by).agg((F.min("age") < F.max("age")).alias("parted")).filter("parted")
    return parted.join(pairs, by, "left").select(by, F.when(F.col("all") > 0, F.col("met") / F.col("all")).alias("accuracy"))


def f1(found: Column, true: Column) -> Column:
    """F1 of two boolean columns, as an aggregate."""
    tp, fp, fn = (F.sum(c.cast("int")) for c in (found & true, found & ~true, ~found & true))
    return F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
