"""Merging, consolidation, importance, tombstones, provenance and context injection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as v
from . import graph


def merged(groups: DataFrame, by: str, how: str = "union", vector: str = "v", importance: str | None = None) -> DataFrame:
    """(by, n, vector) merged element by element: union (mean, unit length), intersection (mean, 0 where any magnitude is under
    .01), weighted_average (by importance)."""
    x = groups.select(by, *([F.col(importance).alias("w")] if importance else [F.lit(1.0).alias("w")]), F.posexplode(vector).alias("pos", "x"))
    mean = F.avg("x")
    agg = {"union": mean, "intersection": F.when(F.min(F.abs("x")) < 0.01, 0.0).otherwise(mean), "weighted_average": F.sum(F.col("w") * F.col("x")) / F.sum("w")}[how]
    per = x.groupBy(by, "pos").agg(agg.alias("x"), F.count("*").alias("n"))
    out = per.groupBy(by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("vector"))
    return out.withColumn("vector", v.normalised(F.col("vector"))) if how == "union" else out


def sparse_merged(terms: DataFrame, sizes: DataFrame, by: str, how: str = "union") -> DataFrame:
    """(by, term, w): sparse vectors (by, term, w) of a group merged into their mean over all ``sizes`` (by, n) vectors, a missing
    term weighing 0; an intersection keeps the terms that every vector has."""
    own = terms.groupBy(by, "term").agg(F.sum("w").alias("total"), F.count("*").alias("k")).join(sizes, by)
    own = own if how == "union" else own.filter("k = n")
    return own.select(by, "term", (F.col("total") / F.col("n")).alias("w"))


def consolidation(memories: DataFrame, at_least: float, vector: str = "E1") -> DataFrame:
    """(a, b, sim): pairs of memories (memory_id, dir, vector) of a mapped cosine of ``at_least``; a cause and an effect never pair."""
    near = graph.similar_pairs(memories, vector, at_least)
    a, b = (memories.select(F.col("memory_id").alias(x), F.col("dir").alias(f"d{x}")) for x in "ab")
    opposite = ((F.col("da") == "cause") & (F.col("db") == "effect")) | ((F.col("da") == "effect") & (F.col("db") == "cause"))
    return near.join(a, "a").join(b, "b").filter(~opposite).select("a", "b", "sim")


def boosted(old: Column, delta: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), old + delta))


def live(rows: DataFrame, tombstones: DataFrame, key: str = "memory_id") -> DataFrame:
    """Rows without a tombstone."""
    return rows.join(tombstones.select(key), key, "left_anti")


def latest(versions: DataFrame, key: str, order: str) -> DataFrame:
    """The newest version of each key."""
    w = W.partitionBy(key).orderBy(F.desc(order))
    return versions.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def expired(tombstones: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return tombstones.filter(F.unix_seconds(as_of) - F.unix_seconds("deleted_at") > days * 86400)


def priority(relevance: Column, recency: Column, diversity: Column) -> Column:
    return relevance * recency * diversity


def diversity_bonus(agreement: Column) -> Column:
    return F.when(agreement >= 5, 1.5).when(agreement >= 2.5, 1.2).when(agreement >= 1, 1.0).otherwise(0.8)


# Token budget of injected context by category.
BUDGET = {"divergence": 200, "cluster": 400, "single": 300, "session": 200}
TOTAL = 1200


def shares(total: int) -> dict[str, int]:
    """A smaller budget divided among the categories as the whole one is, rounded down."""
    return {c: total * n // TOTAL for c, n in BUDGET.items()}


def budgeted(rows: DataFrame, by: str = "query_id", total: int = TOTAL, budget: dict[str, int] = BUDGET) -> DataFrame:
    """Rows chosen greedily by category order and falling priority: a row that no longer fits the total is skipped; a category's own
    budget binds all but divergence and cluster rows. A group is a query's candidates, which its searches limit."""
    order = {c: k for k, c in enumerate(budget)}

    def choose(group):
        group = group.assign(_o=group["category"].map(order)).sort_values(["_o", "priority", "memory_id"], ascending=[True, False, True])
        used, per, keep = 0, dict.fromkeys(budget, 0), []
        for c, n in zip(group["category"], group["tokens"]):
            fits = used + n <= total and (order[c] < 2 or per[c] + n <= budget[c])
            keep.append(fits)
            if fits:
                used, per[c] = used + n, per[c] + n
        return group[keep].drop(columns="_o")

    return rows.groupBy(by).applyInPandas(choose, rows.schema)


def provenance(memories: DataFrame, audit: DataFrame, merges: DataFrame, importance: DataFrame) -> DataFrame:
    """Each memory with its audit entries, merges and importance changes."""
    a = audit.groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("ts", "operation"))).alias("audit"))
    m = merges.groupBy("memory_id").agg(F.array_sort(F.collect_list("merged_into")).alias("merged_into"))
    i = importance.groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("ts", "delta"))).alias("importance_changes"))
    return memories.join(a, "memory_id", "left").join(m, "memory_id", "left").join(i, "memory_id", "left")
