"""Approximate k-NN graphs by neighbour-of-neighbour joins (NN-Descent), below quadratic.

A memory's neighbours' neighbours are likely its own. From lists of random leaves, each round joins every memory's list, and a bounded
number of the lists that it is in, with itself: pairs with at least one new edge are compared, and a pair enters a list if it beats
the list's last. Rounds end when few lists change. What a round shuffles is the vectors of each memory's list, so work grows with
memories * list length and not with their square; no step holds more than ``block`` memories' lists in a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from . import graph

LEAF = 256  #: memories of a random leaf, about
EDGES = "source long, target long, sim double"


def units(rows: pd.Series) -> np.ndarray:
    x = np.stack(rows.to_numpy())
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def mapped(cos: np.ndarray, defined: np.ndarray) -> np.ndarray:
    """Mapped cosines rounded to 12 places, 0 where a vector has no length."""
    return np.round(np.where(defined, (np.clip(cos, -1, 1) + 1) / 2, 0.0), 12)


def best(edges: DataFrame, k: int, *keep: str) -> DataFrame:
    """The k best targets of each source, ties by the smaller id; cut before the shuffle as well as after it."""
    order = W.partitionBy("source").orderBy(F.desc("sim"), "target")
    return edges.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).select("source", "target", "sim", *keep)


def leaves(own: DataFrame, n: int, seed: int) -> DataFrame:
    """Adds ``leaf``: memories by the signs of random projections, a leaf of too many dealt over several by id."""
    bits = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))
    if not bits:
        return own.withColumn("leaf", F.lit("0"))
    dim = own.select(F.size("v")).first()[0]
    planes = np.random.default_rng(seed).normal(size=(bits, dim))
    dot = lambda p: F.aggregate(F.zip_with("v", F.lit(p.tolist()), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    code = F.concat(*(F.when(dot(p) >= 0, "1").otherwise("0") for p in planes))
    coded = written(own.withColumn("code", code))
    parts = coded.groupBy("code").agg(F.ceil(F.count("*") / (2 * LEAF)).alias("parts"))
    salt = F.pmod(F.xxhash64("memory_id", F.lit(seed)), F.col("parts")).cast("string")
    return coded.join(parts, "code").select("memory_id", "v", F.concat_ws("/", "code", salt).alias("leaf"))


def started(own: DataFrame, n: int, pool: int, trees: int) -> DataFrame:
    """Lists within ``trees`` random partitions into leaves."""

    def inside(rows: pd.DataFrame) -> pd.DataFrame:
        ids, x = rows["memory_id"].to_numpy(), units(rows["v"])
        some = x.any(axis=1)
        sim = mapped(x @ x.T, some[:, None] & some[None])
        sim[ids[:, None] == ids[None]] = -1
        order = np.argsort(-sim, axis=1, kind="stable")[:, :pool]
        i = np.repeat(np.arange(len(ids)), order.shape[1])
        out = pd.DataFrame({"source": ids[i], "target": ids[order.ravel()], "sim": sim[i, order.ravel()]})
        return out[out["sim"] >= 0]

    found = None
    for tree in range(trees):
        one = leaves(own, n, tree).groupBy("leaf").applyInPandas(inside, EDGES)
        found = one if found is None else found.unionByName(one)
    return best(found.distinct(), pool).withColumn("fresh", F.lit(True))


def joined(block: pd.DataFrame) -> pd.DataFrame:
    """Pairs among the lists (u: v, fresh, bar, vector) of a block of memories, of which one edge at least is fresh and that beat v's bar."""
    block = block.sort_values(["u", "memory_id"])
    u, ids, fresh, bar = (block[c].to_numpy() for c in ("u", "memory_id", "fresh", "bar"))
    x = units(block["v"])
    start = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
    size = np.diff(np.append(start, len(u)))
    out = []
    for width in np.unique(2 ** np.ceil(np.log2(size)).astype(int)):  # lists of like lengths as one tensor
        which = np.flatnonzero((size <= width) & (size > width // 2))
        at = np.minimum(np.arange(width)[None], size[which][:, None] - 1) + start[which][:, None]
        held = np.arange(width)[None] < size[which][:, None]
        t, name = x[at], ids[at]
        some = t.any(axis=2)
        sim = mapped(t @ t.transpose(0, 2, 1), some[:, :, None] & some[:, None])
        ok = held[:, :, None] & held[:, None] & (fresh[at][:, :, None] | fresh[at][:, None]) & (name[:, :, None] != name[:, None]) & (sim > bar[at][:, :, None])
        l, i, j = np.nonzero(ok)  # noqa: E741
        out.append(pd.DataFrame({"source": name[l, i], "target": name[l, j], "sim": sim[l, i, j]}))
    return pd.concat(out).drop_duplicates(["source", "target"])


def nn_descent(memories: DataFrame, k: int, vector: Column, pool: int = 30, rounds: int = 10, trees: int = 2, least_change: float = 0.002, block: int = 256, few: int = 0) -> DataFrame:
    """(source, target, sim): k near memories of each by mapped cosine, most of them the nearest.

    ``pool`` is the length of the lists that are kept while searching, at least k; lists of reverse edges are cut to it by hash.
    Repeated rows of an id count once. Up to ``few`` memories the lists are the exact ones, from blocks of products: lists of vectors without
    structure need pools that grow with the table, and below about a million memories the blocks take less time and shuffle less than rounds.
    """
    pool = max(pool, k)
    own = written(memories.select("memory_id", vector.alias("v")).filter("memory_id is not null and v is not null").dropDuplicates(["memory_id"]))
    n = own.count()
    if n <= few:
        return best(graph.lists(own, k, 0.0).withColumn("sim", F.round("sim", 12)), k)
    lists = written(started(own, n, pool, trees))
    for _ in range(rounds):
        back = lists.select(F.col("target").alias("u"), F.col("source").alias("w"), "fresh")
        back = back.withColumn("_n", F.row_number().over(W.partitionBy("u").orderBy(F.desc("fresh"), F.xxhash64("u", "w")))).filter(F.col("_n") <= pool).drop("_n")
        both = lists.select(F.col("source").alias("u"), F.col("target").alias("w"), "fresh").unionByName(back).groupBy("u", "w").agg(F.max("fresh").alias("fresh"))
        bars = lists.groupBy("source").agg(F.when(F.count("*") >= pool, F.min("sim")).otherwise(-1.0).alias("bar"))
        sides = own.join(bars, F.col("memory_id") == F.col("source"), "left").select("memory_id", "v", F.coalesce("bar", F.lit(-1.0)).alias("bar"))
        met = both.join(sides, F.col("w") == F.col("memory_id")).select("u", "memory_id", "fresh", "bar", "v", F.pmod(F.xxhash64("u"), F.lit(max(1, n // block))).alias("_b"))
        more = best(met.groupBy("_b").applyInPandas(joined, EDGES).distinct(), pool)
        all_ = lists.select("source", "target", "sim", F.lit(False).alias("fresh")).unionByName(more.withColumn("fresh", F.lit(True)))
        all_ = all_.groupBy("source", "target").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
        lists = written(best(all_, pool, "fresh"))
        if lists.filter("fresh").count() <= least_change * n * pool:
            break
    return best(lists, k)


def across(left: DataFrame, right: DataFrame, k: int, block: int | None = None, itself: bool = False) -> DataFrame:
    """(source, target, sim): the exact k nearest rows of ``right`` for each of ``left``, both (memory_id, v), but not the one of its own
    id unless ``itself``.

    Both sides are dealt into blocks; a pair of blocks is a matrix product and a task's work, of which k rows a row of the left
    block are shuffled."""
    a, b = (graph._blocks(side.count(), block) for side in (left, right))
    number = lambda n: F.pmod(F.xxhash64("memory_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = left.select(F.lit(0).alias("side"), "memory_id", "v", number(a).alias("x"), every(b).alias("y"))
    two = right.select(F.lit(1).alias("side"), "memory_id", "v", every(a).alias("x"), number(b).alias("y"))

    def product(rows: pd.DataFrame) -> pd.DataFrame:
        p, q = rows[rows["side"] == 0], rows[rows["side"] == 1]
        if not len(p) or not len(q):
            return pd.DataFrame({"source": [], "target": [], "sim": []}).astype({"source": "int64", "target": "int64"})
        i, j = p["memory_id"].to_numpy(), q["memory_id"].to_numpy()
        r, c, sim = graph.nearest_columns(np.stack(p["v"].to_numpy()), np.stack(q["v"].to_numpy()), i, j, k, itself)
        return pd.DataFrame({"source": i[r], "target": j[c], "sim": np.round(sim, 12)})

    return best(one.unionByName(two).groupBy("x", "y").applyInPandas(product, EDGES), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n_exact, n_found, recall) over the sources of ``exact``."""
    hit = exact.select("source", "target").join(found.select("source", "target", F.lit(1).alias("hit")), ["source", "target"], "left")
    return hit.agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found")).withColumn("recall", F.col("n_found") / F.col("n_exact"))
