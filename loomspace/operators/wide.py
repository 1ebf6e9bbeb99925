"""Normalisation and fusion of scores that are wide: (query_id, memory_id, a column a space), as ``retrieval.wide`` gives them.

The same results as in ``fusion``, whose scores are long. A pair's spaces lie in one row, so only statistics of a query are shuffled; ranks
over all memories take one shuffle by query, and ``retrieval.over_ranks`` is the way for many memories. Every pair has every space.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans import weights as ws
from . import fusion

Spaces = tuple[str, ...]
SAME = 1e-12  # similarities this close are equal


def per_query(scores: DataFrame, **stats: Column) -> DataFrame:
    """The rows with statistics of their query; these are a row a query, which is broadcast."""
    return scores.join(F.broadcast(scores.groupBy("query_id").agg(*(c.alias(n) for n, c in stats.items()))), "query_id")


def ranked(scores: DataFrame, spaces: Spaces) -> DataFrame:
    """Adds ``rank_<space>``, from 0: one shuffle, and a sort a space."""
    for s in spaces:
        scores = scores.withColumn(f"rank_{s}", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(s), "memory_id")) - 1)
    return scores


def normalise(scores: DataFrame, spaces: Spaces, how: str) -> DataFrame:
    """As ``fusion.normalise``."""
    if how == "rank":
        return ranked(scores, spaces).select("query_id", "memory_id", *((1 / (F.col(f"rank_{s}") + 1)).alias(s) for s in spaces))
    if how == "minmax":
        x = per_query(scores, **{f"low_{s}": F.min(s) for s in spaces}, **{f"high_{s}": F.max(s) for s in spaces})
        low, high = (lambda s: F.col(f"low_{s}")), (lambda s: F.col(f"high_{s}"))
        return x.select("query_id", "memory_id", *(F.when(high(s) > low(s), (F.col(s) - low(s)) / (high(s) - low(s))).otherwise(1.0).alias(s) for s in spaces))
    if how == "zscore":
        x = per_query(scores, **{f"mean_{s}": F.avg(s) for s in spaces}, **{f"sd_{s}": F.stddev_pop(s) for s in spaces})
        z = lambda s: (F.greatest(F.lit(-3.0), F.least(F.lit(3.0), (F.col(s) - F.col(f"mean_{s}")) / F.col(f"sd_{s}"))) + 3) / 6
        return x.select("query_id", "memory_id", *(F.when(F.col(f"sd_{s}") > 0, z(s)).otherwise(0.5).alias(s) for s in spaces))
    return scores


def summed(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def score(spaces: Spaces, how: str, weights: dict[str, float] | None = None) -> Column:
    """Of a row: max, sum, mean or weighted (divided by the weights)."""
    w = {s: (weights or {}).get(s, 1.0) for s in spaces}
    total = summed([F.col(s) for s in spaces])
    return {"max": lambda: F.greatest(*spaces), "sum": lambda: total, "mean": lambda: total / len(spaces), "weighted": lambda: summed([w[s] * F.col(s) for s in spaces]) / sum(w.values())}[how]()


def aggregate(scores: DataFrame, spaces: Spaces, how: str, weights: dict[str, float] | None = None) -> DataFrame:
    """As ``fusion.aggregate``."""
    return scores.select("query_id", "memory_id", score(spaces, how, weights).alias("score"))


def reciprocal_ranks(ranks: DataFrame, weights: dict[str, float], times: str | None = None) -> DataFrame:
    """As ``fusion.weighted_rrf``; the term of the space ``times`` is multiplied by its similarity, as in ``score_weighted_rrf``."""
    term = lambda s, w: w / (F.col(f"rank_{s}") + fusion.K + 1) * (F.col(s) if s == times else F.lit(1.0))
    return ranks.select("query_id", "memory_id", summed([term(s, w) for s, w in weights.items() if w > 0 and f"rank_{s}" in ranks.columns]).alias("score"))


def of_ranks(spaces: Spaces, how: str, weights: dict[str, float] | None = None) -> Callable:
    """For ``retrieval.over_ranks``: as ``aggregate`` of scores that are normalised by rank."""
    w = {s: (weights or {}).get(s, 1.0) for s in spaces}

    def run(ranks: dict[str, np.ndarray], sims: dict[str, np.ndarray]) -> np.ndarray:
        x = [1 / (ranks[s] + 1) for s in spaces]
        if how == "max":
            return reduce(np.maximum, x)
        return reduce(np.add, [w[s] * y for s, y in zip(spaces, x)]) / sum(w.values()) if how == "weighted" else reduce(np.add, x) / (len(spaces) if how == "mean" else 1)

    return run


def of_reciprocal_ranks(weights: dict[str, float], times: str | None = None) -> Callable:
    """For ``retrieval.over_ranks``: as ``reciprocal_ranks``."""

    def run(ranks: dict[str, np.ndarray], sims: dict[str, np.ndarray]) -> np.ndarray:
        return reduce(np.add, [w / (ranks[s] + fusion.K + 1) * (sims[s] if s == times else 1.0) for s, w in weights.items() if w > 0 and s in ranks])

    return run


def suppressed(scores: DataFrame, spaces: Spaces, weights: dict[str, float]) -> DataFrame:
    """As ``fusion.suppressed``: statistics of a query alone are shuffled."""
    defined = lambda s: F.when(F.col(s) >= 0, F.col(s))
    stats = scores.groupBy("query_id").agg(*(F.struct(F.lit(s).alias("space"), F.count(defined(s)).alias("n"), F.var_samp(defined(s)).alias("var")).alias(s) for s in spaces))
    stats = stats.select("query_id", F.explode(F.array(*spaces)).alias("x")).select("query_id", "x.*")
    factor = F.when(F.col("n") == 0, 0.0).when((F.col("n") >= 3) & (F.col("var") < 0.001), 0.25).otherwise(1.0)
    return stats.select("query_id", "space", (ws.looked_up(F.col("space"), weights) * factor).alias("w"))


def correlations(scores: DataFrame, spaces: Spaces) -> DataFrame:
    """As ``fusion.correlations``: sums of a query alone are shuffled."""
    both = list(combinations(sorted(spaces), 2))
    stats = scores.groupBy("query_id").agg(F.count("*").alias("n"), *(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")).alias(f"{a}_{b}") for a, b in both))
    return stats.select("query_id", F.explode(F.array(*(f"{a}_{b}" for a, b in both))).alias("x"), "n").select("query_id", "x.a", "x.b", "x.r", "n")


def correlated(moments: DataFrame, spaces: Spaces) -> DataFrame:
    """As ``correlations``, of ``retrieval.moments``; NaN where a space does not vary."""
    both = list(combinations(sorted(spaces), 2))
    varies = lambda s: F.col(f"high_{s}") - F.col(f"low_{s}") > SAME
    r = lambda a, b: F.when(varies(a) & varies(b), F.try_divide(F.col(f"of_{a}_{b}"), F.sqrt(F.col(f"of_{a}_{a}")) * F.sqrt(F.col(f"of_{b}_{b}")))).otherwise(float("nan"))
    return moments.select("query_id", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r(a, b).alias("r")) for a, b in both))).alias("x"), "n").select("query_id", "x.a", "x.b", "x.r", "n")


def adapted(moments: DataFrame, spaces: Spaces, weights: dict[str, float]) -> DataFrame:
    """As ``suppressed``, of ``retrieval.moments``, where every similarity is defined."""
    var = lambda s: F.try_divide(F.col(f"of_{s}_{s}"), F.col("n") - 1)
    w = lambda s: weights.get(s, 0.0) * F.when((F.col("n") >= 3) & (var(s) < 0.001), 0.25).otherwise(1.0)
    return moments.select("query_id", F.explode(F.array(*(F.struct(F.lit(s).alias("space"), w(s).alias("w")) for s in spaces))).alias("x")).select("query_id", "x.*")


def adapted_to(moments: DataFrame, spaces: Spaces, weights: dict[str, float]) -> DataFrame:
    """(query_id, w_<space>): as ``adapted``, a row a query."""
    w = adapted(moments, spaces, weights)
    return w.groupBy("query_id").agg(*(F.max(F.when(F.col("space") == s, F.col("w"))).alias(f"w_{s}") for s in spaces))


def of_semantics(spaces: Spaces) -> Callable:
    """For ``retrieval.best``: as ``fusion.semantic_fusion``, where every similarity is defined; the queries have the columns of ``adapted_to``."""

    def run(sims: dict[str, np.ndarray], block: pd.DataFrame, rows: pd.DataFrame) -> np.ndarray:
        w = {s: block[f"w_{s}"].to_numpy()[:, None] for s in spaces}
        total = reduce(np.add, w.values())
        own = reduce(np.add, [w[s] * sims[s] for s in spaces]) / np.where(total > 0, total, 1.0)
        return np.where(total > 0, own, np.maximum(sims["E1"], 0.0)) if (total <= 0).any() else own

    return run


def of_relevance(spaces: Spaces) -> Callable:
    """For ``retrieval.best``: as ``fusion.relevance``."""
    whole = sum(ws.CATEGORY[s] * (1 - ws.HIGH[s]) for s in spaces)
    return lambda sims, block, rows: reduce(np.add, [ws.CATEGORY[s] * np.maximum(0.0, sims[s] - ws.HIGH[s]) for s in spaces]) / whole


def of_matrix(matrix: dict[tuple[str, str], float]) -> Callable:
    """For ``retrieval.best``: as ``fusion.matrix_score``."""
    whole = sum(matrix.values())
    term = lambda sims, i, j: np.maximum(sims[i], 0.0) if i == j else np.sqrt(np.maximum(sims[i], 0.0) * np.maximum(sims[j], 0.0))
    return lambda sims, block, rows: reduce(np.add, [x * term(sims, i, j) for (i, j), x in matrix.items()]) / whole


def of_synergy(spaces: Spaces, weights: dict[str, float], rate: float = 0.1) -> Callable:
    """For ``retrieval.best``: as ``fusion.synergy_boost``."""

    def run(sims: dict[str, np.ndarray], block: pd.DataFrame, rows: pd.DataFrame) -> np.ndarray:
        high = {s: sims[s] >= ws.HIGH[s] for s in spaces}
        base, one, two = (reduce(np.add, [f(weights.get(s, 0.0)) * x[s] for s in spaces]) for f, x in ((lambda w: w, sims), (lambda w: w, high), (lambda w: w * w, high)))
        return base + rate * (one * one - two) / 2

    return run


def of_tokens(parts: list[tuple[int, int]], at_least: float = 0.0) -> tuple[tuple, Callable]:
    """Spaces and score for ``retrieval.best``: as ``vectors.max_sim`` of tokens that are parts (first dimension, length) of the vector; pairs
    below ``at_least`` are left out."""
    spaces = tuple((a, b) for a in parts for b in parts)

    def run(sims: dict[tuple, np.ndarray], block: pd.DataFrame, rows: pd.DataFrame) -> np.ndarray:
        x = np.round(reduce(np.add, [reduce(np.maximum, [sims[a, b] for b in parts]) for a in parts]) / len(parts), 12)
        return np.where(x >= at_least, x, -np.inf)

    return spaces, run


def bit(space: str) -> int:
    return 1 << (int(space[1:]) - 1)


def at_least(sim: np.ndarray, limit: float) -> np.ndarray:
    """Similarities that reach a limit; they count to 12 places."""
    return sim >= limit - SAME / 2


def masked(sims: dict[str, np.ndarray], spaces: Spaces) -> np.ndarray:
    """The bits of the spaces that are at or above their high threshold."""
    return reduce(np.bitwise_or, [np.where(at_least(sims[s], ws.HIGH[s]), np.int32(bit(s)), np.int32(0)) for s in spaces])


def has(mask: Column, space: str) -> Column:
    return mask.bitwiseAND(F.lit(bit(space))) != 0


def coherent(sims: dict[str, np.ndarray], spaces: Spaces) -> np.ndarray:
    """1 / (1 + population deviation) of a pair's similarities."""
    mean = reduce(np.add, [sims[s] for s in spaces]) / len(spaces)
    return 1 / (1 + np.sqrt(reduce(np.add, [(sims[s] - mean) ** 2 for s in spaces]) / len(spaces)))


def of_scores(spaces: Spaces, how: str, agg: str, weights: dict[str, float] | None = None, places: int | None = None) -> Callable:
    """For ``retrieval.scored``: as ``aggregate`` of scores that ``normalise`` makes, rounded half up to some places. For minmax and zscore the
    queries have the columns of ``bounds``."""
    w = {s: (weights or {}).get(s, 1.0) for s in spaces}

    def fitted(s: str, x: np.ndarray, block: pd.DataFrame) -> np.ndarray:
        if how == "none":
            return x
        a, b = (block[f"{c}_{s}"].to_numpy()[:, None] for c in ("from", "over"))
        some = b > 0
        x = x - a
        x /= np.where(some, b, 1.0)
        if how == "zscore":
            np.maximum(np.minimum(x, 3.0, out=x), -3.0, out=x)
            x += 3
            x /= 6
        x[~some[:, 0]] = 1.0 if how == "minmax" else 0.5
        return x

    def run(sims: dict[str, np.ndarray], block: pd.DataFrame) -> np.ndarray:
        total = None
        for s in spaces:
            x = fitted(s, sims[s], block)
            x = x * w[s] if agg == "weighted" else x
            if total is None:
                total = np.array(x)
            else:
                (np.maximum if agg == "max" else np.add)(total, x, out=total)
        if agg in ("mean", "weighted"):
            total /= sum(w.values()) if agg == "weighted" else len(spaces)
        if places is not None:
            total *= 10.0**places
            total += 0.5
            np.floor(total, out=total)
            total /= 10.0**places
        return total

    return run


def bounds(moments: DataFrame, spaces: Spaces, how: str) -> DataFrame:
    """(query_id, from_<space>, over_<space>): what is taken from a similarity and what it is divided by, 0 where a space does not vary."""
    varies = lambda s: F.col(f"high_{s}") - F.col(f"low_{s}") > SAME
    if how == "minmax":
        each = [(F.col(f"low_{s}"), F.col(f"high_{s}") - F.col(f"low_{s}"), s) for s in spaces]
    else:
        each = [(F.col(f"mean_{s}"), F.sqrt(F.col(f"of_{s}_{s}") / F.col("n")), s) for s in spaces]
    return moments.select("query_id", *(c for a, b, s in each for c in (a.alias(f"from_{s}"), F.when(varies(s), b).otherwise(0.0).alias(f"over_{s}"))))
