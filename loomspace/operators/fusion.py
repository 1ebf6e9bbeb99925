"""Ranking, normalisation and fusion of per-space scores.

Scores are long: (query_id, memory_id, space, sim). Every ranking ends in memory_id, so ties have an order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans import weights as ws

K = 60  # fixed value of reciprocal-rank fusion


def ranked(scores: DataFrame, by: tuple[str, ...] = ("query_id", "space"), score: str = "sim") -> DataFrame:
    """Adds ``rank``, from 0, by falling score and then memory_id."""
    return scores.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), F.asc("memory_id"))) - 1)


def top(scores: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), score: str = "score") -> DataFrame:
    """The best k rows of each group, with their rank; Spark limits groups before the shuffle."""
    return ranked(scores, by, score).filter(F.col("rank") < k)


def weighted_rrf(ranks: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(query_id, memory_id, score): sum of w / (60 + rank + 1); spaces of weight 0 are left out."""
    used = ranks.filter(F.col("space").isin([s for s, w in weights.items() if w > 0]))
    return used.groupBy("query_id", "memory_id").agg(F.sum(ws.looked_up(F.col("space"), weights) / (F.col("rank") + K + 1)).alias("score"))


def score_weighted_rrf(ranks: DataFrame, weights: dict[str, float], space: str = "E5") -> DataFrame:
    """As weighted_rrf, the term of one space multiplied by its similarity."""
    used = ranks.filter(F.col("space").isin([s for s, w in weights.items() if w > 0]))
    term = ws.looked_up(F.col("space"), weights) / (F.col("rank") + K + 1) * F.when(F.col("space") == space, F.col("sim")).otherwise(1.0)
    return used.groupBy("query_id", "memory_id").agg(F.sum(term).alias("score"))


def weighted_sum(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    return scores.groupBy("query_id", "memory_id").agg(F.sum(ws.looked_up(F.col("space"), weights) * F.col("sim")).alias("score"))


def plain_rrf(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("query_id", "memory_id").agg(F.sum(1 / (F.col("rank") + K + 1)).alias("score"))


def additive_rrf(ranks: DataFrame, boost: float = 0.1) -> DataFrame:
    """RRF with memories that one space alone found raised by 1 + boost."""
    out = ranks.groupBy("query_id", "memory_id").agg(F.sum(1 / (F.col("rank") + K + 1)).alias("base"), F.count_distinct("space").alias("n_spaces"), F.min_by("space", "rank").alias("space"))
    return out.withColumn("score", F.col("base") * F.when(F.col("n_spaces") == 1, 1 + boost).otherwise(1.0))


def fuse(ranks: DataFrame, weights: dict[str, float], strategy: str = "weighted_rrf") -> DataFrame:
    """Fusion by the strategy's name."""
    return {"weighted_rrf": weighted_rrf, "score_weighted_rrf": score_weighted_rrf, "weighted_sum": weighted_sum}[strategy](ranks, weights)


def min_max(scores: DataFrame) -> DataFrame:
    """Scores within (query, space) brought to [0, 1]; equal scores are 1."""
    w = W.partitionBy("query_id", "space")
    low, high = F.min("sim").over(w), F.max("sim").over(w)
    return scores.withColumn("sim", F.when(high > low, (F.col("sim") - low) / (high - low)).otherwise(1.0))


def z_scores(scores: DataFrame) -> DataFrame:
    """(clamp(z, -3, 3) + 3) / 6 with the population deviation; 0.5 where all scores are equal."""
    w = W.partitionBy("query_id", "space")
    sd = F.stddev_pop("sim").over(w)
    z = (F.col("sim") - F.avg("sim").over(w)) / sd
    return scores.withColumn("sim", F.when(sd > 0, (F.greatest(F.lit(-3.0), F.least(F.lit(3.0), z)) + 3) / 6).otherwise(0.5))


def rank_scores(scores: DataFrame) -> DataFrame:
    return ranked(scores).withColumn("sim", 1 / (F.col("rank") + 1)).drop("rank")


def normalise(scores: DataFrame, how: str) -> DataFrame:
    return {"none": lambda s: s, "minmax": min_max, "zscore": z_scores, "rank": rank_scores}[how](scores)


def aggregate(scores: DataFrame, how: str, weights: dict[str, float] | None = None) -> DataFrame:
    """One score per memory: max, sum, mean or weighted (divided by the weights)."""
    w = ws.looked_up(F.col("space"), weights or {}, 1.0)
    agg = {"max": F.max("sim"), "sum": F.sum("sim"), "mean": F.avg("sim"), "weighted": F.sum(w * F.col("sim")) / F.sum(w)}[how]
    return scores.groupBy("query_id", "memory_id").agg(agg.alias("score"))


def suppressed(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(query_id, space, w): weights adapted to degenerate spaces. All similarities below 0: weight 0; a sample variance
    below 0.001 of at least 3 defined values: a quarter."""
    defined = F.when(F.col("sim") >= 0, F.col("sim"))
    stats = scores.groupBy("query_id", "space").agg(F.count(defined).alias("n"), F.var_samp(defined).alias("var"))
    factor = F.when(F.col("n") == 0, 0.0).when((F.col("n") >= 3) & (F.col("var") < 0.001), 0.25).otherwise(1.0)
    return stats.select("query_id", "space", (ws.looked_up(F.col("space"), weights) * factor).alias("w"))


def semantic_fusion(scores: DataFrame, adapted: DataFrame) -> DataFrame:
    """Weighted mean over spaces with a defined similarity and a weight; max(E1, 0) if there is none."""
    joined = scores.join(adapted, ["query_id", "space"])
    use = (F.col("sim") >= 0) & (F.col("w") > 0)
    total = F.sum(F.when(use, F.col("w")))
    e1 = F.greatest(F.lit(0.0), F.max(F.when(F.col("space") == "E1", F.col("sim"))))
    return joined.groupBy("query_id", "memory_id").agg(F.coalesce(F.sum(F.when(use, F.col("w") * F.col("sim"))) / total, e1).alias("score"))


def agreement(scores: DataFrame) -> DataFrame:
    """(query_id, memory_id, agreement, n_spaces, mask): category weight of spaces at or above their high threshold."""
    high = F.col("sim") >= ws.looked_up(F.col("space"), ws.HIGH)
    bit = F.expr("shiftleft(1, cast(substring(space, 2) as int) - 1)")
    return scores.groupBy("query_id", "memory_id").agg(F.sum(F.when(high, ws.looked_up(F.col("space"), ws.CATEGORY)).otherwise(0.0)).alias("agreement"), F.count(F.when(high, 1)).alias("n_spaces"), F.coalesce(F.bit_or(F.when(high, bit)), F.lit(0)).alias("mask"))


def relevance(scores: DataFrame) -> DataFrame:
    """Sum of w * max(0, s - high) over the sum of w * (1 - high)."""
    w, high = ws.looked_up(F.col("space"), ws.CATEGORY), ws.looked_up(F.col("space"), ws.HIGH)
    return scores.groupBy("query_id", "memory_id").agg((F.sum(w * F.greatest(F.lit(0.0), F.col("sim") - high)) / F.sum(w * (1 - high))).alias("score"))


def matrix_score(scores: DataFrame, matrix: dict[tuple[str, str], float]) -> DataFrame:
    """Sum of M_ij * (s_i if i = j, else sqrt(s_i s_j)) over the sum of M_ij, for the pairs of a search matrix."""
    wide = scores.groupBy("query_id", "memory_id").agg(F.map_from_entries(F.collect_list(F.struct("space", "sim"))).alias("s"))
    value = lambda s: F.greatest(F.lit(0.0), F.coalesce(F.col("s")[s], F.lit(0.0)))
    top_ = sum((m * (value(i) if i == j else F.sqrt(value(i) * value(j))) for (i, j), m in matrix.items()), F.lit(0.0))
    return wide.select("query_id", "memory_id", (top_ / sum(matrix.values())).alias("score"))


def correlations(scores: DataFrame) -> DataFrame:
    """(query_id, a, b, r, n): Pearson correlation of every two spaces over the memories that both scored."""
    a, b = (scores.select("query_id", "memory_id", F.col("space").alias(x), F.col("sim").alias(f"s{x}")) for x in "ab")
    return a.join(b, ["query_id", "memory_id"]).filter("a < b").groupBy("query_id", "a", "b").agg(F.corr("sa", "sb").alias("r"), F.count("*").alias("n"))


def coherence(scores: DataFrame) -> DataFrame:
    """(query_id, coherence): mean over memories that two spaces scored of 1 / (1 + population deviation)."""
    per = scores.groupBy("query_id", "memory_id").agg(F.count("*").alias("n"), F.stddev_pop("sim").alias("sd")).filter("n >= 2")
    return per.groupBy("query_id").agg(F.avg(1 / (1 + F.col("sd"))).alias("coherence"))


def consensus(scores: DataFrame, spaces: tuple[str, ...], threshold: float = 0.5) -> DataFrame:
    """Share of the spaces that score a memory above the threshold."""
    hit = F.when((F.col("sim") > threshold) & F.col("space").isin(*spaces), 1.0)
    return scores.groupBy("query_id", "memory_id").agg((F.coalesce(F.sum(hit), F.lit(0.0)) / len(spaces)).alias("consensus"))


def synergy_boost(scores: DataFrame, weights: dict[str, float], rate: float = 0.1) -> DataFrame:
    """Weighted sum plus rate * w_i * w_j for every two spaces above their high threshold."""
    w, high = ws.looked_up(F.col("space"), weights), F.col("sim") >= ws.looked_up(F.col("space"), ws.HIGH)
    one = F.coalesce(F.sum(F.when(high, w)), F.lit(0.0))
    two = F.coalesce(F.sum(F.when(high, w * w)), F.lit(0.0))
    return scores.groupBy("query_id", "memory_id").agg((F.sum(w * F.col("sim")) + rate * (one * one - two) / 2).alias("score"))


def blind_spots(scores: DataFrame, high: str = "E9", low: str = "E1", at_least: float = 0.5, at_most: float = 0.3) -> DataFrame:
    """Memories that one space finds and another does not; score is the gap."""
    wide = scores.groupBy("query_id", "memory_id").agg(F.max(F.when(F.col("space") == high, F.col("sim"))).alias("high"), F.max(F.when(F.col("space") == low, F.col("sim"))).alias("low"))
    return wide.filter((F.col("high") >= at_least) & (F.col("low") <= at_most)).withColumn("score", F.col("high") - F.col("low"))


def capped(score: Column) -> Column:
    return F.least(F.lit(1.0), score)
