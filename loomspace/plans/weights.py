"""Spaces, their constants, and weight profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = [f"E{k}" for k in range(1, 14)]

# Thresholds and category weights of E1..E13.
HIGH = dict(zip(SPACES, [0.75, 0.70, 0.70, 0.70, 0.70, 0.60, 0.80, 0.70, 0.70, 0.70, 0.70, 0.70, 0.60]))
LOW = dict(zip(SPACES, [0.30, 0.30, 0.30, 0.30, 0.25, 0.20, 0.35, 0.30, 0.30, 0.30, 0.30, 0.30, 0.20]))
EDGE = dict(zip(SPACES, [0.75, 0.70, 0.70, 0.70, 0.60, 0.50, 0.70, 0.60, 0.60, 0.70, 0.65, 0.60, 0.50]))
CATEGORY = dict(zip(SPACES, [1.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.5, 0.5, 1.0, 0.5, 1.0, 1.0]))
CATEGORY_MAX, AGREEMENT = 8.5, 2.5
DIVERGENCE = ("E1", "E6", "E7", "E10", "E12", "E13")
# Weights of E1..E13 by profile.
_PROFILES = {
    "semantic_search": [0.33, 0, 0, 0, 0.15, 0.05, 0.20, 0.05, 0.02, 0.15, 0.05, 0, 0],
    "causal_reasoning": [0.40, 0, 0, 0, 0.10, 0.05, 0.15, 0.10, 0, 0.10, 0.10, 0, 0],
    "code_search": [0.20, 0, 0, 0, 0.10, 0.10, 0.40, 0, 0, 0.10, 0.10, 0, 0],
    "fact_checking": [0.15, 0, 0, 0, 0.15, 0.15, 0.05, 0.05, 0, 0.05, 0.40, 0, 0],
    "graph_reasoning": [0.15, 0, 0, 0, 0.10, 0.10, 0, 0.40, 0, 0.05, 0.20, 0, 0],
    "temporal_navigation": [0.13, 0.23, 0.23, 0.23, 0.03, 0.02, 0.03, 0.02, 0.03, 0.03, 0.02, 0, 0],
    "sequence_navigation": [0.20, 0.05, 0, 0.55, 0.03, 0.02, 0.03, 0.02, 0.03, 0.03, 0.02, 0, 0.02],
    "conversation_history": [0.30, 0.05, 0, 0.35, 0.10, 0.03, 0.05, 0.02, 0, 0.05, 0.03, 0, 0.02],
    "category_weighted": [x / 6.5 for x in (1, 0, 0, 0, 1, 1, 1, 0.5, 0.5, 1, 0.5, 0, 0)],
    "typo_tolerant": [0.30, 0, 0, 0, 0.10, 0.07, 0.15, 0.03, 0.18, 0.12, 0.05, 0, 0],
    "pipeline_stage1_recall": [0.20, 0, 0, 0, 0.05, 0.25, 0.10, 0, 0.05, 0.05, 0.05, 0, 0.25],
    "pipeline_stage2_scoring": [0.50, 0, 0, 0, 0.12, 0.05, 0.15, 0.03, 0.02, 0.08, 0.05, 0, 0],
    "pipeline_full": [0.40, 0, 0, 0, 0.10, 0.10, 0.15, 0.03, 0.02, 0.08, 0.05, 0, 0.07],
    "balanced": [0.077] * 12 + [0.076],
    "default": [0.35, 0, 0, 0, 0.16, 0.05, 0.21, 0.05, 0.02, 0.16, 0, 0, 0],
}
PROFILES: dict[str, dict[str, float]] = {k: dict(zip(SPACES, map(float, v))) for k, v in _PROFILES.items()}


def validate(weights: dict[str, float]) -> dict[str, float]:
    """A profile's weights, each in [0, 1] and together within 0.01 of 1."""
    bad = [s for s, w in weights.items() if s not in SPACES or not 0 <= w <= 1]
    if bad:
        raise ValueError(f"weights out of range: {', '.join(bad)}")
    if abs(sum(weights.values()) - 1) > 0.01:
        raise ValueError(f"weights sum to {sum(weights.values()):.3f}")
    return weights


def without(weights: dict[str, float], *excluded: str) -> dict[str, float]:
    """Weights with spaces left out, the rest scaled to the same sum; an error if none is left."""
    left = {s: w for s, w in weights.items() if s not in excluded and w > 0}
    if not left:
        raise ValueError("no space is left")
    scale = sum(weights.values()) / sum(left.values())
    return {s: left.get(s, 0.0) * scale for s in weights}


def table(spark: SparkSession, profiles: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(profile, space, w)."""
    rows = [(p, s, w) for p, ws in (profiles or PROFILES).items() for s, w in ws.items()]
    return spark.createDataFrame(rows, "profile string, space string, w double")


def constants(spark: SparkSession) -> DataFrame:
    """(space, high, low, edge, category)."""
    return spark.createDataFrame([(s, HIGH[s], LOW[s], EDGE[s], CATEGORY[s]) for s in SPACES], "space string, high double, low double, edge double, category double")


def looked_up(space: Column, values: dict[str, float], default: float = 0.0) -> Column:
    """A constant of the row's space."""
    pairs = [x for s, v in values.items() for x in (F.lit(s), F.lit(float(v)))]
    return F.coalesce(F.create_map(*pairs)[space], F.lit(default))
