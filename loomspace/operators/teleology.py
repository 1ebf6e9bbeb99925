"""Profile-level services: alignments, correlations, fusion, resolution levels, synergies."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v
from . import fusion
from .retrieval import ROWS, blocks

# Six groups of the 13 spaces (from 0), four runs of them, and three domains of groups.
GROUPS = {"factual": (0, 11, 12), "temporal": (1, 2, 3), "causal": (4, 6), "relational": (7, 10), "qualitative": (8, 9), "implementation": (5,)}
RUNS = ((0, 2), (3, 5), (6, 8), (9, 12))
DOMAINS = {"knowledge": ("factual", "implementation"), "time": ("temporal", "causal"), "relations": ("relational", "qualitative")}


def strategy_scores(a: Column, b: Column) -> dict[str, Column]:
    """Similarities of two 13-element profiles by strategy."""
    group = lambda p: F.array(*(sum((p[k] for k in ks), F.lit(0.0)) / len(ks) for ks in GROUPS.values()))
    profile, groups = v.cosine_raw(a, b), v.cosine_raw(group(a), group(b))
    pairs = [(i, j) for i in range(13) for j in range(i + 1, 13)]
    corr = lambda p: F.array(*(F.sqrt(F.greatest(F.lit(0.0), p[i] * p[j])) for i, j in pairs))
    correlation = v.cosine_raw(corr(a), corr(b))
    return {"cosine": profile, "euclidean": 1 / (1 + v.euclidean(a, b)), "grouped": 0.6 * groups + 0.4 * profile, "correlated": 0.75 * correlation + 0.25 * profile}


def components(p: np.ndarray) -> list[np.ndarray]:
    """Unit rows of profiles, of their 78 correlations and of their six group means; rows without length stay 0."""
    i, j = np.triu_indices(13, 1)
    parts = p, np.sqrt(np.maximum(p[:, i] * p[:, j], 0)), np.stack([p[:, list(ks)].mean(1) for ks in GROUPS.values()], 1)
    return [np.divide(x, n, out=np.zeros_like(x), where=n > 0) for x in parts for n in [np.linalg.norm(x, axis=1, keepdims=True)]]


def retrieved(queries: DataFrame, memories: DataFrame, k: int = 10, at_least: float = 0.3, weights: tuple[float, float, float] = (0.5, 0.3, 0.2), group: str | None = None) -> DataFrame:
    """(query_id, memory_id, score, profile, correlation, grouped, rank): the best k memories (memory_id, profile) of each query (query_id,
    profile) by the weighted mean of three cosines; with ``group`` those alone whose strongest group it is, or who have more than .6 of it.

    A block of queries meets each batch in three matrix products, and a batch's own best k a query are shuffled."""
    total, names = sum(weights), list(GROUPS)

    def scored(block: pd.DataFrame):
        ids, own = block["query_id"].to_numpy("int64"), components(np.stack(block["profile"].to_numpy()))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), ROWS):
                    rows = batch.iloc[at : at + ROWS].sort_values("memory_id")
                    p = np.stack(rows["profile"].to_numpy())
                    sims = [np.clip(a @ b.T, -1, 1) for a, b in zip(own, components(p))]
                    score = np.round(sum(w * x for w, x in zip(weights, sims)) / total, 12) if total > 0 else np.zeros_like(sims[0])
                    ok = (score >= at_least) & (ids[:, None] != rows["memory_id"].to_numpy()[None])
                    if group is not None:
                        means = np.stack([p[:, list(ks)].mean(1) for ks in GROUPS.values()], 1)
                        g = names.index(group)
                        ok &= ((means.argmax(1) == g) | (means[:, g] > 0.6))[None]
                    best = np.argsort(np.where(ok, -score, np.inf), axis=1, kind="stable")[:, :k]
                    i = np.repeat(np.arange(len(ids)), best.shape[1])
                    j = best.ravel()
                    i, j = i[ok[i, j]], j[ok[i, j]]
                    yield pd.DataFrame({"query_id": ids[i], "memory_id": rows["memory_id"].to_numpy()[j], "score": score[i, j]} | {c: x[i, j] for c, x in zip(("profile", "correlation", "grouped"), sims)})

        return run

    schema = "query_id long, memory_id long, score double, profile double, correlation double, grouped double"
    out = memories.sparkSession.createDataFrame([], schema)
    for part in blocks(queries.select("query_id", "profile")):
        block = part.toPandas()
        if len(block):
            out = out.unionByName(memories.select("memory_id", "profile").mapInPandas(scored(block), schema))
    return fusion.top(out, k)


def fused(p: Column) -> tuple[Column, Column, Column]:
    """(mean, mean of the four runs, confidence) of a profile: confidence is the half sum of both times the share above .1."""
    mean = v.total(p) / 13
    runs = sum((sum((p[k] for k in range(a, b + 1)), F.lit(0.0)) / (b - a + 1) for a, b in RUNS), F.lit(0.0)) / 4
    share = F.size(F.filter(p, lambda x: x > 0.1)) / 13
    return mean, runs, (0.5 * mean + 0.5 * runs) * share


def group_alignments(p: Column) -> Column:
    """Array of (group, mean, deviation, coherence)."""
    def one(name: str, ks: tuple[int, ...]) -> Column:
        mean = sum((p[k] for k in ks), F.lit(0.0)) / len(ks)
        sd = F.sqrt(sum(((p[k] - mean) * (p[k] - mean) for k in ks), F.lit(0.0)) / len(ks))
        return F.struct(F.lit(name).alias("grp"), mean.alias("mean"), sd.alias("deviation"), (1 / (1 + sd)).alias("coherence"))

    return F.array(*(one(n, ks) for n, ks in GROUPS.items()))


def group_aggregates(p: Column, ks: tuple[int, ...]) -> dict[str, Column]:
    """Average, maximum, minimum, geometric mean and root mean square of some elements."""
    x = [F.greatest(F.lit(0.0), p[k]) for k in ks]
    n = len(ks)
    logs = sum((F.log(F.greatest(F.lit(1e-12), c)) for c in x), F.lit(0.0)) / n
    squares = sum((c * c for c in x), F.lit(0.0)) / n
    return {"average": sum(x, F.lit(0.0)) / n, "maximum": F.greatest(*x) if n > 1 else x[0], "minimum": F.least(*x) if n > 1 else x[0], "geometric": F.exp(logs), "rms": F.sqrt(squares)}


def resolution(groups: dict[str, Column]) -> tuple[dict[str, Column], Column]:
    """Domains as means of groups, and the mean of domains."""
    domains = {d: sum((groups[g] for g in gs), F.lit(0.0)) / len(gs) for d, gs in DOMAINS.items()}
    return domains, sum(domains.values(), F.lit(0.0)) / len(domains)


def multi_utl(semantic: list[tuple[float, Column]], coherence: list[tuple[float, Column]], emotion: Column, phi: Column) -> Column:
    """sigmoid(2 * sum(t * l * ds) * sum(t * l * dc) * emotion * cos phi)."""
    add = lambda xs: sum((w * c for w, c in xs), F.lit(0.0))
    return 1 / (1 + F.exp(-2 * add(semantic) * add(coherence) * emotion * F.cos(phi)))


def synergy_update(base: float, strength: float, coherence: float, rate: float, success: bool = True) -> float:
    """A synergy moved towards base + .1 * strength * (.8 + .4 * coherence), or towards .98 of it after a failure, by a rate, clamped."""
    target = base + 0.1 * strength * (0.8 + 0.4 * coherence) if success else base * 0.98
    return max(0.0, min(1.0, base + rate * (target - base)))


def tucker(profiles: DataFrame, ranks: tuple[int, int, int] = (4, 4, 128), dim: int = 1024) -> DataFrame:
    """(memory_id, core_norm, energy): the core of the 13 x 13 x dim tensor of element products of a profile, projected by fixed
    sine and cosine factors of the given ranks."""

    def factor(n: int, r: int) -> np.ndarray:
        a = (np.arange(n)[:, None] + 1) * (np.arange(r)[None] + 1) * math.pi / (n + 1)
        f = np.where(np.arange(r)[None] % 2 == 0, np.sin(a), np.cos(a))
        return f / np.linalg.norm(f, axis=0, keepdims=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b, c = factor(13, ranks[0]), factor(13, ranks[1]), factor(dim, ranks[2])
        third = c.T @ np.cos(np.arange(dim) / dim)  # the third mode's profile is fixed, so its projection is one vector
        for rows in batches:
            if not len(rows):
                continue
            p = np.stack(rows["profile"].to_numpy())
            core = (p @ a)[:, :, None, None] * (p @ b)[:, None, :, None] * third[None, None, None]
            norm = np.sqrt((core**2).sum((1, 2, 3)))
            energy = norm / np.maximum(np.linalg.norm(p, axis=1) ** 2 * np.linalg.norm(np.cos(np.arange(dim) / dim)), 1e-12)
            yield pd.DataFrame({"memory_id": rows["memory_id"], "core_norm": np.round(norm, 6), "energy": np.round(energy, 6)})

    return profiles.select("memory_id", "profile").mapInPandas(run, "memory_id long, core_norm double, energy double")
