"""Entities: extraction, co-occurrence, entity search and translation-based scores."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as v

# Known names and their types, a selection.
KNOWN = {"python": "language", "rust": "language", "spark": "framework", "postgres": "database", "linux": "system", "apache": "organisation", "mit": "organisation", "gnu": "organisation"}
# Relations and their inverses.
RELATIONS = {"uses": "used_by", "depends_on": "required_by", "part_of": "contains", "causes": "caused_by", "related_to": "related_to", "implements": "implemented_by"}


def extract(docs: DataFrame, text: str = "content") -> DataFrame:
    """(memory_id, entity, entity_type, confidence): mentions, 1.0 for known names, else 0.5."""
    m = docs.select("memory_id", F.explode(tx.mentions(F.col(text))).alias("entity"))
    known = docs.sparkSession.createDataFrame(list(KNOWN.items()), "entity string, entity_type string")  # a fixed table
    out = m.join(F.broadcast(known), "entity", "left")
    return out.select("memory_id", "entity", F.coalesce("entity_type", F.lit("unknown")).alias("entity_type"), F.when(F.col("entity_type").isNotNull(), 1.0).otherwise(0.5).alias("confidence"))


def cooccurrence(found: DataFrame, scanned: int, at_least: int = 1, most_common: float = 1.0, min_relation_score: float = 0.0) -> DataFrame:
    """(a, b, n, weight): entities that share memories; weight is n over memories scanned. All names are paired unless a caller asks
    for ``most_common``, and only edges below ``min_relation_score`` are left out. Pairs are made from each memory's own set, equal
    sets once with their number, so a name in all memories joins nothing; names in too few memories for any edge are dropped first."""
    least = max(at_least, math.ceil(min_relation_score * scanned - 1e-9))
    own = found.filter("memory_id is not null and entity is not null").select("memory_id", "entity")
    if least > 1 or most_common < 1:
        df = own.groupBy("entity").agg(F.count_distinct("memory_id").alias("df"))
        own = own.join(df.filter((F.col("df") >= least) & (F.col("df") <= most_common * scanned)).select("entity"), "entity")
    sets = own.groupBy("memory_id").agg(F.array_sort(F.collect_set("entity")).alias("es")).groupBy("es").agg(F.count("*").alias("k"))
    first = sets.select("es", "k", F.posexplode("es").alias("at", "a"))
    pairs = first.select("a", "k", F.explode(F.slice("es", F.col("at") + 2, F.size("es"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.sum("k").alias("n")).filter(F.col("n") >= least).withColumn("weight", F.col("n") / scanned)


def match(asked: Column, own: Column, mode: str = "any") -> Column:
    return F.arrays_overlap(asked, own) if mode == "any" else F.size(F.array_except(asked, own)) == 0


def combined(e1: Column, e11: Column, jaccard: Column, at_least: float = 0.3) -> Column:
    """.30 E1 + .35 E11 + .35 Jaccard; 1.05 times if two of them agree, 1.10 if all."""
    n = sum(((c >= at_least).cast("int") for c in (e1, e11, jaccard)), F.lit(0))
    return (0.30 * e1 + 0.35 * e11 + 0.35 * jaccard) * F.when(n == 3, 1.10).when(n == 2, 1.05).otherwise(1.0)


class Shared:
    """For ``retrieval.best`` of queries with entities ``qs`` and memories with entities ``es``, each one once: as ``combined``, over E1 and E11, of
    pairs that share an entity; a batch meets the queries by the entities of both."""

    def __init__(self) -> None:
        self.block = None

    def __call__(self, sims: dict[str, np.ndarray], block: pd.DataFrame, rows: pd.DataFrame) -> np.ndarray:
        if self.block is not block:
            self.block, own = block, defaultdict(list)
            for i, es in enumerate(block["qs"]):
                for e in es:
                    own[e].append(i)
            self.held, self.size = {e: np.array(i) for e, i in own.items()}, block["qs"].map(len).to_numpy()
        cells, many = [np.zeros(0, "int64")], len(rows)
        for j, es in enumerate(rows["es"]):
            cells += [self.held[e] * many + j for e in es if e in self.held]
        both = np.bincount(np.concatenate(cells), minlength=len(block) * many).reshape(len(block), many)
        jaccard = both / np.maximum(self.size[:, None] + rows["es"].map(len).to_numpy()[None] - both, 1)
        n = (sims["E1"] >= 0.3).astype(int) + (sims["E11"] >= 0.3) + (jaccard >= 0.3)
        score = (0.30 * sims["E1"] + 0.35 * sims["E11"] + 0.35 * jaccard) * np.array([1.0, 1.0, 1.05, 1.10])[n]
        return np.where(both > 0, score, -np.inf)


def transe(h: Column, r: Column, t: Column) -> Column:
    """-||h + r - t||."""
    return -F.sqrt(v.total(F.zip_with(F.zip_with(h, r, lambda a, b: a + b), t, lambda a, b: (a - b) * (a - b))))


def confidence(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score + 15) / 15))


def verdict(score: Column) -> Column:
    return F.when(score > -5, "valid").when(score >= -10, "uncertain").otherwise("unlikely")


def relation_vector(name: str, dim: int) -> list[float]:
    """A fixed vector of a relation; a relation and its inverse point opposite ways."""
    forward = name in RELATIONS
    base = name if forward else next(k for k, x in RELATIONS.items() if x == name)
    k = list(RELATIONS).index(base) + 1
    sign = 1 if forward else -1
    return [sign * math.cos(k * (j + 1)) / math.sqrt(dim) for j in range(dim)]
