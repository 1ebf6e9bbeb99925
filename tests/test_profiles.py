"""Profile services against plain tensors and loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspace.operators import causal
from loomspace.operators import teleology as te

PROFILE = "memory_id long, profile array<double>"


def test_tucker_cores_are_those_of_the_whole_tensor(spark):
    r = np.random.default_rng(0)
    rows = [(k, r.random(13).tolist()) for k in range(5)] + [(9, [0.0] * 13)]
    ranks, dim = (2, 3, 4), 16
    factor = lambda n, m: np.array([[(math.sin if j % 2 == 0 else math.cos)((i + 1) * (j + 1) * math.pi / (n + 1)) for j in range(m)] for i in range(n)])
    a, b, c = (x / np.linalg.norm(x, axis=0) for x in (factor(13, ranks[0]), factor(13, ranks[1]), factor(dim, ranks[2])))
    third = np.cos(np.arange(dim) / dim)
    got = {x.memory_id: (x.core_norm, x.energy) for x in te.tucker(spark.createDataFrame(rows, PROFILE), ranks, dim).collect()}
    for k, p in rows:
        tensor = np.einsum("i,j,k->ijk", p, p, third)
        core = np.einsum("ijk,ia,jb,kc->abc", tensor, a, b, c)
        norm, whole = np.linalg.norm(core), np.linalg.norm(tensor)
        assert got[k] == (pytest.approx(norm, abs=1e-5), pytest.approx(norm / whole if whole else 0, abs=1e-5))


@pytest.mark.parametrize("group", [None, "temporal", "implementation"])
def test_retrieval_by_three_cosines(spark, group):
    r = np.random.default_rng(1)
    rows = [(k, r.random(13).tolist()) for k in range(60)]
    rows += [(90, [0.0] * 13), (91, rows[3][1])]
    table = spark.createDataFrame(rows, PROFILE).repartition(3)
    asked = table.filter("memory_id % 10 = 0").select(F.col("memory_id").alias("query_id"), "profile")
    cos = lambda x, y: float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)) if np.any(x) and np.any(y) else 0.0
    means = lambda p: [np.mean([p[k] for k in ks]) for ks in te.GROUPS.values()]
    pairs = lambda p: [math.sqrt(max(0, p[i] * p[j])) for i in range(13) for j in range(i + 1, 13)]
    held = dict(rows)
    want = {}
    for q in [i for i in held if i % 10 == 0]:
        found = []
        for m, p in held.items():
            g = means(p)
            score = round(0.5 * cos(held[q], p) + 0.3 * cos(pairs(held[q]), pairs(p)) + 0.2 * cos(means(held[q]), g), 10)
            fits = group is None or list(te.GROUPS)[int(np.argmax(g))] == group or g[list(te.GROUPS).index(group)] > 0.6
            if m != q and score >= 0.3 and fits:
                found.append((-score, m))
        want[q] = [(m, pytest.approx(-s, abs=1e-9)) for s, m in sorted(found)[:10]]
    got = {q: [] for q in want}
    for x in sorted(te.retrieved(asked, table, group=group).collect(), key=lambda x: x["rank"]):
        got[x.query_id].append((x.memory_id, x.score))
    assert got == want


def test_effect_chains_are_the_greedy_ones(spark):
    r = np.random.default_rng(2)
    rows = [(int(k), r.normal(size=3).tolist(), r.normal(size=3).tolist()) for k in range(25)]
    frame = spark.createDataFrame(rows, "memory_id long, cause array<double>, effect array<double>")
    starts = spark.createDataFrame([(k, rows[k][2]) for k in range(4)] + [(9, [0.0] * 3)], "start long, v array<double>")
    cos = lambda x, y: float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
    want = []
    for k in range(4):
        end, seen = rows[k][2], set()
        for hop in range(1, 6):
            best = min((-round(cos(end, c), 9), m, e) for m, c, e in rows if m not in seen)
            if -best[0] < 0.7:
                break
            want.append((k, hop, best[1], pytest.approx(-best[0], abs=1e-6)))
            seen.add(best[1])
            end = best[2]
    got = sorted((x.start, x.hop, x.memory_id, x.sim) for x in causal.effect_chains(frame, starts, 0.7, 5).collect())
    assert got == want and len({x[0] for x in want}) == 4
