"""The Jaccard join against all pairs."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from loomspace.llm import similarity
from loomspace.llm._graph import components


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(docs, percent=90):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(seed, families=12, vocabulary=400):
    r = random.Random(seed)
    words = [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in range(vocabulary)]
    docs = []
    for _ in range(families):
        base = [r.choice(words) for _ in range(r.choice([3, 5, 12, 40, 90, 200, 600]))]
        for _ in range(r.choice([1, 2, 5, 14])):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 2, max(1, len(base) // 40), max(1, len(base) // 60)])):
                own[r.randrange(len(own))] = r.choice(words)
            if r.random() < 0.3:
                own = own[: max(1, int(len(own) * r.uniform(0.88, 1)))]
            docs.append(" ".join(own) if r.random() < 0.7 else "\n".join(w.upper() for w in own))
    r.shuffle(docs)
    return docs


def check(spark, docs):
    rows = similarity.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == len(docs)
    assert got == brute(docs)


def test_against_all_pairs(spark):
    docs = [(1000 - k, t) for k, t in enumerate(near_copies(5) + near_copies(6))]
    docs += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "one"), (5005, "one two"), (5006, "ONE\ttwo"), (5007, "x " * 4000), (5008, "X " * 5000)]
    check(spark, docs)


def test_hot_group_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CHUNK", 2000)
    r = random.Random(1)
    base = [f"v{r.randrange(10**6)}" for _ in range(120)]
    docs = []
    for k in range(90):
        own = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 5])):
            own[r.randrange(len(own))] = f"n{r.randrange(10**6)}"
        docs.append((k, " ".join(own)))
    check(spark, docs)


def test_chain_of_links(spark):
    words = [f"c{k}" for k in range(400)]
    check(spark, [(k, " ".join(words[4 * k : 4 * k + 120])) for k in range(60)])


def test_empty_table_and_clashing_columns(spark):
    assert similarity.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(1, "a b c d", 5, 6), (2, "a b c d", 7, 8), (2, "a b c d", 7, 8), (None, "a b c d", 0, 0)], "doc_id long, text string, part long, leader long")
    got = sorted((r.doc_id or 0, r.component_id) for r in similarity.jaccard_components(docs).collect())
    assert got == [(0, 1), (1, 1), (2, 1), (2, 1)]


def test_parts_lose_no_link():
    r = np.random.default_rng(3)
    for percent in (80, 90):
        parts = similarity.Parts(percent)
        for _ in range(300):
            n = int(r.integers(1, 300))
            a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
            b = a
            while True:
                c = np.setdiff1d(b, r.choice(b, 1)) if r.random() < 0.5 else np.unique(np.append(b, r.integers(0, 1 << 63, 1, dtype=np.uint64)))
                both = len(np.intersect1d(a, c))
                if not both or 100 * both < percent * (len(a) + len(c) - both):
                    break
                b = c
            assert set(parts.signatures(a).tolist()) & set(parts.signatures(b).tolist())


@pytest.mark.parametrize("percent", [80, 90])
def test_small_sets_meet_without_empty_parts(percent):
    """Every two small sets that link share a signature, and unrelated ones form no large group."""
    r = np.random.default_rng(percent)
    parts = similarity.Parts(percent)
    for n in range(1, 25):
        for _ in range(60):
            a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
            b = a
            for _ in range(int(r.integers(0, 6))):
                b = np.setdiff1d(b, r.choice(b, 1)) if r.random() < 0.5 and len(b) > 1 else np.unique(np.append(b, r.integers(0, 1 << 63, 1, dtype=np.uint64)))
            both = len(np.intersect1d(a, b))
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                assert set(parts.signatures(a).tolist()) & set(parts.signatures(b).tolist())
    seen = Counter(x for _ in range(3000) for x in set(parts.signatures(np.unique(r.integers(0, 1 << 63, int(r.integers(8, 13)), dtype=np.uint64))).tolist()))
    assert max(seen.values()) == 1


def test_short_texts_against_all_pairs(spark):
    r = random.Random(4)
    docs = []
    for _ in range(60):
        base = [f"u{r.randrange(10**6)}" for _ in range(r.randrange(3, 16))]
        for _ in range(3):
            own = list(base)
            if r.random() < 0.7:
                own[r.randrange(len(own))] = "z"
            docs.append((len(docs), " ".join(own)))
    check(spark, docs)


def test_one_near_copy_in_every_batch(spark):
    """A part that all documents have sends a row a batch to its bucket, and still joins all of them."""
    r = random.Random(6)
    base = [f"v{r.randrange(10**6)}" for _ in range(200)]
    docs = [(1000 - k, " ".join([*base, f"n{k}"])) for k in range(60)] + [(2000 + k, " ".join(f"x{k}y{j}" for j in range(50))) for k in range(20)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        check(spark, docs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_text(spark):
    r = random.Random(7)
    words = [f"w{r.randrange(10**5)}" for _ in range(60_000)]
    near = list(words)
    near[500] = "other"
    check(spark, [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[:30_000]))])


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)]
    up = {}

    def find(k):
        while up.setdefault(k, k) != k:
            k = up[k]
        return k

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for a, b in edges if a != b for k in (a, b)}


def test_sets_of_sliced_arrays():
    whole = pa.array(["a b c d", None, "", "q", "a b c d e"])
    assert [len(s) for s in similarity.sets(whole.slice(1), 3)] == [0, 0, 1, 3]
