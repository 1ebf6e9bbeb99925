"""Importance resampling against features counted as strings."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspace.llm import resampling as rs
from tests.test_entry import DATA, QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOC, ITEM = "doc_id long, text string", "item_id long, text string"


def features(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def expected(docs, items):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    raw, target = Counter(bucket(f) for _, t in docs for f in features(t)[1]), Counter(bucket(f) for t in items for f in features(t)[1])
    s, t = sum(raw.values()), sum(target.values())
    gain = [math.floor(1000 * math.log((target[b] + 1) * (s + 10000) / ((raw[b] + 1) * (t + 10000)))) for b in range(10000)]
    out = []
    for d, text in docs:
        words, own = features(text)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for k, x in enumerate(fit[: 25 * len(fit) // 100]):
        x[4] = k + 1
    return Counter(map(tuple, out))


def got(frame):
    return Counter(tuple(r) for r in frame.collect())


def made(seed):
    r = random.Random(seed)
    vocabulary = ["the", "The", "of", "é", "Ça", "x1", "9", "梦", "a" * 40, *("w%d" % k for k in range(300))]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "_", "\x00", "-é-"]) for _ in range(n))
    docs = [(k, text(r.choice([0, 1, 2, 19, 20, 21, 60, 300]))) for k in range(150)] + [(900, None), (901, ""), (None, text(50)), (None, text(50)), (7, docs_repeat := text(80)), (7, docs_repeat), (902, "b" * 300_000 + " c"), (903, "d " * 9000)]
    return docs, [text(30) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize(("seed", "piece", "stretch"), [(0, rs.PIECE, rs.STRETCH), (1, 64, 50), (2, 7, 3)])
def test_draw_is_the_plain_one(spark, seed, piece, stretch, monkeypatch):
    docs, items = made(seed)
    gain = rs.gains(*({k: v for k, v in rs.counted(spark.createDataFrame([(x,) for x in t], "text string")).items()} for t in ([x for _, x in docs], items)))
    assert got(rs.resampled(spark.createDataFrame(docs, DOC), spark.createDataFrame(list(enumerate(items)), ITEM))) == expected(docs, items)
    # the same features whatever the pieces and tries
    texts = pa.array([t for _, t in docs])
    cut = rs.pieces
    monkeypatch.setattr(rs, "pieces", lambda t: cut(t, piece))
    crc = [Counter(), Counter()]
    for trie, ids, rows, follows in rs.stretches(texts, rs.Shifts(), stretch):
        for level, (state, node, row) in enumerate(rs.nodes(trie, ids, rows, follows)):
            crc[level].update(zip(row.tolist(), state[node].tolist()))
    want = [Counter(), Counter()]
    for k, (_, t) in enumerate(docs):
        w, own = features(t)
        want[0].update((k, zlib.crc32(f.encode())) for f in own[: len(w)])
        want[1].update((k, zlib.crc32(f.encode())) for f in own[len(w) :])
    assert crc == want and len(gain) == 10000


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=20), st.binary(max_size=300))
def test_states_advance_as_bytes_do(a, b):
    shifts = rs.Shifts()
    row = shifts.row(len(b))
    moved = rs.apply(shifts.tables[row], np.array([zlib.crc32(a)], np.uint32))
    assert int(moved[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_query_over_the_tables(spark):
    docs, items = pd.read_parquet(f"{DATA}/documents.parquet"), pd.read_parquet(f"{DATA}/benchmark.parquet")
    assert got(QUERIES["op12_importance_resampling"](spark, DATA)) == expected(list(zip(docs.doc_id.tolist(), docs.text)), list(items.text))


def test_ties_and_empty_tables(spark):
    scored = spark.createDataFrame([(k, 20 + k % 2, 1, 0, 5 if k % 3 else 6) for k in range(100)] + [(500, 3, 1, 0, 99)], "doc_id long, n_words long, n_features long, weight long, score long")
    order = sorted(range(100), key=lambda k: (-(5 if k % 3 else 6), k))[:25]
    assert {r.doc_id: r["rank"] for r in rs.drawn(scored).collect() if r["rank"]} == {d: k + 1 for k, d in enumerate(order)}
    docs, none = spark.createDataFrame([(1, "a b"), (2, None)], DOC), spark.createDataFrame([], ITEM)
    assert rs.resampled(docs.limit(0), none).collect() == []
    assert {r.doc_id: (r.n_features, r["rank"]) for r in rs.resampled(docs, none).collect()} == {1: (3, None), 2: (0, None)}
    wide = spark.createDataFrame([(1, "a b", 4, "s")], f"{DOC}, weight int, score string")
    assert rs.resampled(wide, none).first().n_features == 3
