"""Removal of repeated strings against all strings of all documents."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from loomspace.llm import repeats


def brute(docs, length=100):
    first, out = {}, {}
    for i, t in sorted({d for d in docs if d[0] is not None}):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            if first.setdefault(data[s : s + length], (i, s)) != (i, s):
                gone[s : s + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        left = bytes(np.frombuffer(data, np.uint8)[~gone])
        out[i] = (len(data), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(left).hexdigest())
    return out


def check(spark, docs):
    rows = repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows if r.doc_id is not None} == brute(docs)


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ab", "é", "cd", "xyz", "q"]) for _ in range(r.randrange(1, 5)))
    passages = [" ".join(word() for _ in range(k)) for k in (5, 15, 25, 40, 80)]
    docs = []
    for _ in range(n):
        parts = []
        for _ in range(r.randrange(0, 6)):
            parts.append(r.choice(passages) if r.random() < 0.5 else " ".join(word() for _ in range(r.randrange(1, 60))))
        docs.append(" ".join(parts))
    docs += [r.choice(docs) for _ in range(6)]
    for _ in range(10):
        t = list(r.choice(docs))
        for _ in range(3):
            if t:
                t[r.randrange(len(t))] = "#"
        docs.append("".join(t))
    ids = r.sample(range(1000), len(docs))
    return list(zip(ids, docs))


def test_against_all_strings(spark):
    check(spark, corpus(1) + [(5000, None), (5001, ""), (5002, "a" * 99), (5003, "a" * 100), (5004, "a" * 350), (5005, "ab" * 300), (5006, "short")])


@pytest.mark.parametrize("part", [300, 3000])
def test_hot_grams(spark, monkeypatch, part):
    monkeypatch.setattr(repeats, "PART", part)
    monkeypatch.setattr(repeats, "HOT", part)
    check(spark, corpus(2))


def test_a_gram_in_every_document_is_split(spark, monkeypatch):
    """A passage between different words in every document: its grams have more segments than a part takes."""
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    passage, seen, parts = word(110), [], []
    docs = [(k, word(150) + passage + word(150)) for k in range(300)]
    docs += [(1000 + k, docs[k * 3][1][100:260]) for k in range(40)]
    monkeypatch.setattr(repeats, "HOT", 20_000)
    monkeypatch.setattr(repeats, "PART", 5_000)
    split = repeats.hot_strings

    def watched(strings, n):
        seen.append(strings.count())
        out = split(strings, n)
        parts.extend(x["count"] for x in out.groupBy("part").count().collect())
        return out

    monkeypatch.setattr(repeats, "hot_strings", watched)
    check(spark, docs)
    assert seen[0] > 300 and sum(parts) > 300 and max(parts) < sum(parts) / 4


def test_equal_digests_are_compared(spark, monkeypatch):
    """Bytes decide: within a batch segments of equal digests and other bytes stay apart, and the comparison of sets finds them."""
    data = np.frombuffer(b"abcdabce", np.uint8)
    at = np.array([0, 4])
    assert repeats.by_bytes(data, at, at + 3, np.array([False, True])).tolist() == [False, True]
    assert repeats.by_bytes(data, at, at + 4, np.array([False, True])).tolist() == [False, False]
    row = {"part": -1, "set": 5, "first": True, "doc_id": 1, "start": 7, "size": 3, "bytes": b"abc"}
    later = row | {"first": False, "doc_id": 2}
    assert repeats.compared(pa.Table.from_pylist([later, row]), 3).to_pylist() == [{"doc_id": 2, "run": 7 << 32 | 1}]
    with pytest.raises(ValueError, match="digests"):
        repeats.compared(pa.Table.from_pylist([row, later | {"bytes": b"abd"}]), 3)


def test_sets_of_one_64_bit_name_stay_apart(spark, monkeypatch):
    """Copies of two strings whose gram and digests have one hash: the sets meet in one part and are told apart."""
    constant = lambda *columns: repeats.F.lit(7).cast("long")
    monkeypatch.setattr(repeats.F, "xxhash64", constant)
    r = random.Random(9)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(180)) for _ in range(3)]
    check(spark, [(k, f"{k} {texts[k % 3]}") for k in range(12)])


def test_copies_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PART", 600)
    r = random.Random(5)
    text = "".join(r.choice("abcdefgh ") for _ in range(260))
    docs = [(k, f"{k} {text}") for k in range(120)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        check(spark, docs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_text_and_other_columns(spark):
    r = random.Random(3)
    text = "".join(r.choice("abcdefgh ") for _ in range(150_000))
    docs = [(1, text + text[:500]), (2, "z" * 10 + text[70_000:70_300])]
    rows = repeats.remove_repeats(spark.createDataFrame([(*d, 5, 6, 7) for d in docs], "doc_id long, text string, gram long, run long, part long")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute(docs)


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "x".join(map(str, range(100)))
    rows = repeats.remove_repeats(spark.createDataFrame([(3, text), (3, text), (7, text), (None, text)], "doc_id long, text string")).collect()
    got = sorted((r.doc_id or 0, r.n_removed > 0) for r in rows)
    assert got == [(0, False), (3, False), (3, False), (7, True)]
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_two_stage_order(seed):
    r = np.random.default_rng(seed)
    data = r.integers(97, 97 + [1, 2, 3, 5, 20, 26][seed], 3000).astype(np.uint8)
    text = data.tobytes()
    got = repeats.two_stage(data, 100)
    assert sorted(got.tolist()) == list(range(len(text)))
    prefixes = [text[i : i + 100] for i in got]
    assert prefixes == sorted(prefixes)
