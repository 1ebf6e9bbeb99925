"""Lattice scores against enumerated segmentations and a plain recount of the word model."""

import math
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest

from loomspace.llm import lattice

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def enumerated(text, weights, longest=20):
    """Sum over all segmentations, one by one."""
    if not text:
        return 1.0
    total, single = 0.0, text[0] in weights
    for k in range(1, min(len(text), longest) + 1):
        if text[:k] in weights:
            total += math.exp(weights[text[:k]]) * enumerated(text[k:], weights)
    if not single:
        total += math.exp(sum(weights[f"<0x{b:02X}>"] for b in text[0].encode())) * enumerated(text[1:], weights)
    return total


@pytest.mark.parametrize("word", ["▁the", "▁thereof", "▁éa", "▁梦x", "▁\x01z", "▁Ωaé", "▁"])
def test_forward_is_the_sum_over_segmentations(word):
    weights = lattice.start_weights(lattice.vocabulary(MODEL))
    assert math.isclose(sum(map(math.exp, weights.values())), 1)
    x = lattice.Lattice(weights)
    assert math.isclose(x.forward(word), math.log(enumerated(word, weights)), rel_tol=1e-9)


def test_expected_counts_cover_the_word():
    x, into = lattice.Lattice(lattice.start_weights(lattice.vocabulary(MODEL))), {}
    x.expect("▁another梦", 3.0, into)
    size = sum(n * (1 / 3 if p.startswith("<0x") else len(p)) for p, n in into.items())
    assert math.isclose(size, 3.0 * len("▁another梦"), rel_tol=1e-9)


@pytest.mark.parametrize("word", ["▁thereof", "▁a", "▁éaux", "▁" + "internationalisation" * 2])
def test_both_ways_of_expecting_agree(word, monkeypatch):
    x, plain, logs = lattice.Lattice(lattice.start_weights(lattice.vocabulary(MODEL))), {}, {}
    x.expect(word, 2.0, plain)
    monkeypatch.setattr(x, "_expect_plain", lambda *_: False)
    x.expect(word, 2.0, logs)
    assert plain.keys() == logs.keys() and all(math.isclose(plain[p], logs[p], rel_tol=1e-9) for p in plain)


def test_scores(spark):
    docs = [(k, f"the cat {k % 3} sat on The mat\n{'dog ' * (k % 4)}") for k in range(60)] + [(100, None), (101, ""), (102, "Unseenword 梦 zzz"), (103, "x" * 3000), (None, "the"), (7, "the cat 1 sat on The mat\ndog dog dog ")]
    rows = lattice.score(spark.createDataFrame(docs, "doc_id long, text string"), MODEL).collect()
    assert len(rows) == len(docs)
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None]
    out = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    c = Counter(w for d, t in docs if not out(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = {d: (out(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for d, t in docs}
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert math.isclose(r.base_score, want[r.doc_id][4], rel_tol=1e-12)
        assert -1e6 < r.score < 0
    by = {r.doc_id: r for r in rows}
    assert by[1].score > 3 * by[102].score
    assert lattice.score(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []


def segmentations(text, weights, longest=20):
    """Every segmentation as (log weight, pieces)."""
    if not text:
        yield 0.0, ()
        return
    for k in range(1, min(len(text), longest) + 1):
        if text[:k] in weights:
            for w, rest in segmentations(text[k:], weights, longest):
                yield w + weights[text[:k]], (text[:k], *rest)
    if text[0] not in weights:
        own = tuple(f"<0x{b:02X}>" for b in text[0].encode())
        for w, rest in segmentations(text[1:], weights, longest):
            yield w + sum(weights[p] for p in own), (*own, *rest)


def test_scores_are_the_enumerated_ones(spark):
    """Each score from all segmentations of all words, one by one: expected uses over training words, weights, probabilities."""
    docs = [(k, f"{a} {b}\t{a.upper()}") for k, (a, b) in enumerate([("ab", "cat"), ("dog", "éa"), ("thin", "ab"), ("梦", "x1"), ("cat", "cab")] * 6)]
    docs += [(100, None), (101, "unseen cat"), (102, "q")]
    start = lattice.start_weights(lattice.vocabulary(MODEL))
    out = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    uses, ends = Counter(), sum(not out(d) for d, _ in docs)
    for word, n in Counter(w for d, t in docs if not out(d) for w in words(t)).items():
        every = list(segmentations("▁" + word, start))
        total = sum(math.exp(w) for w, _ in every)
        for w, pieces in every:
            for p in pieces:
                uses[p] += n * math.exp(w) / total
    whole = math.log(sum(uses.values()) + lattice.PRIOR + ends + 1)
    weights = {p: math.log(uses[p] + lattice.PRIOR * math.exp(w)) - whole for p, w in start.items()}
    end = math.log(ends + 1) - whole
    frame = spark.createDataFrame([(*d, 1, 2, 3, 4) for d in docs], "doc_id long, text string, word int, n int, block int, score int")
    rows = lattice.score(frame, MODEL).collect()
    assert len(rows) == len(docs) and sum(x.held_out for x in rows)
    for x in rows:
        want = (sum(math.log(enumerated("▁" + w, weights)) for w in words(dict(docs)[x.doc_id])) + end) / math.log(10)
        assert math.isclose(x.score, want, rel_tol=1e-9)


def test_long_text(spark):
    text = "the cat " * 300_000
    x = lattice.score(spark.createDataFrame([(1, text), (2, "the cat")], "doc_id long, text string"), MODEL).collect()
    by = {r.doc_id: r for r in x}
    assert by[1].n_tokens == 600_001 and by[1].score < 1000 * by[2].score < 0


def test_training_helps_held_out_text(spark, tmp_path):
    docs = [(k, " ".join(f"{a}{b}" for a in ("ber", "lin", "gen") for b in ("tor", "ab")[: 1 + k % 2])) for k in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    total = lambda rounds: sum(r.score for r in lattice.score(frame, MODEL, rounds).collect() if r.held_out)
    assert total(1) > total(0)
