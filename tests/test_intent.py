"""Causal intent of questions."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspace.operators import causal

CASES = [
    ("Why does the build fail?", "cause"), ("what happens if i drop the table", "effect"), ("hello", "unknown"), (None, "unknown"), ("", "unknown"),
    ("what are the consequences of this", "effect"), ("it is not the root cause", "unknown"), ("never mind; much later in the text the root cause", "cause"),
    ("the ROOT CAUSE and the effect of it", "cause"), ("don't predict", "unknown"), ("déjà vu, troubleshoot", "cause"), ("not root cause. root cause", "unknown"),
]


def test_intents(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "k long, t string")
    assert [r.i for r in rows.select("k", causal.intent(F.col("t")).alias("i")).orderBy("k").collect()] == [i for _, i in CASES]


@pytest.mark.parametrize("text", ["why not because of what led to this", "this leads to no effect of it, thus hence", "it causes an increase, doesn't it, in side effect via gene expression"])
def test_counts_are_the_plain_ones(spark, text):
    def plain(phrases):
        first = [(p, text.find(p)) for p in phrases if p in text]
        return sum(not any(n in text[max(0, at - 15) : at + 1] for n in causal.NEGATIONS) for _, at in first)

    row = spark.createDataFrame([(text,)], "t string")
    for phrases in (causal.CAUSE_PHRASES, causal.EFFECT_PHRASES):
        assert row.select(causal.phrase_count(F.col("t"), phrases)).first()[0] == plain(phrases)


def test_phrases_are_found_in_one_pass():
    """As counts of each phrase in each text, over texts of all lengths; the parts of an array count as the array."""
    r = random.Random(2)
    words = [*causal.CAUSE_PHRASES[:40], *causal.EFFECT_PHRASES[:40], *causal.NEGATIONS, "é", "\U0001f600", "wh", "why", "x ", " ", "root caus", "", "effect o"]
    texts = ["".join(r.choice(words) for _ in range(r.randrange(0, 30))) for _ in range(700)] + ["", "abc", "why", "thus"]

    def plain(text, phrases):
        first = [(p, text.find(p)) for p in phrases if p in text]
        return sum(not any(n in text[max(0, at - 15) : at + 1] for n in causal.NEGATIONS) for _, at in first)

    kinds = (causal.CAUSE_PHRASES, causal.EFFECT_PHRASES)
    got = causal.held_phrases(pa.array(["why ", *texts, "hence"]).slice(1, len(texts)), *kinds)
    assert [list(map(int, x)) for x in got] == [[plain(t, k) for t in texts] for k in kinds] and sum(got[0]) > 700
    assert [len(x) for x in causal.held_phrases(pa.array([], pa.string()), *kinds)] == [0, 0]
