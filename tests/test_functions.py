"""Column functions on edge cases."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomspace.functions import hyper
from loomspace.functions import temporal as tf
from loomspace.functions import text as tx
from loomspace.functions import vectors as v
from loomspace.plans import weights as ws
from loomspace.plans.chunks import code_chunks, text_chunks


def one(spark, column, **values):
    names = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    frame = spark.createDataFrame([tuple(x for _, x in values.values())], names) if values else spark.range(1)
    return frame.select(column.alias("x")).first().x


A = "array<double>"


@pytest.mark.parametrize(("a", "b", "mapped", "raw"), [([1.0, 0.0], [1.0, 0.0], 1, 1), ([1.0, 0.0], [0.0, 1.0], 0.5, 0), ([1.0, 0.0], [-2.0, 0.0], 0, -1), ([0.0, 0.0], [1.0, 0.0], 0, 0), ([], [], 0, 0), ([1.0], [1.0, 2.0], 0, 0)])
def test_cosine(spark, a, b, mapped, raw):
    x, y = F.col("a"), F.col("b")
    assert one(spark, v.cosine(x, y), a=(A, a), b=(A, b)) == pytest.approx(mapped)
    assert one(spark, v.cosine_raw(x, y), a=(A, a), b=(A, b)) == pytest.approx(raw)


def test_strict_cosine_refuses_unequal_lengths(spark):
    with pytest.raises(PySparkException):
        one(spark, v.cosine_strict(F.col("a"), F.col("b")), a=(A, [1.0]), b=(A, [1.0, 2.0]))


def test_sets_and_maps(spark):
    s = "array<int>"
    assert one(spark, v.jaccard(F.col("a"), F.col("b")), a=(s, []), b=(s, [])) == 0
    assert one(spark, v.jaccard(F.col("a"), F.col("b")), a=(s, [1, 2]), b=(s, [2, 3])) == pytest.approx(1 / 3)
    m = "map<int,double>"
    assert one(spark, v.weighted_jaccard(F.col("a"), F.col("b")), a=(m, {1: 2.0, 2: 1.0}), b=(m, {1: 1.0, 3: 4.0})) == pytest.approx(1 / 7)
    assert one(spark, v.sparse_cosine(F.col("a"), F.col("b")), a=(m, {}), b=(m, {1: 1.0})) == 0


def test_max_sim_of_nothing_is_zero(spark):
    t = "array<array<double>>"
    assert one(spark, v.max_sim(F.col("a"), F.col("b")), a=(t, []), b=(t, [[1.0]])) == 0
    assert one(spark, v.max_sim(F.col("a"), F.col("b")), a=(t, [[1.0, 0.0]]), b=(t, [[0.0, 1.0], [1.0, 0.0]])) == pytest.approx(1)


@pytest.mark.parametrize(("age", "stepped", "spoken"), [(0, 1.0, "0 seconds ago"), (1, 1.0, "1 second ago"), (299, 1.0, "4 minutes ago"), (300, 0.8, "5 minutes ago"), (3600, 0.5, "1 hour ago"), (86400, 0.3, "1 day ago"), (604800, 0.1, "1 week ago")])
def test_ages(spark, age, stepped, spoken):
    a = F.lit(float(age))
    assert one(spark, tf.stepped(a)) == stepped
    assert one(spark, tf.spoken_age(a)) == spoken
    assert one(spark, tf.exponential(a, 43200)) == pytest.approx(math.exp(-age * math.log(2) / 43200))


def test_encodings_have_unit_length(spark):
    ts = F.timestamp_seconds(F.lit(1_700_000_000))
    for e in (tf.recency_encoding(ts), tf.periodic_encoding(ts), tf.positional_encoding(F.lit("s"), F.lit(7))):
        assert one(spark, F.size(e)) == 512
        assert one(spark, v.norm(e)) == pytest.approx(1)


def test_boost_is_clamped(spark):
    assert one(spark, tf.boosted(F.lit(0.5), F.lit(1.0), 0.9)) == pytest.approx(0.6)
    assert one(spark, tf.boosted(F.lit(0.5), F.lit(0.0), 0.9)) == pytest.approx(0.4)


def test_mentions(spark):
    got = one(spark, tx.mentions(F.lit("The Spark, (snake_case) spark and É-1 x Ab! of")))
    assert got == ["spark", "snake_case", "é-1", "ab"]
    assert one(spark, tx.mentions(F.lit(None).cast("string"))) == []


def test_profiles():
    for name, w in ws.PROFILES.items():
        ws.validate(w), name
    assert sum(ws.without(ws.PROFILES["default"], "E1").values()) == pytest.approx(1)
    for bad in ({"E1": 1.2}, {"E1": 0.5}, {"X": 1.0}):
        with pytest.raises(ValueError):
            ws.validate(bad)
    with pytest.raises(ValueError):
        ws.without({"E1": 1.0}, "E1")


def test_text_chunks():
    words = [f"w{k}" + ("." if k % 37 == 0 else "") for k in range(700)]
    parts = text_chunks(" ".join(words))
    assert parts[0][0] == 0 and parts[-1][1] == 700
    assert all(b[0] <= a[1] for a, b in zip(parts, parts[1:])) and all(e - s <= 200 for s, e in parts)
    assert text_chunks("") == [] and text_chunks("a") == [(0, 1)]


def test_code_chunks_cover_all_lines():
    code = "\n".join(f"fn f{k}() {{\n    let x = {'1' * 90};\n}}\n" for k in range(40))
    parts = code_chunks(code)
    assert parts[0][0] == 0 and parts[-1][1] == len(code.split("\n")) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_codes_of_alike_texts_are_near(spark):
    texts = ["the quick brown fox jumps over the lazy dog", "the quick brown fox jumped over the lazy dog", "zażółć gęślą jaźń 12345 67890"]
    a, b, c = hyper.encode(texts)
    sim = lambda x, y: one(spark, hyper.similarity(F.col("a"), F.col("b")), a=("binary", x), b=("binary", y))
    assert sim(a, a) == 1 and sim(a, b) > sim(a, c) + 0.1
    want = 1 - sum(bin(x ^ y).count("1") for x, y in zip(a, c)) / hyper.BITS
    assert sim(a, c) == pytest.approx(want)
