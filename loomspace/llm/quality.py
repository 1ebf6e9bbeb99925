"""Quality rules [native]: counts, and a hashed n-gram log-likelihood ratio, by DataFrame functions alone.

Two multinomials over hashed word uni- and bigrams are counted in one pass over all documents: the trusted target (rows
of ``labels`` with quality 1 and toxic 0) and the raw corpus (every document). A document's ratio is the mean over its
n-grams of ln p_target - ln p_raw. An n-gram's own occurrence is left out of its raw count, and both counts start from
``PRIOR`` n-grams a bucket in the corpus's own proportion: an n-gram that few documents have then says nothing, at any size of the
corpus, and one that many have counts by how often trusted documents have it. A document is kept if its mean is at least
``threshold`` and no base rule fails. The rule is deterministic; n-grams that only junk has pull the mean down, and those of clean
text stay near 0.

Only the two counts of ``buckets`` buckets reach the driver, and their weights go into the plan as one constant array.

Defined results: null or empty text has no words and fails the base rule; a document without words has a ratio of null;
repeated rows each get their own result; texts of any length are read whole; without labels the ratio is 0 and only base rules
decide; an empty table of documents gives no rows; other columns are ignored, whatever their names. Windows are compared by
64-bit hashes within one document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import id_text

SPACE = "[ \\t\\n\\x0B\\f\\r]+"
SPACES = (" ", "\t", "\n", "\x0b", "\f", "\r")
SYMBOLS = "#*$%&|<>"
BUCKETS = 1 << 17  #: of hashed n-grams; bounds what the driver gets
PRIOR = 50.0  #: n-grams that each bucket starts with
THRESHOLD = -0.04  #: least mean log ratio per n-gram, in nats


def occurrences(text: Column, characters) -> Column:
    """How many of ``characters`` (ASCII) are in ``text``."""
    whole = F.octet_length(text)
    return sum((whole - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in characters), F.lit(0)).cast("long")


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def hashed(d: DataFrame) -> DataFrame:
    """Adds h1 and h2, the hashes of words and of word pairs, to documents with ``words``; pairs hash the words' hashes."""
    d = d.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    return d.withColumn("h2", pairwise("h1", "h1", 2))


def pairwise(a: str, b: str, at: int) -> Column:
    """Hashes of each element of ``a`` with the one of ``b`` that starts ``at`` - 1 later, as far as both go."""
    n = F.greatest(F.lit(0), F.size(b) - (at - 1))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, at, n), lambda x, y: F.xxhash64(x, y))


def counts(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The base counts of documents (doc_id, text): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, with the
    hashes of words and pairs; columns of ``keep`` stay."""
    d = docs.withColumn("text", F.coalesce("text", F.lit("")))
    d = hashed(d.withColumn("words", split_words(F.col("text"))))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t\\x0B\\f\\r]"))
    d = d.select(
        "doc_id", *keep, "text", "h1", "h2",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - occurrences(F.col("text"), SPACES)).cast("long").alias("word_chars"),
        occurrences(F.col("text"), SYMBOLS).alias("n_symbols"),
        lines.alias("lines"),
        pairwise("h2", "h1", 3).alias("windows"),
    )
    d = d.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    return d.withColumn("n_repeat_words", repeated_words()).drop("windows")


def repeated_words() -> Column:
    """Words inside 3-word windows that the document has twice or more: equal windows become neighbours by sorting with
    their places, then the places' ranges of three are joined up."""
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    # one lambda argument binds the sorted array, so it is computed once
    ordered = F.transform(F.array(F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))), lambda s: F.filter(
        s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])))[0]
    places = F.transform(F.array(F.sort_array(F.transform(ordered, lambda x: x["i"]))), lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))[0]
    return F.when(some, F.coalesce(places, F.lit(0))).otherwise(F.lit(0)).cast("long")


def ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """ln p_target - ln p_raw of each bucket, counted over all documents."""
    trusted = labels.filter("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("trusted", F.lit(1))
    # labels grow with the documents, so they are merged in at every size and never broadcast
    words = docs.join(trusted.hint("merge"), "doc_id", "left").select(F.coalesce("trusted", F.lit(0)).alias("t"), split_words(F.coalesce("text", F.lit(""))).alias("words"))
    grams = hashed(words).select("t", F.explode(F.concat("h1", "h2")).alias("h")).select("t", F.pmod("h", F.lit(buckets)).alias("b"))
    rows = grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("target")).collect()  # at most ``buckets`` rows
    n, m = sum(r.raw for r in rows), sum(r.target for r in rows)
    if not m:
        return [0.0] * buckets
    share = m / n
    found = {r.b: math.log((r.target + PRIOR * share) / ((r.raw - 1 + PRIOR) * share)) for r in rows}
    return [round(found.get(b, 0.0), 6) for b in range(buckets)]


def constant(weights: list[float]) -> Column:
    """``weights`` as one constant array: a single string that the optimizer splits once."""
    return F.split(F.lit(",".join(map(str, weights))), ",").cast("array<double>")


def judged(docs: DataFrame, labels: DataFrame, buckets: int, threshold: float, keep: tuple[str, ...] = ()) -> DataFrame:
    weights = constant(ratios(docs, labels, buckets))
    d = counts(docs, keep)
    add = lambda a, h: a + F.get(weights, F.pmod(h, F.lit(buckets)).cast("int"))
    total = F.aggregate("h2", F.aggregate("h1", F.lit(0.0), add), add)
    d = d.withColumn("llr", F.when(F.col("n_words") > 0, F.round(total / (F.lit(2) * F.col("n_words") - 1), 9)))
    failed = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    return d.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.coalesce("llr", F.lit(0.0)) >= threshold))


def quality(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: the counts, ``base_failed``, ``kept`` and ``llr``."""
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
    return judged(id_text(docs), labels, buckets, threshold).select(*names)


def keep(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    rest = F.struct(*[c for c in docs.columns if c != "text"] or [F.lit(1).alias("_")]).alias("_rest")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("text").isNull().alias("_null"), rest)
    # a row number keeps the filter above the projections: pushed below, it would compute each of them many times over
    kept = judged(own, labels, buckets, threshold, ("_null", "_rest")).withColumn("_n", F.monotonically_increasing_id()).filter("kept and _n >= 0")
    text = F.when(F.col("_null"), F.lit(None)).otherwise(F.col("text"))
    return kept.select(*(text.alias("text") if c == "text" else F.col(f"_rest.`{c}`") for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
