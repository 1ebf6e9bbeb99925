"""Target-distribution importance resampling over partition-local word tries.

Features are the runs of one and two words of a text; a feature's bucket is the CRC-32 of its bytes modulo ``buckets``. Each task keeps
a trie over the words of the texts it reads: a first-level node is a word with the CRC state of its bytes, a second-level node a word
after it. A second-level node's CRC is the first's state advanced by the space and word below, which is a linear map of 32 bits for
each number of bytes, so whole arrays of nodes are advanced by table look-ups and no pair is ever joined to a string. Nodes hold
counts; a trie that has taken ``STRETCH`` words leaves at most ``buckets`` totals and a new one is begun, so a task's memory is
bounded. Totals are summed over tasks, the gains of all buckets (at most ``buckets`` numbers) go out with the second pass, and
documents are scored by walking the trie's paths with the gains attached to the nodes.

The draw adds Gumbel noise from the id's SHA-256 and takes the highest scores. Scores are whole numbers whose range doesn't grow with
the documents, so their histogram gives each score's first rank, and a window per score numbers its documents by id: no sort of
everything in one task.

Defined results: a null or empty text has no features and weight 0; a null id is hashed as the empty string and comes
first among ties; repeated rows each count and are drawn by themselves; whole texts of any length are read, in pieces between words; without
documents there are no rows, without a benchmark T is 0; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import id_text, materialise

BUCKETS = 10_000
SHARE = 25  #: percent of the documents with enough words that are drawn
LEAST_WORDS = 20
SEED = "7"
PIECE = 1 << 20  #: bytes of a text worked on at once
STRETCH = 1 << 21  #: words that a trie takes before its totals are passed on

#: each byte as a lower-case letter, digit or part of a longer character; all others separate words
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BYTE = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
_STEP = _BYTE  # a CRC register's step over one zero byte is c >> 8 ^ _STEP[c & 255]


class Shifts:
    """Tables that advance a CRC over n zero bytes, made as lengths occur."""

    def __init__(self):
        unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
        self.rows, self.images = {}, {0: unit}
        self.tables = np.zeros((0, 4, 256), np.uint32)

    def image(self, n: int) -> np.ndarray:
        """What becomes of each of the 32 bits after n zero bytes, by halving n."""
        if n not in self.images:
            if n == 1:
                unit = self.images[0]
                own = (unit >> np.uint32(8)) ^ _STEP[unit & np.uint32(255)]
            else:
                own = apply(table(self.image(n - n // 2)), self.image(n // 2))
            self.images[n] = own
        return self.images[n]

    def row(self, n: int) -> int:
        if n not in self.rows:
            self.rows[n] = len(self.rows)
            self.tables = np.concatenate([self.tables, table(self.image(n))[None]])
        return self.rows[n]


def table(image: np.ndarray) -> np.ndarray:
    """(4, 256) sums of the images of each byte's bits."""
    out = np.zeros((4, 256), np.uint32)
    for k in range(32):
        out[k // 8, (np.arange(256) >> (k % 8) & 1) == 1] ^= image[k]
    return out


def apply(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return t[0, c & np.uint32(255)] ^ t[1, c >> np.uint32(8) & np.uint32(255)] ^ t[2, c >> np.uint32(16) & np.uint32(255)] ^ t[3, c >> np.uint32(24)]


class Trie(dict):
    """Words as first-level nodes: a number each, with the word's CRC state, the CRC of a space and the word, and the row of its shift."""

    def __init__(self, shifts: Shifts):
        super().__init__()
        self.shifts, self.words = shifts, []

    def __missing__(self, word: bytes) -> int:
        self[word] = own = len(self.words)
        self.words.append((zlib.crc32(word), zlib.crc32(b" " + word), self.shifts.row(len(word) + 1)))
        return own

    def firsts(self) -> np.ndarray:
        """CRC states of the first-level nodes."""
        return np.array([w[0] for w in self.words], np.uint32)

    def seconds(self, first: np.ndarray, below: np.ndarray) -> np.ndarray:
        """CRC states of the nodes of words ``below`` under words ``first``."""
        state, spaced, row = (np.array(c, kind) for c, kind in zip(zip(*self.words), (np.uint32, np.uint32, np.int64)))
        c, r, t = state[first], row[below], self.shifts.tables
        moved = t[r, 0, c & np.uint32(255)] ^ t[r, 1, c >> np.uint32(8) & np.uint32(255)] ^ t[r, 2, c >> np.uint32(16) & np.uint32(255)] ^ t[r, 3, c >> np.uint32(24)]
        return moved ^ spaced[below]


def pieces(text: memoryview, size: int = PIECE) -> Iterator[bytes]:
    """The text's bytes, cleaned, cut between words; a word longer than a piece stays whole."""
    n, at = len(text), 0
    while at < n:
        end = min(at + size, n)
        own = bytes(text[at:end]).translate(_KEPT)
        if end < n and own[-1] != 32:
            cut = own.rfind(b" ")
            if cut >= 0:
                own, end = own[: cut + 1], at + cut + 1
            else:  # within a long word: on to its end
                more = [own]
                while end < n and (not more[-1] or b" " not in more[-1]):
                    more.append(bytes(text[end : end + size]).translate(_KEPT))
                    end = min(end + size, n)
                own = b"".join(more)
                if end < n and own[-1] != 32:
                    back = len(own) - own.rfind(b" ") - 1
                    own, end = own[: len(own) - back], end - back
        yield own
        at = end


def stretches(texts: pa.Array, shifts: Shifts, most: int = STRETCH) -> Iterator[tuple[Trie, np.ndarray, np.ndarray, np.ndarray]]:
    """A trie, its words' numbers in order with the row of each one's text, and whether a word follows one of its own text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    view = memoryview(data) if data is not None else memoryview(b"")
    trie, ids, rows, follows, held = Trie(shifts), [], [], [], 0

    def take(words: list[bytes], row: int, after: bool) -> None:
        nonlocal held
        if words:
            ids.append(np.fromiter(map(trie.__getitem__, words), np.int64, len(words)))
            rows.append(np.full(len(words), row))
            own = np.ones(len(words), bool)
            own[0] = after
            follows.append(own)
            held += len(words)

    for row in range(len(texts)):
        last = b""
        for piece in pieces(view[at[row] : at[row + 1]]):
            words = piece.split()
            if held + len(words) > most and held:
                yield trie, np.concatenate(ids), np.concatenate(rows), np.concatenate(follows)
                trie, ids, rows, follows, held = Trie(shifts), [], [], [], 0
                if last:  # the word before stays as a node that is not counted again
                    ids.append(np.array([trie[last]]))
                    rows.append(np.array([-1]))
                    follows.append(np.array([False]))
            take(words, row, bool(last))
            last = words[-1] if words else last
    if held:
        yield trie, np.concatenate(ids), np.concatenate(rows), np.concatenate(follows)


def nodes(trie: Trie, ids: np.ndarray, rows: np.ndarray, follows: np.ndarray):
    """Both levels of the nodes that the words pass: the bucket's CRC of each node, each word's node, and each word's row."""
    own = rows >= 0
    yield trie.firsts(), ids[own], rows[own]
    second = np.flatnonzero(follows)
    keys, node = np.unique(ids[second - 1] << 32 | ids[second], return_inverse=True)
    yield trie.seconds(keys >> 32, keys & 0xFFFFFFFF) if len(keys) else np.zeros(0, np.uint32), node, rows[second]


def counted(docs: DataFrame, buckets: int = BUCKETS) -> dict[int, int]:
    """Features of all texts by bucket; at most ``buckets`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shifts = np.zeros(buckets, np.int64), Shifts()
        for batch in batches:
            for trie, ids, rows, follows in stretches(batch.column(0), shifts):
                for crc, node, _ in nodes(trie, ids, rows, follows):
                    held = np.bincount(node, minlength=len(crc))  # the nodes' counts
                    np.add.at(total, (crc % buckets).astype(np.int64), held)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": at, "n": total[at]})

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return {r.bucket: r.n for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(raw: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log of how much likelier each bucket is in the target than in the raw texts."""
    s, t = float(sum(raw.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * s / ((raw.get(b, 0) + 1) * t))) for b in range(buckets)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of (doc_id, text)."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = Shifts()
        for batch in batches:
            n = batch.num_rows
            words, features, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for trie, ids, rows, follows in stretches(batch.column(1), shifts):
                for level, (crc, node, row) in enumerate(nodes(trie, ids, rows, follows)):
                    worth = gain[(crc % buckets).astype(np.int64)]  # the gain attached to each node
                    if len(row):
                        first = np.flatnonzero(np.diff(row, prepend=-1))
                        held, sums = np.diff(np.append(first, len(row))), np.add.reduceat(worth[node], first)
                        features[row[first]] += held
                        total[row[first]] += sums
                        if level == 0:
                            words[row[first]] += held
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise of an id, in floored thousandths."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def drawn(scored: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds rank: 1, 2, 3... for the ``share`` percent of rows with enough words that have the highest scores; else null."""
    fit = F.col("n_words") >= least_words
    # one row a score: scores are thousandths of a log, so their number is bounded whatever the number of rows
    bins = sorted(((r.score, r.n) for r in scored.filter(fit).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    most = sum(n for _, n in bins) * share // 100
    before = [0, *accumulate(n for _, n in bins)]
    firsts = [(s, b) for (s, _), b in zip(bins, before) if b < most]
    if not firsts:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    offsets = F.broadcast(scored.sparkSession.createDataFrame(firsts, "score long, above long"))
    inside = scored.filter(fit & (F.col("score") >= firsts[-1][0])).join(offsets, "score")
    rank = F.col("above") + F.row_number().over(W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first()))
    inside = inside.withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")).cast("long"))
    outside = scored.filter(~fit | (F.col("score") < firsts[-1][0])).withColumn("rank", F.lit(None).cast("long"))
    return inside.select(*outside.columns).union(outside)


def resampled(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank (null: not drawn) and n_words."""
    gain = gains(counted(docs, buckets), counted(target, buckets), buckets)
    scored = weighted(id_text(docs), gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return drawn(materialise(scored), share, least_words).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def query(spark, sf_dir: str) -> DataFrame:
    return resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The query in SQL, with every feature as a string and its CRC-32 by a table.
SQL = r"""
WITH crc AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)
), texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, true AS raw FROM documents
  UNION ALL
  SELECT NULL, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), false FROM benchmark
), runs AS MATERIALIZED (
  SELECT r, doc_id, raw, len(w) AS n, list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS f FROM texts
), each AS MATERIALIZED (
  SELECT r, raw, feature, count(*) AS n FROM (SELECT r, raw, unnest(f) AS feature FROM runs) GROUP BY ALL
), hashed AS (
  SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM each)
), buckets AS MATERIALIZED (
  SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM hashed, crc
), counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE raw), 0) AS s, coalesce(sum(n) FILTER (WHERE NOT raw), 0) AS t FROM each JOIN buckets USING (feature) GROUP BY bucket
), totals AS (
  SELECT sum(s)::DOUBLE + 10000 AS s, sum(t)::DOUBLE + 10000 AS t FROM counts
), gains AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((c.t::DOUBLE + 1) * totals.s / ((c.s::DOUBLE + 1) * totals.t)))::BIGINT AS gain FROM counts c, totals
), sums AS (
  SELECT r, sum(gain * n) AS g FROM each JOIN buckets USING (feature) JOIN gains USING (bucket) WHERE raw GROUP BY r
), scored AS (
  SELECT doc_id, n AS n_words, len(f) AS n_features, CASE WHEN len(f) > 0 THEN floor(g / len(f))::BIGINT ELSE 0 END AS weight,
    ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM runs LEFT JOIN sums USING (r) WHERE raw
), noised AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored
), fit AS (
  SELECT count(*) * 25 // 100 AS most FROM noised WHERE n_words >= 20
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS k FROM noised
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND k <= most THEN k END AS rank, n_words FROM ranked, fit
"""
