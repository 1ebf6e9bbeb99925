"""Suffix-array removal of repeated byte strings.

A byte goes if any string of ``length`` bytes over it also starts earlier (smaller doc_id, or the same document and an
earlier start). Matches never cross documents.

Every such string has a minimal gram (the smallest hash among its grams of ``gram`` bytes, the leftmost of equals), so
equal strings have equal minimal grams at the same place in them. Consecutive starts with the same minimal gram are one
segment. Segments meet by the hash of their gram. Segments of one gram with equal keyed digests are one segment with several
places, of which all but the first are covered once their bytes have been compared with the first's; segments
whose gram also has others go on to suffix sorting. Those are dealt into parts by gram, and each part's
suffixes are sorted in two stages: the suffixes that are smaller than their successors are sorted directly, the rest is
induced by one scan over the buckets. Neighbours with a common prefix of ``length`` bytes are repeats of the earliest of them.

A part holds about ``PART`` bytes. A gram with segments of more than ``HOT`` bytes is dealt over several parts, by string and
not by segment: each of its strings that another one may equal goes to the part that its own hash names, and is suffix-sorted
there. So a gram that stands in any share of all documents is split. Every verdict between different segments comes
from the sort, and every one between equal ones from their bytes; digests and hashes only bring them together. (Segments
of equal digests and different bytes, one chance in 2^128, end the run with an error.)

Defined results: null or empty text has no bytes; rows without an id match nothing and keep all; repeated rows of one id
are one document; texts of any length are read whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import id_text, materialise
from ._text import Block, RangeHash, blocks, mix

_U = np.uint64
_I = np.int64
LENGTH, GRAM = 100, 32
PART = 1 << 20  #: bytes of segments in a part, about
HOT = 4 << 20  #: bytes of one gram's segments that one part takes
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (8 at least) at every place; equal ones only bring segments together."""
    n = len(data) - gram + 1
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,))
    out = np.full(n, _U(gram))
    for at in [*range(0, gram - 8, 8), gram - 8]:
        out = (out ^ eight[at : at + n]) * _U(0x9E3779B97F4A7C15)
        out ^= out >> _U(29)
    return mix(out)


def segments(block: Block, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document in the block, first start, number of starts, gram hash) of all segments of a block; starts count within
    the block."""
    n, w = len(block.data), length - gram + 1
    size = np.maximum(0, np.diff(block.at) - length + 1)
    if not size.any():
        return tuple(np.zeros(0, t) for t in (_I, _I, _I, _U))
    at = np.arange(n - gram + 1)
    h = gram_hashes(block.data, gram)
    low = (h & _U(0xFFFFFFFF00000000)) | at.astype(_U)  # the smallest hash, then the leftmost
    span = 1
    while span * 2 <= w:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
    doc = np.repeat(np.arange(block.n), size)
    start = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(block.at[:-1], size)
    place = (low[start] & _U(0xFFFFFFFF)).astype(_I)
    edge = np.ones(len(start), bool)
    edge[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(edge)
    count = np.diff(np.append(first, len(start)))
    return doc[first], start[first], count, h[place[first]]


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: bytes) -> np.ndarray:
    """Two 64-bit halves of the digest of each segment's bytes, which also settle where its gram is."""
    text, blake = data.tobytes(), hashlib.blake2b
    found = b"".join([blake(text[a:b], digest_size=16, salt=key).digest() for a, b in zip(start.tolist(), end.tolist())])
    return np.frombuffer(found, _I).reshape(-1, 2)


def runs(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start << 32 | count) of ranges of starts; ranges that touch are one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + count)[order]
    if not len(doc):
        return doc, start
    edge = np.ones(len(doc), bool)
    edge[1:] = (doc[1:] != doc[:-1]) | (start[1:] != end[:-1])
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first] << 32 | (end[last] - start[first])


def by_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Those of ``again`` whose bytes are the ones of the segment before."""
    text, out = data.tobytes(), again.copy()
    for k in np.flatnonzero(again).tolist():
        out[k] = text[start[k] : end[k]] == text[start[k - 1] : end[k - 1]]
    return out


def anchored(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Segments (gram, x, y, doc_id, run) with the halves x and y of their digests; those that a block covers itself come
    joined up, with x and y null."""
    key = os.urandom(16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column(0).to_numpy(zero_copy_only=False), _I)
            for block in blocks(batch.column(1)):
                doc, s, count, g = segments(block, length, gram)
                x = digests(block.data, s, s + count + length - 1, key)
                own = s - block.at[doc]
                who = ids[block.first + doc]
                order = np.lexsort((own, who, x[:, 1], x[:, 0], g))
                again = np.zeros(len(order), bool)
                a, b = order[1:], order[:-1]
                again[1:] = (g[a] == g[b]) & (x[a] == x[b]).all(1) & ((who[a] != who[b]) | (own[a] != own[b]))
                again = by_bytes(block.data, s[order], (s + count + length - 1)[order], again)
                kept, gone = order[~again], order[again]
                d, r = runs(who[gone], own[gone], count[gone])
                spread = mix(d.astype(_U) * _U(0x9E3779B97F4A7C15) + r.astype(_U))
                absent = np.arange(len(kept) + len(d)) >= len(kept)
                half = lambda k: pa.array(np.concatenate([x[kept, k], np.zeros(len(d), _I)]), mask=absent)
                columns = [
                    pa.array(np.concatenate([g[kept], spread]).view(_I)), half(0), half(1),
                    pa.array(np.concatenate([who[kept], d])),
                    pa.array(np.concatenate([own[kept] << 32 | count[kept], r])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "x", "y", "doc_id", "run"])

    return docs.mapInArrow(run, "gram long, x long, y long, doc_id long, run long")


def two_stage(data: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array of ``data`` by the first ``depth`` bytes at least; suffixes equal so far stand together."""
    n = len(data)
    if not n:
        return np.zeros(0, _I)
    text = data.tobytes()
    step = np.sign(np.append(data[1:].astype(np.int16), -1) - data.astype(np.int16))  # the end is smaller than any byte
    known = np.flatnonzero(step)  # equal neighbours go as the end of their run
    smaller = step[known[np.searchsorted(known, np.arange(n))]] > 0
    sizes = np.bincount(data, minlength=256)
    head = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    direct = sorted(np.flatnonzero(smaller).tolist(), key=lambda i: text[i : i + depth])
    direct = np.array(direct, _I)
    array = np.zeros(n, _I)
    # within a byte's bucket the induced suffixes stand before the direct ones
    own = data[direct] if len(direct) else data[:0]
    rank = np.arange(len(direct)) - np.searchsorted(own, own, "left")
    per = np.bincount(own, minlength=256)
    array[head[own] + sizes[own] - per[own] + rank] = direct
    out, larger, at = array.tolist(), (~smaller).tolist(), head.tolist()
    if larger[n - 1]:
        out[at[text[n - 1]]] = n - 1
        at[text[n - 1]] += 1
    for i in out:
        if i and larger[i - 1]:
            c = text[i - 1]
            out[at[c]] = i - 1
            at[c] += 1
    return np.array(out, _I)


def repeated(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Group numbers of ``starts``: equal for equal strings of ``length`` bytes, by neighbours in the suffix array."""
    rank = np.zeros(len(data), _I)
    rank[two_stage(data, length)] = np.arange(len(data))
    order = np.argsort(rank[starts], kind="stable")
    s = starts[order]
    a, b = s[:-1], s[1:]
    same = np.zeros(len(a), bool)
    at = np.arange(len(a))
    for k in range(length):  # the common prefix
        at = at[data[a[at] + k] == data[b[at] + k]]
    same[at] = True
    group = np.zeros(len(s), _I)
    group[order] = np.concatenate([[0], np.cumsum(~same)])
    return group


def compared(table: pa.Table, length: int) -> pa.Table:
    """Covered runs among segments of equal digests: all but the first of each set, if their bytes are the first's."""
    names, texts = table.column("set").to_pylist(), table.column("bytes").to_pylist()
    first = table.column("first").to_numpy()
    of = {names[k]: texts[k] for k in np.flatnonzero(first).tolist()}
    later = np.flatnonzero(~first)
    if any(of[names[k]] != texts[k] for k in later.tolist()):
        raise ValueError("segments of equal digests differ; another run takes another key")
    doc, start, size = (np.array(table.column(c).to_numpy(), _I)[later] for c in ("doc_id", "start", "size"))
    return pa.table({"doc_id": pa.array(doc), "run": pa.array(start << 32 | (size - length + 1))})


def sorted_parts(cut: DataFrame, length: int) -> DataFrame:
    """Covered runs (doc_id, run) among the segments (part, set, first, doc_id, start, size, bytes) of each part; parts below 0 hold
    sets of equal digests, which are compared byte for byte."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() < 0:
            return compared(table, length)
        doc, start, size = (np.array(table.column(c).to_numpy(), _I) for c in ("doc_id", "start", "size"))
        texts = table.column("bytes").to_pylist()
        data = np.frombuffer(b"".join(texts), np.uint8)
        count = size - length + 1
        base = np.cumsum(size) - size
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        who, s = np.repeat(doc, count), np.repeat(start, count) + inner
        group = repeated(data, np.repeat(base, count) + inner, length)
        order = np.lexsort((s, who, group))
        g, w, t = group[order], who[order], s[order]
        later = np.zeros(len(g), bool)
        later[1:] = g[1:] == g[:-1]
        # the same document may hold a row more than once
        equal = np.zeros(len(g), bool)
        equal[1:] = later[1:] & (w[1:] == w[:-1]) & (t[1:] == t[:-1])
        first = np.maximum.accumulate(np.where(~later, np.arange(len(g)), 0))
        later &= ~(equal & (w == w[first]) & (t == t[first]))
        d, r = runs(w[later], t[later], np.ones(int(later.sum()), _I))
        return pa.table({"doc_id": pa.array(d), "run": pa.array(r)})

    return cut.groupBy("part").applyInArrow(run, "doc_id long, run long")


def cut_out(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes (part, set, first, doc_id, start, size, bytes) of segments (part, set, first, doc_id, run)."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("part", "run", "set", "first")).alias("runs"))  # of one document's segments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = (text.as_py() or "").encode()
                own = own.values
                part, at, group, first = (own.field(k).to_pylist() for k in range(4))
                for p, x, g, f in zip(part, at, group, first):
                    s, n = x >> 32, (x & 0xFFFFFFFF) + length - 1
                    rows.append((p, g, f, doc, s, n, data[s : s + n]))
                if len(rows) > 50_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.binary(), pa.bool_(), *[pa.int64()] * 3, pa.binary()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, types)]
        return pa.RecordBatch.from_arrays(columns, names=["part", "set", "first", "doc_id", "start", "size", "bytes"])

    schema = "part long, set binary, first boolean, doc_id long, start long, size long, bytes binary"
    return docs.join(lists, "doc_id").select("doc_id", "text", "runs").mapInArrow(run, schema)


def unmarked(rows: DataFrame, part) -> DataFrame:
    """Segments for the sort, which need neither set nor first."""
    return rows.select(part.alias("part"), F.lit(None).cast("binary").alias("set"), F.lit(False).alias("first"), "doc_id", "run")


def string_hashes(cut: DataFrame, length: int) -> DataFrame:
    """(hash, doc_id, start) of every string of the segments of hot grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, size = (np.array(batch.column(k).to_numpy(), _I) for k in (3, 4, 5))
            data = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8)
            count, base = size - length + 1, np.cumsum(size) - size
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(base, count) + inner
            columns = [RangeHash(data)(at, at + length).view(_I), np.repeat(doc, count), np.repeat(start, count) + inner]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["hash", "doc_id", "start"])

    return cut.mapInArrow(run, "hash long, doc_id long, start long")


def hot_strings(strings: DataFrame, length: int) -> DataFrame:
    """(part, doc_id, run): the strings (hash, doc_id, start) that others have the hash of, dealt into parts by it.

    A string with more places than a part takes goes into several parts, and its first place into each of them.
    """
    place = F.struct("doc_id", "start")
    few = strings.groupBy("hash").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    few = materialise(few.withColumn("slices", F.ceil(F.col("n") * length / PART)))
    total = few.agg(F.sum(F.col("n") + F.col("slices"))).first()[0] or 0
    own = F.array(F.pmod(F.xxhash64("doc_id", "start"), "slices"))
    slices = F.when(place == F.col("first"), F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).otherwise(own)
    met = strings.join(few, "hash").withColumn("slice", F.explode(slices))
    part = F.pmod(F.xxhash64("hash", "slice"), F.lit(int(total * length // PART) + 1))
    return unmarked(met.withColumn("run", F.shiftleft("start", 32) + 1), part)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256, and with ``keep_text`` the kept bytes."""
    docs = id_text(docs)
    named = docs.filter("doc_id is not null")
    found = anchored(named, length, gram).repartition("gram")
    equal, same = W.partitionBy("gram", "x", "y").orderBy("doc_id", "run"), W.partitionBy("gram")
    found = found.withColumn("nth", F.dense_rank().over(equal)).withColumn("n", F.count("*").over(equal.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    found = found.withColumn("low", F.min("x").over(same)).withColumn("high", F.max("x").over(same))
    inner, first = F.col("x").isNull(), F.col("nth") == 1
    mixed = first & (F.col("low") != F.col("high"))
    found = found.filter(inner | (F.col("n") > 1) | mixed)
    name = F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in ("gram", "x", "y"))))  # the whole digest, so that sets of other bytes don't share a name
    found = materialise(found.select("gram", F.when(F.col("n") > 1, name).alias("set"), inner.alias("inner"), F.when(inner, 0).otherwise(F.col("n")).alias("n"), first.alias("first"), (mixed & ~inner).alias("mixed"), "doc_id", "run"))
    gone = found.filter("inner").select("doc_id", "run")
    size = F.col("run").bitwiseAND(0xFFFFFFFF) + (length - 1)
    own = F.when(F.col("mixed"), size)
    total = found.filter("not inner").agg(F.sum(own).alias("mixed"), F.sum(F.when(F.col("n") > 1, size)).alias("sets")).first()
    if total.mixed or total.sets:
        # sets of equal digests; a set with more places than a part takes goes into several, and its first place into each of them
        slices = F.ceil(F.col("n") * size / PART)
        places = F.when(F.col("first"), F.sequence(F.lit(0).cast("long"), slices - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id", "run"), slices)))
        sets = found.filter("n > 1").withColumn("slice", F.explode(places))
        number = F.pmod(F.xxhash64("set", "slice"), F.lit(int((total.sets or 0) // PART) + 1))
        sets = sets.select((-1 - number).alias("part"), "set", "first", "doc_id", "run")
        rows = found.filter("mixed")
        hot = materialise(rows.groupBy("gram").agg(F.sum(size).alias("n")).filter(F.col("n") > HOT).select("gram"))
        plain = unmarked(rows.join(hot, "gram", "left_anti"), F.pmod(F.xxhash64("gram"), F.lit(int((total.mixed or 0) // PART) + 1)))
        gone = gone.union(materialise(sorted_parts(cut_out(named, plain.union(sets), length), length)))
        if not hot.isEmpty():
            rest = unmarked(rows.join(hot, "gram", "left_semi"), F.col("gram"))
            strings = materialise(string_hashes(cut_out(named, rest, length), length))
            gone = gone.union(materialise(sorted_parts(cut_out(named, hot_strings(strings, length), length), length)))
    lists = gone.groupBy("doc_id").agg(F.collect_list("run").alias("runs"))
    return kept(docs.join(lists, "doc_id", "left").select("doc_id", "text", "runs"), length, keep_text)


def kept(docs: DataFrame, length: int, keep_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = (text.as_py() or "").encode()
                parts, at, removed, spans = [], 0, 0, 0
                if own.is_valid:
                    r = np.sort(np.array(own.as_py(), _I))
                    s, e = r >> 32, (r >> 32) + (r & 0xFFFFFFFF) + length - 1
                    for a, b in zip(s.tolist(), np.maximum.accumulate(e).tolist()):
                        if spans and a <= at:
                            removed += max(0, b - at)
                        else:
                            parts.append(data[at:a])
                            spans, removed = spans + 1, removed + b - a
                        at = max(at, b)
                left = b"".join([*parts, data[at:]])
                rows.append((doc, len(data), removed, spans, hashlib.sha256(left).hexdigest(), left)[: 5 + keep_text])
            types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_text]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)], names=names)

    return docs.mapInArrow(run, RESULT + (", kept binary" if keep_text else ""))


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The query in SQL, over all strings of 100 bytes, as hexadecimal text.
SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 200) AS win FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS s FROM d)),
c AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS n FROM w) WHERE n > 1),
g AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM c),
r AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM g),
sp AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM r GROUP BY doc_id, span),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM sp),
o AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || any_value(substr(h, 2 * last + 1)) AS rest
 FROM (SELECT k.*, h, max(b) OVER (PARTITION BY doc_id) AS last FROM k JOIN d USING (doc_id)) GROUP BY doc_id)
SELECT doc_id, length(h)::BIGINT // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)
"""
