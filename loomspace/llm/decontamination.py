"""Benchmark decontamination: a prefix-filtered set join of documents with item-sized windows.

A window is ``size`` consecutive words of an item (all its words, if it has fewer). For exact containment the necessary
prefix of a window is one shingle, so each window is indexed under its rarest one: rarity is the number of windows with
the shingle over a block of items, then how common its words are there. Document shingles are joined with the
index; a hit gives the only place where the window can lie (positional bound), which must fit into the document (length
bound); then the hashes of all its words are compared, and at last their bytes.

Items are dealt into blocks of about ``block_bytes`` of text, each with its own index. Up to ``GROUP`` blocks are broadcast at
a time and met in one scan of the documents, so a broadcast has at most about GROUP * block_bytes of items in it whatever
the benchmark's size. A larger benchmark takes a scan a group; the documents are then written once with a row number, by
which the groups' hits are merged. Every row of documents has one row in the result at any size.

Defined results: null or empty texts have no words and nothing is hit; texts of any length are scanned whole; items without
an id or words have no window; repeated rows of documents each get their own result; equal items all count; an empty table
of documents gives no rows and an empty benchmark no hits; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import id_text, materialise
from ._text import ALNUM, LOWER, RangeHash, blocks, mix, same_bytes

_U = np.uint64
_I = np.int64
GROUP = 16  #: blocks of items that are broadcast together
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
PARTS = "row long, doc_id long, n_words long, spans array<long>, items array<string>"


def shingles(words: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of q words, by their first word."""
    n = max(0, len(words) - q + 1)
    out = np.full(n, _U(q))
    for k in range(q):
        out = mix(out * _U(0x9E3779B97F4A7C15) + words[k : k + n])
    return out


class Words:
    """The words of one block of texts: its lower-case bytes, where each word starts and ends, and their hashes."""

    def __init__(self, block):
        self.start, self.end, self.first = block.words(ALNUM, True)
        self.data = LOWER[block.data]
        self.hash = RangeHash(self.data)(self.start, self.end)


class Index:
    """Windows under their rarest shingles. A window is its first word's place among the items' words, and its length."""

    def __init__(self, items: list[tuple[str, str]], size: int = 10, width: int = 3):
        self.items = [i for i, _ in items]
        texts = pa.array([t for _, t in items], pa.string())
        self.words = w = Words(next(blocks(texts, 1 << 62))) if items else None
        owners: dict[bytes, tuple[int, int, set[int]]] = {}
        for k in range(len(items)):
            a, b = int(w.first[k]), int(w.first[k + 1])
            n = min(size, b - a)
            own = [w.data[s:e].tobytes() for s, e in zip(w.start[a:b].tolist(), w.end[a:b].tolist())]
            for p in range(b - a - n + 1) if n else ():
                owners.setdefault(b" ".join(own[p : p + n]), (a + p, n, set()))[2].add(k)
        self.place, self.length = (np.array([x[k] for x in owners.values()], _I) for k in (0, 1))
        self.owners = [sorted(x[2]) for x in owners.values()]
        self.tables = {}
        for n in np.unique(self.length).tolist():
            self._enter(np.flatnonzero(self.length == n), n, min(width, n))
        self.tables = {q: self._table(*(np.concatenate(x) for x in zip(*rows))) for q, rows in self.tables.items()}

    def _enter(self, windows: np.ndarray, n: int, q: int) -> None:
        """Choose the shingle of each of the windows of n words."""
        h = self.words.hash
        _, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
        each = self.place[windows][:, None] + np.arange(n - q + 1)
        keys = shingles(h, q)[each]
        _, which, rare = np.unique(keys, return_inverse=True, return_counts=True)
        rare = rare[which].reshape(keys.shape)
        common = np.convolve(times[inverse], np.ones(q, _I))[q - 1 :][each]
        at = np.lexsort((keys, common, rare), axis=-1)[:, 0]
        self.tables.setdefault(q, []).append((keys[np.arange(len(windows)), at], windows, at))

    @staticmethod
    def _table(keys: np.ndarray, window: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((offset, window, keys))
        quick = np.zeros(1 << 20, bool)
        quick[(keys & _U((1 << 20) - 1)).astype(_I)] = True
        return keys[order], window[order], offset[order], quick

    def hits(self, d: Words) -> tuple[np.ndarray, np.ndarray]:
        """Word starts and window numbers of all windows that occur within documents."""
        found = [(np.zeros(0, _I),) * 2]
        h, first = d.hash, d.first
        for q, (keys, window, offset, quick) in self.tables.items():
            t = shingles(h, q)
            at = np.flatnonzero(quick[(t & _U((1 << 20) - 1)).astype(_I)])
            lo, hi = np.searchsorted(keys, t[at], "left"), np.searchsorted(keys, t[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if not len(at):
                continue
            k = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pos = np.repeat(at, n)
            w, start = window[k], pos - offset[k]
            doc = np.searchsorted(first, pos, "right") - 1
            fits = (start >= first[doc]) & (start + self.length[w] <= first[np.minimum(doc + 1, len(first) - 1)])
            start, w = start[fits], w[fits]
            for j in range(int(self.length.max())):
                same = j >= self.length[w]
                on = np.flatnonzero(~same)
                same[on] = h[start[on] + j] == self.words.hash[self.place[w[on]] + j]
                start, w = start[same], w[same]
            found.append((start, w))
        return self._exact(d, *(np.concatenate(x) for x in zip(*found)))

    def _exact(self, d: Words, start: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the hits whose words are the window's byte for byte; each pair of words is compared once."""
        if not len(start):
            return start, window
        n = self.length[window]
        hit = np.repeat(np.arange(len(start)), n)
        j = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)
        pair = np.stack([start[hit] + j, self.place[window[hit]] + j], 1)
        pair, which = np.unique(pair, axis=0, return_inverse=True)
        x, y = pair[:, 0], pair[:, 1]
        size = d.end[x] - d.start[x]
        same = size == self.words.end[y] - self.words.start[y]
        on = np.flatnonzero(same)
        same[on] = same_bytes(d.data, d.start[x[on]], self.words.data, self.words.start[y[on]], size[on])
        good = np.bincount(hit, weights=~same[which.ravel()], minlength=len(start)) == 0
        return start[good], window[good]


def _scan(indexes: list[Index], batch: pa.RecordBatch, column: int = 1) -> Iterator[tuple[int, int, np.ndarray, set[str]]]:
    """Row of the batch, words, hit spans (start << 32 | end, words of the document) and items, for each document."""
    for block in blocks(batch.column(column)):
        d = Words(block)
        first, found = d.first, []
        for index in indexes:
            start, w = index.hits(d)
            order = np.argsort(start, kind="stable")
            start, w = start[order], w[order]
            if len(start):
                found.append((index, start, w, np.searchsorted(start, first)))
        for k in range(block.n):
            spans, items = [], set()
            for index, start, w, bounds in found:
                a, b = bounds[k], bounds[k + 1]
                if b > a:
                    own = start[a:b] - first[k]
                    spans.append(own << 32 | (own + index.length[w[a:b]]))
                    items |= {index.items[i] for x in set(w[a:b].tolist()) for i in index.owners[x]}
            yield block.first + k, int(first[k + 1] - first[k]), np.unique(np.concatenate(spans)) if spans else np.zeros(0, _I), items


def _summary(n_words: int, spans: np.ndarray, items: set[str]) -> tuple:
    hit, end = 0, 0
    for x in np.sort(spans).tolist():
        a, b = x >> 32, x & 0xFFFFFFFF
        hit += max(0, b - max(a, end))
        end = max(end, b)
    return n_words, hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hit > 0


def _indexes(spark, benchmark: DataFrame, item_col: str, text_col: str, size: int, block_bytes: int) -> tuple[int, Iterator]:
    """The number of groups, and each group's broadcast of indexes, made when it is asked for."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).dropna()
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("item") + 16)).first()[0] or 0
    parts = int(total // block_bytes) + 1
    groups = -(-parts // GROUP)
    part = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    items = items.withColumn("part", part).withColumn("of", (part / GROUP).cast("int"))
    if groups > 1:
        items = materialise(items, "of")  # each group is read alone

    def made() -> Iterator:
        for g in range(groups):
            own: dict[int, list[tuple[str, str]]] = {}
            for r in items.filter(F.col("of") == g).select("part", "item", "text").toLocalIterator():  # one group of the benchmark
                own.setdefault(r.part, []).append((r.item, r.text))
            yield spark.sparkContext.broadcast([Index(sorted(x), size) for _, x in sorted(own.items())])

    return groups, made()


def decontaminate(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = 10, block_bytes: int = 2 << 20) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    groups, indexes = _indexes(docs.sparkSession, benchmark, item_col, text_col, size, block_bytes)
    docs = id_text(docs)
    if groups == 1:
        return _hits(docs, next(indexes), True)
    docs = materialise(docs.withColumn("row", F.monotonically_increasing_id()))
    union = None
    for shared in indexes:
        own = materialise(_hits(docs, shared, False))
        shared.unpersist()
        union = own if union is None else union.unionByName(own)
    # at most a row a group and document; those without hits have no spans
    merged = union.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _result(zip(b.column(1).to_pylist(), (_summary(n, np.array(s or [], _I), set(i or [])) for n, s, i in zip(*(b.column(k).to_pylist() for k in (2, 3, 4))))))

    return merged.mapInArrow(finish, RESULT)


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = 2 << 20) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, with all their columns; one scan for each group of blocks."""
    at = docs.columns.index("text")
    groups, indexes = _indexes(docs.sparkSession, benchmark, "item_id", "text", size, block_bytes)
    for shared in indexes:

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = [len(spans) for _, _, spans, _ in _scan(shared.value, batch, at)]
                yield batch.filter(pa.array([x == 0 for x in n], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
        if groups > 1:
            docs = materialise(docs)
            shared.unpersist()
    return docs


def _result(rows) -> pa.RecordBatch:
    columns = list(zip(*((d, *x) for d, x in rows))) or [()] * 6
    types = [pa.int64()] * 4 + [pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _hits(docs: DataFrame, shared, whole: bool) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            if whole:
                yield _result((ids[i], _summary(n, s, items)) for i, n, s, items in _scan(shared.value, batch))
            else:
                rows = [(batch.column(2)[i].as_py(), ids[i], n, s, sorted(items)) for i, n, s, items in _scan(shared.value, batch)]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=["row", "doc_id", "n_words", "spans", "items"])

    return docs.mapInArrow(scan, RESULT if whole else PARTS)


def query(spark, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The query in SQL, by joining all windows of documents and items as strings.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS win FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, k, n FROM dw JOIN iw USING (n, win)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""
