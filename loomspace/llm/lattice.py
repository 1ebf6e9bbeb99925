"""LM scoring by subword lattice likelihood.

The model is a unigram over the pieces of an existing vocabulary and an end. A text's probability is the sum over all its
segmentations, by forward recursion in log space; pieces never cross a word's start, so a text's lattice is that of its
words one after the other. Piece weights start from the vocabulary's own scores (ranks: weight 1 / (rank + shift)) and
are re-estimated over all training words by forward-backward expected counts, with the start as a prior; characters that are no piece
go through byte pieces. Beside it stands an add-0.1 unigram over whole words.

Training words are counted by Spark, and each distinct word is segmented once for the estimate and once for its score. What
a document needs reaches it by block, the documents of one stretch of a file: a block's distinct words are joined with the word table
and go back to the block, so no document-level pairs are shuffled and no word list is broadcast. Only sums per
piece and totals reach the driver.

Defined results: null or empty text is the end alone; a null id counts as the empty text and so is held out; repeated rows each get
their own result; texts of any length are scored whole; an empty table gives no rows; other columns are ignored, whatever their names. Words meet by 61-bit hashes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import id_text, materialise
from ._text import LOWER, SPACED, RangeHash, blocks
from .token_counts import MARK, vocabulary

END = " "  #: stands for the end in the word table; no word has a space
BLOCK = 16 << 20  #: bytes of a stretch of a file in one block
SHIFT = 10.0
PRIOR = 3200.0  #: counts that the start weights stand for
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc) -> bool:
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 10 == 0


def start_weights(pieces: list[tuple[str, float]]) -> dict[str, float]:
    """ln p of usable pieces by the vocabulary's scores; byte pieces get the least of them, control pieces none."""
    ranks = {p: -s for p, s in pieces if s < 0 and s > -1e8 and MARK not in p[1:]}
    last = max(ranks.values(), default=1.0)
    ranks |= {f"<0x{b:02X}>": last for b in range(256)}
    w = {p: 1.0 / (r + SHIFT) for p, r in ranks.items()}
    total = sum(w.values())
    return {p: math.log(x / total) for p, x in w.items()}


class Lattice:
    """All segmentations of words under ln p of pieces."""

    def __init__(self, weights: dict[str, float]):
        self.bytes = [weights[f"<0x{b:02X}>"] for b in range(256)]
        self.weights = {p: w for p, w in weights.items() if not (len(p) == 6 and p.startswith("<0x"))}
        self.longest = max(map(len, self.weights), default=1)
        self.trie: dict = {}  # by character; under "" a piece's ln p, p and name
        for p, w in self.weights.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = (w, math.exp(w), p)

    def arcs(self, text: str, end: int) -> list[tuple[int, float, str | None]]:
        """(start, ln p, piece) of all arcs that end at ``end``; a character without a piece is its bytes (piece None)."""
        found, get = [], self.weights.get
        for s in range(max(0, end - self.longest), end):
            w = get(text[s:end])
            if w is not None:
                found.append((s, w, text[s:end]))
        if not found or found[-1][0] != end - 1:
            found.append((end - 1, sum(self.bytes[b] for b in text[end - 1].encode()), None))
        return found

    def forward(self, text: str) -> float:
        """ln of the sum over all segmentations."""
        n, trie = len(text), self.trie
        terms: list[list[float]] = [[] for _ in range(n + 1)]
        a = 0.0
        for s in range(n + 1):
            if s:
                own = terms[s]
                a = own[0]
                if len(own) > 1:
                    a = max(own)
                    a += math.log(sum([math.exp(t - a) for t in own]))
                if s == n:
                    break
            node, e, single = trie, s, False
            for c in text[s : s + self.longest]:
                node = node.get(c)
                if node is None:
                    break
                e += 1
                piece = node.get("")
                if piece is not None:
                    terms[e].append(a + piece[0])
                    single |= e == s + 1
            if not single:
                terms[s + 1].append(a + sum([self.bytes[b] for b in text[s].encode()]))
        return a

    def expect(self, text: str, count: float, into: dict[str, float]) -> None:
        """Adds the expected uses of each piece in ``count`` copies of a word. Words of up to 40 characters are far
        from underflow and need no logarithms."""
        n = len(text)
        if n <= 40 and self._expect_plain(text, n, count, into):
            return
        alpha, arcs = [0.0], [[]]
        for end in range(1, n + 1):
            found = self.arcs(text, end)
            arcs.append(found)
            m = max([alpha[s] + w for s, w, _ in found])
            alpha.append(m + math.log(sum([math.exp(alpha[s] + w - m) for s, w, _ in found])))
        beta = [-math.inf] * n + [0.0]
        for end in range(n, 0, -1):
            b = beta[end]
            if b == -math.inf:
                continue
            for s, w, p in arcs[end]:
                x = w + b
                old = beta[s]
                beta[s] = x if old == -math.inf else max(x, old) + math.log1p(math.exp(-abs(x - old)))
                uses = count * math.exp(min(0.0, alpha[s] + x - alpha[n]))
                if p is not None:
                    into[p] = into.get(p, 0.0) + uses
                else:
                    for c in text[s:end].encode():
                        k = f"<0x{c:02X}>"
                        into[k] = into.get(k, 0.0) + uses

    def _expect_plain(self, text: str, n: int, count: float, into: dict[str, float]) -> bool:
        alpha, arcs, trie = [1.0] + [0.0] * n, [], self.trie
        for s in range(n):
            a, node, e = alpha[s], trie, s
            if "" not in trie.get(text[s], trie):
                codes = text[s].encode()
                p = math.exp(sum([self.bytes[b] for b in codes]))
                alpha[s + 1] += a * p
                arcs.append((s, s + 1, (0.0, p, codes)))
            for c in text[s : s + self.longest]:
                node = node.get(c)
                if node is None:
                    break
                e += 1
                piece = node.get("")
                if piece is not None:
                    alpha[e] += a * piece[1]
                    arcs.append((s, e, piece))
        if alpha[n] < 1e-280:
            return False
        beta = [0.0] * n + [count / alpha[n]]
        for s, e, (_, p, name) in reversed(arcs):
            x = p * beta[e]
            beta[s] += x
            for k in [name] if isinstance(name, str) else [f"<0x{b:02X}>" for b in name]:
                into[k] = into.get(k, 0.0) + alpha[s] * x
        return True


def with_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, text, block): documents of one stretch of a file share a block; other inputs are written first."""
    try:
        meta = docs.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"), F.col("_metadata.file_block_length").alias("_l"))
    except AnalysisException:
        return with_blocks(materialise(id_text(docs)))
    part = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("_l") / BLOCK))
    return meta.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("_f", "_s", part).alias("block"))


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size) + np.repeat(start, size)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at])))


def block_words(docs: DataFrame) -> DataFrame:
    """(block, word_hash, word, n): distinct words, joined up within batches, with their count in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end_hash = RangeHash(np.frombuffer(END.encode(), np.uint8))(np.array([0]), np.array([1]))
        for batch in batches:
            block_id = np.array(batch.column(2).to_numpy())
            train = np.array([not held_out(d) for d in batch.column(0).to_pylist()], bool)
            for block in blocks(batch.column(1), 8 << 20):
                data = LOWER[block.data]
                s, e, first = block.words(SPACED, True)
                h = RangeHash(data)(s, e)
                doc = np.repeat(np.arange(block.n), np.diff(first)) + block.first
                order = np.lexsort((h, block_id[doc]))
                h2, b2 = h[order], block_id[doc][order]
                edge = np.ones(len(order), bool)
                edge[1:] = (h2[1:] != h2[:-1]) | (b2[1:] != b2[:-1])
                at = np.flatnonzero(edge)
                n = np.add.reduceat(train[doc][order].astype(np.int64), at) if len(at) else at
                first_of = order[at]
                yield pa.RecordBatch.from_arrays([pa.array(b2[at]), pa.array(h2[at].view(np.int64)), _strings(data, s[first_of], e[first_of]), pa.array(n)], names=["block", "word_hash", "word", "n"])
                own, which = block_id[block.first : block.first + block.n], train[block.first : block.first + block.n]
                ids, inverse = np.unique(own, return_inverse=True)
                ends = np.bincount(inverse, weights=which, minlength=len(ids)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.repeat(end_hash, len(ids)).view(np.int64)), pa.array([END] * len(ids), pa.string()), pa.array(ends)], names=["block", "word_hash", "word", "n"])

    return docs.mapInArrow(run, "block long, word_hash long, word string, n long")


def expected_counts(words: DataFrame, weights) -> dict[str, float]:
    """Expected uses of each piece over all training words; as many rows as the vocabulary has pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, into = Lattice(weights.value), {}
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lattice.expect(MARK + word, n, into)
        yield pa.RecordBatch.from_arrays([pa.array(list(into), pa.string()), pa.array(list(into.values()), pa.float64())], names=["piece", "uses"])

    rows = words.filter((F.col("n") > 0) & (F.col("word") != END)).select("word", "n").mapInArrow(run, "piece string, uses double")
    return {r.piece: r.uses for r in rows.groupBy("piece").agg(F.sum("uses").alias("uses")).collect()}


def score(docs: DataFrame, model: str, rounds: int = 1) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    spark = docs.sparkSession
    docs = with_blocks(docs)
    held = materialise(block_words(docs))
    words = materialise(held.groupBy("word_hash", "word").agg(F.sum("n").alias("n")))
    total = words.agg(F.sum("n").alias("n"), F.sum((F.col("n") > 0).cast("long")).alias("v"), F.sum(F.when(F.col("word") == END, F.col("n"))).alias("ends")).first()
    n, v, ends = total.n or 0, total.v or 0, total.ends or 0
    start = start_weights(vocabulary(model))
    weights = spark.sparkContext.broadcast(start)  # as many as the vocabulary has pieces
    for _ in range(rounds):
        uses = expected_counts(words, weights)
        every = math.log(sum(uses.values()) + PRIOR + ends + 1)
        weights = spark.sparkContext.broadcast({p: math.log(uses.get(p, 0.0) + PRIOR * math.exp(w)) - every for p, w in start.items()})
        end = math.log(ends + 1) - every
    if not rounds:
        end = math.log(0.01)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(weights.value)
        for batch in batches:
            s = [end if w == END else lattice.forward(MARK + w) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s, pa.float64())], names=["word_hash", "n", "ln"])

    rated = words.mapInArrow(rate, "word_hash long, n long, ln double")
    needed = held.select("block", "word_hash").distinct().join(rated.hint("merge"), "word_hash").select("block", "word_hash", "n", "ln")

    def finish(texts: pa.Table, known: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        h = np.array(known.column("word_hash").to_numpy()).view(np.uint64)
        order = np.argsort(h)
        h, c, ln = h[order], known.column("n").to_numpy()[order], known.column("ln").to_numpy()[order]
        base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        e = np.searchsorted(h, RangeHash(np.frombuffer(END.encode(), np.uint8))(np.array([0]), np.array([1])))[0]
        out = []
        column = texts.column("text")
        for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
            for block in blocks(chunk):
                s, t, first = block.words(SPACED, True)
                k = np.searchsorted(h, RangeHash(LOWER[block.data])(s, t))
                doc = np.repeat(np.arange(block.n), np.diff(first))
                per = lambda x: np.bincount(doc, weights=x[k], minlength=block.n)
                out.append((np.diff(first) + 1, per((c > 0).astype(float)) + (c[e] > 0), per(base) + base[e], (per(ln) + ln[e]) / math.log(10)))
        tokens, seen, b, x = (np.concatenate(y) for y in zip(*out))
        ids = texts.column("doc_id")
        columns = [ids, pa.array([held_out(d) for d in ids.to_pylist()]), pa.array(tokens), pa.array(seen.astype(np.int64)), pa.array(np.full(len(tokens), n)), pa.array(b), pa.array(x)]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(finish, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
