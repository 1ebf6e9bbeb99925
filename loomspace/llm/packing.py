"""Packing: shortest-pack-first over the length histogram.

Documents become token ids, are cut into pieces, and the pieces are packed into sequences of a fixed length. Only the
histogram of piece lengths (as many rows as a sequence has tokens) reaches the driver. There lengths are placed longest
first, each time onto the pack with the most room left, as counts of packing patterns and not piece by piece. The
patterns go back to the pieces by rank: the r-th piece of a length takes the r-th slot of that length.

Defined results: null or empty text is the single end id; a text of any length is cut at every ``length`` ids, the last
piece being the rest; repeated rows are packed like any others; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import id_text, materialise

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SHARES = 64  #: parts at least, in which the pieces of one length are ranked
SHARE = 100_000  #: pieces of a length in a part, about; the offsets table has a row a part


class Tokens:
    """Ids of texts. The rank file beside the vocabulary encodes faster and gives the same ids on Latin text; all
    other text, and text with a special token's string, goes through the tokenizer file itself."""

    def __init__(self, path: str):
        import base64
        import os
        import re

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.exact = Tokenizer.from_file(path)
        self.fast = None
        self.odd = re.compile("[^\x00-ɏ‐-‧]|<\\|endoftext\\|>|[\x1c-\x1f\x85\xa0]")
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast and len(text) < 1_000_000 and not self.odd.search(text):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, and with ``keep_ids`` the ids."""
    schema = PIECES + (", ids array<int>" if keep_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Tokens(tokenizer)
        for batch in batches:
            out: list[list] = [[] for _ in range(5 + keep_ids)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                for s in range(0, len(ids), length):
                    part = ids[s : s + length]
                    row = (doc, s, len(part), zlib.crc32(part.tobytes()), len(ids))
                    for o, v in zip(out, row + ((part.astype(np.int32),) if keep_ids else ())):
                        o.append(v)
            types = [pa.int64()] * 5 + [pa.list_(pa.int32())] * keep_ids
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types)], names=names[: 5 + keep_ids])

    return id_text(docs).mapInArrow(cut, schema)


def patterns(histogram: dict[int, int], length: int) -> list[tuple[list[int], int]]:
    """Packing patterns and their counts: lengths longest first, each on the pack with the most room that it fits."""
    room: dict[int, list[tuple[list[int], int]]] = defaultdict(list)  # by room left
    for size in sorted((k for k, v in histogram.items() if v), reverse=True):
        left, made = histogram[size], []
        for space in sorted((s for s in room if s >= size), reverse=True):
            while left and room[space]:
                pack, count = room[space].pop()
                taken = min(count, left)
                if count > taken:
                    room[space].append((pack, count - taken))
                made.append((space - size, [*pack, size], taken))
                left -= taken
            if not room[space]:
                del room[space]
            if not left:
                break
        # several pieces of this length may go on one pack
        made.sort(key=lambda m: m[0])
        while left:
            if made and made[-1][0] >= size:
                space, pack, count = made.pop()
                taken = min(count, left)
                if count > taken:
                    made.append((space, pack, count - taken))
                made.append((space - size, [*pack, size], taken))
                made.sort(key=lambda m: m[0])
                left -= taken
            else:
                fit = max(1, length // size)
                for n, count in ((fit, left // fit), (left % fit, 1)):
                    if n and count:
                        made.append((length - n * size, [size] * n, count))
                left = 0
        for space, pack, count in made:
            room[space].append((pack, count))
    return [x for space in sorted(room) for x in room[space]]


def slots(packs: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """Per length, runs of ranks in order: key (length << 40 | first rank), first sequence, offset in the sequence."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pack, count in packs:
        offset = 0
        for size in pack:
            rows.append((size << 40 | used[size], sequence, offset))
            used[size] += count
            offset += size
        sequence += count
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else tuple(np.zeros(0, np.int64) for _ in range(3))


def pack(cut: DataFrame, length: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ...), which are written once before."""
    spark = cut.sparkSession
    cut = materialise(cut)
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # as many rows as a sequence has tokens
    keys, sequence, offset = slots(patterns(histogram, length))
    shares = F.array(*(F.lit(max(SHARES, histogram.get(k, 0) // SHARE)) for k in range(length + 1)))
    share = F.pmod(F.xxhash64("doc_id", "start"), F.get(shares, F.col("length").cast("int")))
    counts = materialise(cut.groupBy("length", share.alias("share")).count())
    before = W.partitionBy("length").orderBy("share").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("length", "share", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(W.partitionBy("length", "share").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = cut.withColumn("share", share).withColumn("rank", rank)
    # at most length * SHARES rows, and one more for SHARE pieces
    ranked = ranked.join(F.broadcast(base), ["length", "share"]).withColumn("rank", F.col("rank") + F.col("base"))
    names = [c for c in cut.columns]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    shared = spark.sparkContext.broadcast((keys, sequence, offset))  # as many runs as patterns have slots

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequence, offset = shared.value
        for batch in batches:
            size, r = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            key = (size.astype(np.int64) << 40) | r.astype(np.int64)
            k = np.searchsorted(keys, key, "right") - 1
            own = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence[k] + key - keys[k]), pa.array(offset[k])], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Documents to packed pieces."""
    return pack(pieces(docs, tokenizer, length, end_id, keep_ids), length)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
