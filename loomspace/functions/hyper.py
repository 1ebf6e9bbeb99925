"""Hyperdimensional text codes: 10,000 bits from character trigrams by binding (xor), permutation (rotation) and majority."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

BITS = 10_000  # fixed value


@lru_cache(4096)
def symbol(c: str) -> np.ndarray:
    return np.random.default_rng(zlib.crc32(c.encode())).integers(0, 2, BITS, dtype=np.uint8)


@lru_cache(8192)
def trigram(t: str) -> np.ndarray:
    out = np.zeros(BITS, np.uint8)
    for k, c in enumerate(t):
        out ^= np.roll(symbol(c), k)
    return out


def encode(texts: list[str]) -> list[bytes]:
    """The majority of all trigrams' codes, ties going to 0; a text of fewer characters is one symbol run."""
    grams = [np.unique([t[k : k + 3] for k in range(len(t) - 2)] or [t], return_counts=True) for t in map(str.lower, texts)]
    names = sorted({g for own, _ in grams for g in own.tolist()})
    at = {g: k for k, g in enumerate(names)}
    total, size = np.zeros((len(texts), BITS), np.float32), np.array([n.sum() for _, n in grams])
    for start in range(0, len(names), 1024):  # counts times codes, a block of trigrams at a time
        block = names[start : start + 1024]
        counts = np.zeros((len(texts), len(block)), np.float32)
        for i, (own, n) in enumerate(grams):
            k = np.array([at[g] for g in own.tolist()]) - start
            inside = (k >= 0) & (k < len(block))
            counts[i, k[inside]] = n[inside]
        total += counts @ np.stack([trigram(g) for g in block]).astype(np.float32)
    return [np.packbits(row).tobytes() for row in 2 * total > size[:, None]]


def coded(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, code) of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 256):
                part = b.iloc[k : k + 256]
                yield pd.DataFrame({key: part[key], "code": encode([x or "" for x in part[text]])})

    return docs.select(key, text).mapInPandas(run, f"{key} long, code binary")


@F.pandas_udf(DoubleType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    some = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    if some.any():
        x, y = (np.frombuffer(b"".join(c[some]), np.uint8).reshape(some.sum(), -1) for c in (a, b))
        out[some] = 1 - np.bitwise_count(x ^ y).sum(axis=1) / BITS
    return pd.Series(out).where(some, None)


def similarity(a: Column, b: Column) -> Column:
    """1 - hamming / bits of two codes, a batch at a time."""
    return _alike(a, b)
