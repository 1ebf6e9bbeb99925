"""Quantised vectors: 8-bit float, sign bits, and product codes, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def float8(x: np.ndarray) -> np.ndarray:
    """Values of an 8-bit float with 4 exponent and 3 mantissa bits, nearest, at most 448."""
    a = np.minimum(np.abs(x), 448.0)
    step = np.exp2(np.maximum(np.floor(np.log2(np.maximum(a, 1e-30))), -6) - 3)
    return np.sign(x) * np.round(a / step) * step


def sign_bits(x: np.ndarray) -> np.ndarray:
    """One bit per component; values come back as the row's mean magnitude."""
    return np.where(x >= 0, 1.0, -1.0) * np.abs(x).mean(1, keepdims=True)


def product_codes(x: np.ndarray, parts: int = 8, levels: int = 16) -> np.ndarray:
    """Each part of a vector by the nearest of ``levels`` fixed directions at one of 16 lengths."""
    n, dim = x.shape
    width = dim // parts
    angle = np.arange(levels)[:, None] * (np.arange(width)[None] + 1) * 2.399963
    book = np.cos(angle)
    book /= np.linalg.norm(book, axis=1, keepdims=True)
    out = np.empty_like(x)
    for p in range(parts):
        own = x[:, p * width : (p + 1) * width]
        fit = own @ book.T
        best = np.abs(fit).argmax(1)
        size = fit[np.arange(n), best]
        step = np.maximum(np.linalg.norm(x, axis=1), 1e-12) / 8
        out[:, p * width : (p + 1) * width] = book[best] * (np.round(size / step) * step)[:, None]
    return out


def errors(vectors: DataFrame, column: str) -> DataFrame:
    """(memory_id, float8, binary, product): root mean square errors relative to the vector's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b[column].to_numpy())
            size = np.maximum(np.linalg.norm(x, axis=1), 1e-12)
            kinds = {"float8": float8, "binary": sign_bits, "product": product_codes}
            yield pd.DataFrame({"memory_id": b["memory_id"]} | {k: np.round(np.linalg.norm(x - f(x), axis=1) / size, 6) for k, f in kinds.items()})

    return vectors.select("memory_id", column).mapInPandas(run, "memory_id long, float8 double, binary double, product double")
