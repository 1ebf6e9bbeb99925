"""Words and hashes of whole Arrow batches of texts, by numpy over UTF-8 bytes.

Both word classes used by the operators exclude only ASCII characters, and every byte of a multi-byte UTF-8
character is above 0x7F, so splitting by bytes gives the same words as splitting by code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 2 << 20  #: bytes of text worked on at once; a longer document is a block of its own

_byte = np.arange(256)
#: `[^\x20\x09-\x0D]`
SPACED = ~((_byte == 0x20) | ((_byte >= 0x09) & (_byte <= 0x0D)))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after A-Z became a-z
ALNUM = ((_byte >= 0x30) & (_byte <= 0x39)) | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80)
LOWER = np.where((_byte >= 0x41) & (_byte <= 0x5A), _byte + 32, _byte).astype(np.uint8)

_U = np.uint64
_PRIME = (1 << 61) - 1
_BASE = 0x1B1CE4E5B9133111 % _PRIME
_INV = pow(_BASE, -1, _PRIME)
_P, _LOW31, _LOW30 = _U(_PRIME), _U((1 << 31) - 1), _U((1 << 30) - 1)
_CARRY = 1 << 20  #: bytes whose products are summed before they are reduced
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _U(61))
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2^61 - 1, by halves of 31 bits."""
    a1, a0, b1, b0 = a >> _U(31), a & _LOW31, b >> _U(31), b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _reduce(_U(2) * a1 * b1 + (middle >> _U(30)) + ((middle & _LOW30) << _U(31)) + a0 * b0)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    for k, base in enumerate((_BASE, _INV)):
        while len(_powers[k]) < n:
            size = len(_powers[k])
            _powers[k] = np.concatenate([_powers[k], _times(_powers[k], np.full(1, _U(pow(base, size, _PRIME))))])
    return _powers[0][:n], _powers[1][:n]


class RangeHash:
    """Hashes of any byte ranges of one block: polynomials modulo the prime 2^61 - 1.

    Different strings of n bytes collide for at most n of the 2^61 bases; unlike modulo 2^64, no structure of a text
    (such as a Thue-Morse word and its complement) collides whatever the base.
    """

    def __init__(self, data: np.ndarray):
        up, _ = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        for k in range(0, len(data), _CARRY):
            value, own = data[k : k + _CARRY].astype(np.uint64) + _U(1), up[k : min(k + _CARRY, len(data))]
            low, high = np.cumsum(value * (own & _LOW31)), np.cumsum(value * (own >> _U(31)))
            # high * 2^31: its upper bits wrap around at 2^61
            whole = (high >> _U(30)) + ((high & _LOW30) << _U(31)) + low + self.sums[k]
            self.sums[k + 1 : k + 1 + len(value)] = _reduce(whole)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = _power(len(self.sums))
        own = self.sums[end] + (_P - self.sums[start])
        return mix(_times(_reduce(own), down[start]) + (np.asarray(end) - np.asarray(start)).astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def same_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes of ``a`` from ``at`` are those of ``b`` from ``bt``."""
    same, left, k = np.ones(len(size), bool), np.flatnonzero(size > 0), 0
    while len(left):
        equal = a[at[left] + k] == b[bt[left] + k]
        same[left[~equal]] = False
        k += 1
        left = left[equal & (size[left] > k)]
    return same


class Block:
    """Some consecutive documents of a batch: ``data`` their bytes, ``at`` where each starts (and the end)."""

    def __init__(self, first: int, data: np.ndarray, at: np.ndarray):
        self.first, self.data, self.at, self.n = first, data, at, len(at) - 1

    def words(self, kind: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all words, and how many words precede each document (with the end)."""
        data = LOWER[self.data] if lower else self.data
        inside = kind[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.at] = True
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.at)


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    """``texts`` (null: empty) as blocks of about ``limit`` bytes."""
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield Block(i, data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each of the consecutive ranges that ``bounds`` limits."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[bounds[1:]] - c[bounds[:-1]]
