"""Words, hashes and windows over the UTF-8 bytes of Arrow string columns, vectorised over many documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Words longer than this are hashed one by one.
LONG_WORD = 4096


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x + U(salt)) * _A
    x ^= x >> U(30)
    x *= _B
    x ^= x >> U(27)
    x *= _C
    x ^= x >> U(31)
    return x


def byte_class(separators: bytes) -> np.ndarray:
    keep = np.ones(256, bool)
    keep[list(separators)] = False
    return keep


SPACED = byte_class(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Letters and digits of ASCII and all beyond ASCII, after lower-casing.
ALNUM = byte_class(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """Words of rows lo..hi of a batch; word i has bytes data[start[i]:end[i]]; row r has words first[r]..first[r+1]."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        length = (self.end - self.start).astype(np.int64)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        h = length.astype(U) * _B
        at, todo = 0, np.arange(len(length))
        while len(todo):
            left = np.minimum(length[todo] - at, 8).astype(U)
            part = eight[self.start[todo] + at] & (~U(0) >> (U(64) - U(8) * left))
            h[todo] = mixed(h[todo] ^ part)
            at += 8
            todo = todo[(length[todo] > at) & (length[todo] <= LONG_WORD)]
        for i in np.flatnonzero(length > LONG_WORD):
            h[i] = int.from_bytes(hashlib.blake2b(self.data[self.start[i] : self.end[i]].tobytes(), digest_size=8).digest(), "little")
        return h


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words, also of those that cross rows (callers slice by row)."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out = h[:n].copy()
    for j in range(1, k):
        out = mixed(out * _C + h[j : j + n])
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null rows are empty."""
    if pa.types.is_string_view(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes; one longer row is a run of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def words(column: pa.Array, keep: np.ndarray, lower: bool, most: int = 3 << 20) -> Iterator[Words]:
    data, offsets = buffers(column)
    for lo, hi in slices(offsets, most):
        own = data[offsets[lo] : offsets[hi]]
        at = offsets[lo : hi + 1] - offsets[lo]
        own = LOWER[own] if lower else own
        word = keep[own]
        n = len(own)
        before = np.empty(n, bool)
        before[1:] = word[:-1]
        begins = at[:-1][at[:-1] < n]
        before[begins] = False
        if n:
            before[0] = False
        start = np.flatnonzero(word & ~before)
        after = np.empty(n, bool)
        if n:
            after[:-1] = word[1:]
            after[-1] = False
        ends = at[1:][(at[1:] < n) & (at[1:] > 0)] - 1
        after[ends] = False
        end = np.flatnonzero(word & ~after) + 1
        yield Words(lo, hi, own, at, start, end, np.searchsorted(start, at))
