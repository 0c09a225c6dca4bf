"""Words of whole texts as numpy arrays, computed for a slice of an Arrow column at once.

A word is a maximal run of bytes outside space and 0x09-0x0D of the UTF-8 text. Every word gets
a 64-bit fingerprint, so counting, shingling and comparing never touch Python strings. A null
text counts as empty. Slices hold whole texts only: a text longer than a slice is a slice alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (shift-multiply finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


SHORT = 32
_SIZE = np.uint64(0xD1342543DE82EF95)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Texts(NamedTuple):
    """Concatenated UTF-8 bytes of texts; text i is ``data[bounds[i]:bounds[i + 1]]``."""

    data: np.ndarray
    bounds: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, texts) for runs of rows of about ``limit`` bytes, without a copy."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(bounds, bounds[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, Texts(raw[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
        lo = hi


class Words(NamedTuple):
    """Byte start and end, text number and fingerprint of every word; ``first`` per text."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def split(texts: Texts) -> Words:
    data, bounds = texts
    n = data.size
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = after[-1] = True
        np.logical_or(~inside[:-1], edge[1:n], out=before[1:])
        np.logical_or(~inside[1:], edge[1:n], out=after[:-1])
    start = np.flatnonzero(inside & before)
    end = np.flatnonzero(inside & after) + 1
    first = np.searchsorted(start, bounds)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Words(start, end, doc, first)


class Hasher:
    """64-bit fingerprints of byte ranges of one slice.

    Up to ``SHORT`` bytes, blocks of eight are mixed in one after the other, all ranges at once;
    longer ranges are digested one by one. Ranges of one length up to eight bytes never share a
    fingerprint, any other two by chance only (2^-64 a pair).
    """

    def __init__(self, data: np.ndarray, fold_case: bool):
        padded = np.zeros(data.size + 8, np.uint8)
        padded[: data.size] = LOWER[data] if fold_case else data
        self.data = padded
        self.blocks = np.ndarray((data.size + 1,), "<u8", padded, strides=(1,))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        out = size.astype(np.uint64) * _SIZE
        live, at, left = slice(None), start, size
        for _ in range(0, SHORT, 8):
            out[live] = mix(out[live] ^ (self.blocks[at] & _MASK[np.minimum(left, 8)]))
            more = np.flatnonzero(left > 8)
            if not more.size:
                return out
            live = more if isinstance(live, slice) else live[more]
            at, left = at[more] + 8, left[more] - 8
        for i in live.tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.data[start[i] : end[i]], digest_size=8).digest(), "little")
        return out


def windows(word_hash: np.ndarray, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, index of the first word) of every run of ``size`` words inside a text."""
    n = word_hash.size - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.zeros(n, np.uint64)
    factor = 1
    for j in range(size):
        factor = factor * _BASE % (1 << 64)
        total += word_hash[j : j + n] * np.uint64(factor)
    at = np.flatnonzero(words.doc[:n] == words.doc[size - 1 :])
    return mix(total[at]), at


def gather(flat: np.ndarray, first: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the ragged rows ``pick`` of (flat, first): (values, bounds of the rows)."""
    sizes = (first[1:] - first[:-1])[pick]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(bounds[-1]) + np.repeat(first[:-1][pick] - bounds[:-1], sizes)
    return flat[at], bounds


def nonempty_rows(first: np.ndarray) -> np.ndarray:
    return np.flatnonzero(first[1:] > first[:-1])
