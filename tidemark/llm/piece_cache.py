"""Token ids of repeated byte strings: every distinct string of a slice is encoded once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

MAX_ENTRIES = 1 << 20
ENCODE_AT_ONCE = 1 << 14


class PieceCache:
    """Fingerprint -> token ids, kept in four flat arrays.

    ``encode`` maps a list of byte strings to a list of id sequences. When the cache passes
    ``max_entries`` it starts anew with the strings of the current slice: the bound limits
    memory and costs repeated work, never a result.
    """

    def __init__(self, encode: Callable, dtype=np.uint16, max_entries: int = MAX_ENTRIES):
        self.encode, self.dtype, self.max_entries = encode, dtype, max_entries
        self.clear()

    def clear(self):
        self.keys = np.empty(0, np.uint64)
        self.start = np.empty(0, np.int64)  # where the ids of a key lie in ``flat``, and how many
        self.size = np.empty(0, np.int64)
        self.flat = np.empty(0, self.dtype)

    def _encoded(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per string) of byte ranges, few of them as Python objects at a time."""
        flat, sizes = [], []
        for lo in range(0, start.size, ENCODE_AT_ONCE):
            part = slice(lo, lo + ENCODE_AT_ONCE)
            got = self.encode([data[a:b].tobytes() for a, b in zip(start[part].tolist(), end[part].tolist())])
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            flat.append(np.fromiter((i for ids in got for i in ids), self.dtype, int(sizes[-1].sum())))
        return np.concatenate(flat), np.concatenate(sizes)

    def _known(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        at[at == self.keys.size] = 0
        return self.keys[at] == keys if self.keys.size else np.zeros(keys.size, bool)

    def _distinct(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys in order, where one of each is, which of them every key is)."""
        return np.unique(keys, return_index=True, return_inverse=True)

    def ids(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        """(flat ids, bounds) of the byte ranges, in order; ``keys`` are their fingerprints."""
        unique, example, inverse = self._distinct(keys)
        if self.keys.size > self.max_entries:
            self.clear()
        fresh = np.flatnonzero(~self._known(unique))
        if fresh.size:
            at = example[fresh]
            flat, sizes = self._encoded(data, start[at], end[at])
            behind = self.flat.size + np.cumsum(sizes) - sizes
            keys_all = np.concatenate((self.keys, unique[fresh]))
            order = np.argsort(keys_all, kind="stable")
            self.keys = keys_all[order]
            self.start = np.concatenate((self.start, behind))[order]
            self.size = np.concatenate((self.size, sizes))[order]
            self.flat = np.concatenate((self.flat, flat))
        pick = np.searchsorted(self.keys, unique)[inverse]
        bounds = np.concatenate(([0], np.cumsum(self.size[pick])))
        at = np.arange(bounds[-1]) + np.repeat(self.start[pick] - bounds[:-1], self.size[pick])
        return self.flat[at], bounds
