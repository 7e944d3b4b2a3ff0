"""A worker's growing table of distinct strings and their token ids, for encoding whole blocks by gathers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Interned:
    """Entries with token ids by 64-bit key; entry 0 has none. `encode` maps new byte strings to all their ids in a row
    and the number of ids of each. Keys are found by open addressing, whole arrays at a time."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 1_000_000):
        self._encode, self._most = encode, most
        self.clear()

    def clear(self) -> None:
        self._key, self._entry = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)
        self._ids, self._used = np.zeros(1 << 16, np.uint32), 0
        self._begin, self._n = np.zeros(1 << 14, np.int64), 1

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, 0 for those not there."""
        mask = np.uint64(len(self._key) - 1)
        out = np.zeros(len(keys), np.int32)
        left, slot = np.arange(len(keys)), keys & mask
        while len(left):
            have = self._key[slot]
            hit = have == keys[left]
            out[left[hit]] = self._entry[slot[hit]]
            on = ~hit & (have != 0)
            left, slot = left[on], (slot[on] + np.uint64(1)) & mask
        return out

    def _file(self, keys: np.ndarray, entries: np.ndarray) -> None:
        mask = np.uint64(len(self._key) - 1)
        left, slot = np.arange(len(keys)), keys & mask
        while len(left):
            free = self._key[slot] == 0
            self._key[slot[free]], self._entry[slot[free]] = keys[left[free]], entries[left[free]]  # of several, the last has it
            on = self._key[slot] != keys[left]
            left, slot = left[on], (slot[on] + np.uint64(1)) & mask

    def _add(self, keys: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        total = int(lengths.sum())
        while self._used + total > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        while self._n + len(keys) + 1 > len(self._begin):
            self._begin = np.concatenate([self._begin, np.zeros_like(self._begin)])
        self._ids[self._used : self._used + total] = ids
        self._begin[self._n + 1 : self._n + 1 + len(keys)] = self._used + np.cumsum(lengths)
        if 2 * (self._n + len(keys)) > len(self._key):
            old, entry = self._key, self._entry
            size = len(old)
            while 2 * (self._n + len(keys)) > size:
                size *= 2
            self._key, self._entry = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._file(old[old != 0], entry[old != 0])
        self._file(keys, np.arange(self._n, self._n + len(keys), dtype=np.int32))
        self._n, self._used = self._n + len(keys), self._used + total

    def room(self) -> None:
        """Forgets everything once there are too many entries; called between blocks."""
        if self._n > self._most:
            self.clear()

    def entries(self, keys: np.ndarray, string: Callable[[int], bytes]) -> np.ndarray:
        """The entry of each key; string(i) gives the bytes of keys[i], asked for keys not seen before only."""
        keys = np.where(keys == 0, np.uint64(1), keys)
        out = self._find(keys)
        missing = np.flatnonzero(out == 0)
        if len(missing):
            new, first = np.unique(keys[missing], return_index=True)
            self._add(new, *self._encode([string(i) for i in missing[first].tolist()]))
            out[missing] = self._find(keys[missing])
        return out

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the entries in a row, and each entry's number of ids."""
        begin = self._begin[entries]
        lengths = self._begin[entries + 1] - begin
        total = np.cumsum(lengths)
        at = np.arange(total[-1] if len(total) else 0) + np.repeat(begin - total + lengths, lengths)
        return self._ids[at], lengths
