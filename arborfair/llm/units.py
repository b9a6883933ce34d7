"""Distinct pieces of text and a bounded memory of what is known about them.

Tokenizers work on pieces of text that do not depend on what surrounds them.  A task looks at each distinct piece
once: ``Memo`` maps fingerprints to numbers, ``Ragged`` holds a list of integers per number.  Both are kept by a
Python worker from task to task and emptied when full, so memory is bounded and results do not depend on them.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from .common import raw_bytes
from .words import fingerprints


def unassigned(text: str) -> bool:
    """Whether a text has characters that Python's Unicode tables do not assign: libraries of other Unicode
    versions may take them for letters, or change their case."""
    return not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text))


class Memo:
    """An open-addressing table from 64-bit fingerprints to numbers, probed for whole arrays at once."""

    def __init__(self, capacity: int = 1 << 20):
        self.capacity, self.size = capacity, 0
        self._mask = np.uint64(4 * capacity - 1)
        self._keys = np.zeros(4 * capacity, np.uint64)
        self._numbers = np.zeros(4 * capacity, np.int32)

    def clear(self) -> None:
        self._keys[:] = 0
        self.size = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each fingerprint, or -1."""
        h = np.maximum(h, np.uint64(1))
        out = np.full(len(h), -1, np.int32)
        left, slot = np.arange(len(h)), h & self._mask
        while len(left):
            key = self._keys[slot]
            same = key == h[left]
            out[left[same]] = self._numbers[slot[same]]
            going = ~same & (key != 0)
            left, slot = left[going], (slot[going] + np.uint64(1)) & self._mask
        return out

    def add(self, h: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct fingerprints that are not yet known."""
        h = np.maximum(h, np.uint64(1))
        left, slot = np.arange(len(h)), h & self._mask
        while len(left):
            free = self._keys[slot] == 0
            self._keys[slot[free]] = h[left[free]]
            won = free & (self._keys[slot] == h[left])
            self._numbers[slot[won]] = numbers[left[won]]
            left, slot = left[~won], (slot[~won] + np.uint64(1)) & self._mask
        self.size += len(h)


class Ragged:
    """Lists of integers in one growing array."""

    def __init__(self, kind=np.int32):
        self._flat, self._used, self._ends, self._count = np.empty(1 << 16, kind), 0, np.zeros(1 << 12, np.int64), 0

    def clear(self) -> None:
        self._used = self._count = 0

    def __len__(self) -> int:
        return self._count

    def extend(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self._flat = _room(self._flat, self._used + len(flat))
        self._flat[self._used:self._used + len(flat)] = flat
        self._ends = _room(self._ends, self._count + len(lengths) + 1)
        self._ends[self._count + 1:self._count + len(lengths) + 1] = self._used + np.cumsum(lengths)
        self._ends[0] = 0
        self._used += len(flat)
        self._count += len(lengths)

    def lengths(self, numbers: np.ndarray) -> np.ndarray:
        return self._ends[numbers + 1] - self._ends[numbers]

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """The lists of ``numbers``, one after another."""
        n = self.lengths(numbers)
        return self._flat[np.repeat(self._ends[numbers] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _room(a: np.ndarray, need: int) -> np.ndarray:
    if need <= len(a):
        return a
    out = np.empty(max(need, 2 * len(a)), a.dtype)
    out[:len(a)] = a
    return out


def split_units(column, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut texts wherever a blank follows another byte: each unit is a run of blanks and what comes up to the next.

    Returns the bytes, the start and end of every unit, and the first unit of each text (and the number of units)."""
    data, rows = raw_bytes(column)
    if not len(data):
        return data, np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(rows), np.int64)
    is_blank = blank[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = is_blank[1:] & ~is_blank[:-1]
    cut[rows[:-1][np.diff(rows) > 0]] = True
    start = np.flatnonzero(cut)
    return data, start, np.append(start[1:], len(data)), np.searchsorted(start, rows)


class UnitCoder:
    """Lists of integers for the units of texts; ``encode(units)`` is asked once for each distinct unit."""

    def __init__(self, encode, blank: np.ndarray, capacity: int = 1 << 20, kind=np.int32):
        self._encode, self._blank = encode, blank
        self._memo, self._lists = Memo(capacity), Ragged(kind)

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A list number for each span of bytes."""
        h, first, back = np.unique(fingerprints(data, start, end), return_index=True, return_inverse=True)
        if self._memo.size + len(h) > self._memo.capacity:
            self._memo.clear()
            self._lists.clear()
        number = self._memo.find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            at = first[new]
            view = data.tobytes() if len(new) > 64 else None
            spans = zip(start[at].tolist(), end[at].tolist())
            units = [(view[a:b] if view is not None else data[a:b].tobytes()).decode() for a, b in spans]
            flat, lengths = self._encode(units)
            number[new] = len(self._lists) + np.arange(len(new))
            self._lists.extend(flat, lengths)
            if self._memo.size + len(new) <= 2 * self._memo.capacity:
                self._memo.add(h[new], number[new])
        return number[back]

    def code(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The integers of all texts in one array, and where each text begins (and the last ends)."""
        data, start, end, first = split_units(column, self._blank)
        number = self.numbers(data, start, end)
        total = np.concatenate([[0], np.cumsum(self._lists.lengths(number))])
        return self._lists.gather(number), total[first]
