"""Words of many texts at once: byte tables find the borders, polynomial sums give 64-bit fingerprints.

Word separators are ASCII in every contract, so UTF-8 bytes can be classed one by one.  A fingerprint is
``sum(t[byte] * M**i) mod 2**64`` over the bytes of a word, taken as a difference of running sums, and
then mixed; the same sum over word fingerprints gives fingerprints of word windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import raw_bytes

_M = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_M, -1, 1 << 64)
_SEGMENT = 1 << 17
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` mod 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        if len(have) <= 4 * _SEGMENT:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_M))

#: ``[^\x20\x09-\x0D]+``
BLANK_WORDS = np.ones(256, bool)
BLANK_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
PLAIN_WORDS = np.zeros(256, bool)
PLAIN_WORDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 32


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    rows: np.ndarray  # where each text begins in data, and the end of the last
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    hash: np.ndarray  # uint64
    first: np.ndarray  # index of the first word of each text, and the number of words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def text(self, i: int) -> str:
        return self.data[self.start[i]:self.end[i]].tobytes().decode()

    def joined(self, lo: int, hi: int, keep: np.ndarray | None = None) -> bytes:
        """Words lo..hi-1 (those marked in ``keep``) joined by one blank."""
        picked = range(lo, hi) if keep is None else (np.flatnonzero(keep[lo:hi]) + lo).tolist()
        view, s, e = self.data[self.start[lo]:self.end[hi - 1]].tobytes() if hi > lo else b"", self.start, self.end
        base = int(s[lo]) if hi > lo else 0
        return b" ".join(view[int(s[i]) - base:int(e[i]) - base] for i in picked)


def joined_texts(w: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The words of every text (those marked in ``keep``) joined by one blank: all bytes, and where each text begins
    and the last ends."""
    data, bytes_kept = w.data.copy(), np.zeros(len(w.data) + 1, np.int8)
    words = np.arange(len(w.start)) if keep is None else np.flatnonzero(keep)
    np.add.at(bytes_kept, w.start[words], 1)
    np.add.at(bytes_kept, w.end[words], -1)
    kept = np.cumsum(bytes_kept[:-1], dtype=np.int8).astype(bool)
    text = np.searchsorted(w.first, words, "right")
    blank = w.end[words[:-1][text[:-1] == text[1:]]]  # a word that another follows ends at a blank
    kept[blank] = True
    data[blank] = 0x20
    total = np.concatenate([[0], np.cumsum(kept)])
    return data[kept], total[w.rows]


def spans_of(data: np.ndarray, rows: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of member bytes; runs end where a text ends."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = member[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    inner = rows[(rows > 0) & (rows < len(data))]
    before[inner] = False
    after[inner - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def fingerprints(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit fingerprint of each byte span; spans ascend and do not overlap."""
    out = np.empty(len(start), np.uint64)
    values = _BYTE[_LOWER] if lower else _BYTE
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + _SEGMENT, "right")))
        a, b = int(start[lo]), int(end[hi - 1])
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(values[data[a:b]] * _power(_M, b - a), out=total[1:])
        s, e = start[lo:hi] - a, end[lo:hi] - a
        out[lo:hi] = mix((total[e] - total[s]) * _power(_INVERSE, b - a)[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


def find_words(column, member: np.ndarray = BLANK_WORDS, lower: bool = False) -> Words:
    data, rows = raw_bytes(column)
    start, end = spans_of(data, rows, member)
    return Words(data, rows, start, end, fingerprints(data, start, end, lower), np.searchsorted(start, rows))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all n consecutive entries; entry i begins at i, the last n-1 do not exist.
    Windows that cross texts are computed too: select them with ``window_starts``."""
    count = len(h) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(count, np.uint64)
    for lo in range(0, count, _SEGMENT):
        hi = min(count, lo + _SEGMENT)
        part = h[lo:hi + n - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _power(_M, len(part)), out=total[1:])
        out[lo:hi] = mix((total[n:] - total[:-n]) * _power(_INVERSE, len(part))[:hi - lo])
    return out


def window_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Marks of the word positions at which a window of n words of one text begins."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(first[-1])
    return left >= n


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values, by doubling."""
    out, have = values, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Marks of the words inside any window of n words that begins at ``starts``."""
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0
