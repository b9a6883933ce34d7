"""Token counts by rank-synchronous merging.

Pre-tokens that a worker has not met are held together as ragged arrays of symbols.  In every round each sequence
finds the lowest rank among its adjacent pairs, and all sequences apply theirs at the same time; a sequence
without a known pair is done, and its surviving symbols are its tokens.  Merges of a trained vocabulary always
build on earlier ones, so all places of the lowest pair of a sequence can be merged in one round (left to right where
they overlap).

What is a letter depends on the Unicode version, so words with characters that Python's tables do not assign are counted by the
library itself.

Cases: a null or empty text has no tokens; special strings inside texts are one token each, as the library takes them by
default; null ids and repeated rows are passed through; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import attach, free_name
from .units import Memo, unassigned
from .words import BLANK_WORDS, find_words

FIELDS = "n_bytes long, n_tokens long, over_limit boolean"
_BLANKS = r"\t-\r\x85\p{Z}"


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte: itself if printable Latin-1, or one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(0x100 + i) for i, b in enumerate(others)}}


class PairMerger:
    """Byte-pair merges for batches of pre-tokens that end a word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"]["end_of_word_suffix"] or ""
        characters = byte_characters()
        self.inner = np.array([vocabulary[characters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocabulary[characters[b] + suffix] for b in range(256)], np.int64)
        self._width = max(vocabulary.values()) + 1
        pair = np.array([vocabulary[a] * self._width + vocabulary[b] for a, b in merges], np.int64)
        order = np.argsort(pair)
        self._pairs, self._ranks = pair[order], order
        self._made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        special = "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))
        self._special = regex.compile(f"({special})") if special else None
        self._split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + _BLANKS + r"\p{L}\p{N}]+")
        self._known: dict[str, int] = {}
        self._path, self._library = path, None

    def _library_count(self, text: str) -> int:
        self._library = self._library or Tokenizer.from_file(self._path)
        return len(self._library.encode(text, add_special_tokens=False).ids)

    def count(self, pretokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        raw = [p.encode() for p in pretokens]
        size = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbol, seq = self.inner[data], np.repeat(np.arange(len(raw)), size)
        end = np.cumsum(size)[size > 0] - 1
        symbol[end] = self.last[data[end]]
        out = np.zeros(len(raw), np.int64)
        while len(symbol):
            pair = symbol[:-1] * self._width + symbol[1:]
            at = np.minimum(np.searchsorted(self._pairs, pair), len(self._pairs) - 1)
            known = (self._pairs[at] == pair) & (seq[:-1] == seq[1:])
            rank = np.append(np.where(known, self._ranks[at], self._width), self._width)
            begin = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            best = np.minimum.reduceat(rank, begin)
            length = np.diff(np.append(begin, len(symbol)))
            done = best == self._width
            out[seq[begin[done]]] = length[done]
            # The places of each sequence's lowest pair; of adjacent ones (a a a) every second from the left.
            least = np.repeat(best, length)
            hit = (rank == least) & (least < self._width)
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(hit, -1, np.arange(len(hit))))
            hit &= run % 2 == 1
            where = np.flatnonzero(hit)
            symbol[where] = self._made[rank[where]]
            stay = np.repeat(~done, length)
            stay[where + 1] = False
            symbol, seq = symbol[stay], seq[stay]
        return out

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and how many tokens it has besides: special ones, and those of parts the library counts."""
        parts = self._special.split(text) if self._special and self._special.search(text) else [text]
        found: list[str] = []
        extra = len(parts) // 2
        for part in parts[::2]:
            if unassigned(part):
                extra += self._library_count(part)
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # a sigma has no special end form here
            found.extend(self._split.findall(part.lower()))
        return found, extra

    def count_texts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        cut = [self.pretokens(t) for t in texts]
        if len(self._known) > 300_000:
            self._known.clear()
        new = list({p for found, _ in cut for p in found if p not in self._known})
        self._known.update(zip(new, self.count(new).tolist()))
        return np.array([sum(map(self._known.__getitem__, found)) + extra for found, extra in cut], np.int64)


_workers: dict[str, tuple[PairMerger, Memo, list]] = {}


def count_column(column, path: str, capacity: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of each text.  Blanks part pre-tokens, so each distinct word is counted once per worker."""
    if path not in _workers:
        _workers[path] = PairMerger(path), Memo(capacity), [np.empty(0, np.int64)]
    merger, memo, held = _workers[path]
    w = find_words(column, BLANK_WORDS)
    h, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
    if memo.size + len(h) > capacity:
        memo.clear()
    number = memo.find(h)
    new = np.flatnonzero(number < 0)
    if len(new):
        view = w.data.tobytes()
        words = [view[a:b].decode() for a, b in zip(w.start[first[new]].tolist(), w.end[first[new]].tolist())]
        number[new] = np.minimum(merger.count_texts(words), np.iinfo(np.int32).max)
        if memo.size + len(new) <= 2 * capacity:
            memo.add(h[new], number[new])
    total = np.concatenate([[0], np.cumsum(number[back].astype(np.int64))])
    return np.diff(w.rows), total[w.first[1:]] - total[w.first[:-1]]


def count_tokens(docs: DataFrame, path: str, *, text: str = "text", limit: int = 2048, name: str | None = None) -> DataFrame:
    """``docs`` with a struct ``{n_bytes, n_tokens, over_limit}``; ``path`` is a tokenizer file on every machine."""
    def compute(piece):
        size, n = count_column(piece.column(text), path)
        return [pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)]

    return attach(docs, name or free_name(docs, "tokens"), FIELDS, compute, text)
