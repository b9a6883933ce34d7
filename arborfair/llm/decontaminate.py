"""Benchmark decontamination: Wu-Manber search for item windows in every document.

Symbols are words.  Patterns of one length m share a SHIFT table over blocks of two words: a block that
no pattern contains lets the search jump m-1 words ahead, so most positions are never looked at.  Where
the shift is zero, the buckets of suffix and prefix blocks name the patterns to try, and each is compared
directly, word by word and then as text.  All documents of a piece advance together, one lane per 64 words.

The items are a stated query set.  They are packed into blocks of at most ``BLOCK_BYTES`` of text; each
block is broadcast and searched for in one pass over the documents, however many blocks there are.

Cases: a null or empty text (document or item) has no words and hits nothing; an item of fewer than
``window`` words is one window; repeated items count once; an item without id hits words but is not
listed; null document ids are passed through; an empty table of items leaves every document clean.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, free_name, keep, text_bytes
from .words import PLAIN_WORDS, Words, find_words, mix

#: Text of the items that are searched for in one pass over the documents.
BLOCK_BYTES = 2 << 20
_LANE = 64
_A = np.uint64(0x9E3779B97F4A7C15)


def _block(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the blocks of ``size`` words that begin at ``at``."""
    out = h[at]
    for i in range(1, size):
        out = out * _A + h[at + i]
    return mix(out)


@dataclass
class Patterns:
    """All distinct windows of one length, and the tables to search for them."""

    length: int
    words: np.ndarray  # fingerprints, one row per pattern, ordered by key
    texts: list[bytes]
    items: list[list[int]]  # ids of the items that contain the pattern
    key: np.ndarray  # suffix block and prefix block, ascending
    shift: np.ndarray

    @classmethod
    def build(cls, length: int, found: dict[bytes, tuple[np.ndarray, set]]) -> "Patterns":
        texts = list(found)
        words = np.stack([found[t][0] for t in texts])
        size, flat = min(2, length), words.reshape(-1)
        at = np.arange(len(texts)) * length
        # About four slots per block of words, one byte each (a shift is below the window's length).
        bits = max(12, math.ceil(math.log2(len(texts) * length + 1)) + 2)
        shift = np.full(1 << bits, length - size + 1, np.uint8 if length < 256 else np.int64)
        for j in range(length - size + 1):
            slots = _block(flat, at + j, size) & np.uint64(len(shift) - 1)
            np.minimum.at(shift, slots.astype(np.int64), length - size - j)
        key = _block(flat, at + length - size, size) * _A + _block(flat, at, size)
        order = np.argsort(key, kind="stable")
        return cls(length, words[order], [texts[i] for i in order],
                   [sorted(x for x in found[texts[i]][1] if x is not None) for i in order], key[order], shift)

    def search(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Word positions and pattern numbers of all occurrences."""
        m, h = self.length, w.hash
        size = min(2, m)
        last = w.first[1:] - m + 1  # one past the last start, per text
        spans = np.maximum(last - w.first[:-1], 0)
        lanes = -(-spans // _LANE)
        row = np.repeat(np.arange(len(spans)), lanes)
        nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        pos = w.first[:-1][row] + nth * _LANE
        stop = np.minimum(pos + _LANE, last[row])
        tried = []
        while len(pos):
            block = _block(h, pos + m - size, size)
            step = self.shift[(block & np.uint64(len(self.shift) - 1)).astype(np.int64)].astype(np.int64)
            zero = step == 0
            if zero.any():
                tried.append((pos[zero], block[zero]))
            pos = pos + np.maximum(step, 1)
            going = pos < stop
            pos, stop = pos[going], stop[going]
        if not tried:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.concatenate([p for p, _ in tried])
        key = np.concatenate([b for _, b in tried]) * _A + _block(h, at, size)
        lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        at, number = np.repeat(at, hi - lo), _ranges(lo, hi)
        same = np.ones(len(at), bool)
        for j in range(m):
            same &= h[at + j] == self.words[number, j]
        at, number = at[same], number[same]
        real = [w.joined(p, p + m).lower() == self.texts[k] for p, k in zip(at.tolist(), number.tolist())]
        real = np.array(real, bool)
        return at[real], number[real]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    n = hi - lo
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def compile_items(rows: list[tuple[int | None, str | None]], window: int) -> list[Patterns]:
    by_length: dict[int, dict[bytes, tuple[np.ndarray, set]]] = {}
    w = find_words(pa.array([t for _, t in rows], pa.string()), PLAIN_WORDS, lower=True)
    for k, (item, _) in enumerate(rows):
        a, b = int(w.first[k]), int(w.first[k + 1])
        m = min(window, b - a)
        for i in range(a, b - m + 1 if m else a):
            text = w.joined(i, i + m).lower()
            by_length.setdefault(m, {}).setdefault(text, (w.hash[i:i + m], set()))[1].add(item)
    return [Patterns.build(m, found) for m, found in sorted(by_length.items())]


def _pass(docs: DataFrame, text: str, state: str, had: str | None, patterns: list[Patterns]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(patterns)

    def compute(piece):
        w = find_words(piece.column(docs_text), PLAIN_WORDS, lower=True)
        hit = np.zeros(w.first[-1], bool)
        found: list[set] = [set() for _ in range(piece.num_rows)]
        if had is not None:
            for k, old in enumerate(piece.column(had).to_pylist()):
                n = int(w.counts[k])
                hit[w.first[k]:w.first[k + 1]] = np.unpackbits(np.frombuffer(old["hits"], np.uint8), count=n).astype(bool)
                found[k].update(old["items"])
        for p in shared.value:
            at, number = p.search(w)
            for j in range(p.length):
                hit[at + j] = True
            rows = np.searchsorted(w.first, at, "right") - 1
            for r, k in zip(rows.tolist(), number.tolist()):
                found[r].update(p.items[k])
        total = np.concatenate([[0], np.cumsum(hit)])
        return [
            pa.array(w.counts, pa.int64()),
            pa.array(total[w.first[1:]] - total[w.first[:-1]], pa.int64()),
            pa.array([np.packbits(hit[a:b]).tobytes() for a, b in zip(w.first[:-1], w.first[1:])], pa.binary()),
            pa.array([sorted(x) for x in found], pa.list_(pa.int64())),
        ]

    docs_text = text
    out = attach(docs, state, "n_words long, n_hit long, hits binary, items array<bigint>", compute, text)
    return out.drop(had) if had else out


def mark_contaminated(docs: DataFrame, items: DataFrame, *, window: int = 10, text: str = "text",
                      item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
                      name: str | None = None) -> DataFrame:
    """``docs`` with a struct ``{n_words, n_hit, hits, items}``: words inside occurring windows (``hits`` is their
    bit map) and the ids of the items whose windows occur."""
    items = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("words"))
    blocks = max(1, math.ceil(text_bytes(items, "words") / block_bytes))
    where = F.pmod(F.xxhash64("words"), F.lit(blocks))
    had = None
    for b in range(blocks):
        rows = [(r["item"], r["words"]) for r in items.where(where == b).collect()]  # at most about block_bytes
        state = free_name(docs, name or "contamination")
        docs = _pass(docs, text, state, had, compile_items(rows, window))
        had = state
        if b + 1 < blocks:
            docs = keep(docs, "decontaminate")
    return docs.withColumnRenamed(had, name) if name else docs


def digest(marked: DataFrame, name: str = "contamination", doc_id: str = "doc_id") -> DataFrame:
    s = F.col(name)
    ids = F.array_sort(F.transform(s["items"], lambda x: x.cast("string")))
    return marked.select(
        F.col(doc_id), s["n_words"].alias("n_words"), s["n_hit"].alias("n_hit"),
        F.size(s["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (s["n_hit"] > 0).alias("contaminated"),
    )
