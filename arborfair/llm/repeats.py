"""Substring dedup with repeated-phrase automata.

A word goes if it lies in a window of 35 words whose word sequence also starts anywhere else.

1. *Anchors.*  The least fingerprint of the 8-word phrases of a window is its anchor; equal windows have equal
   anchors, and only one phrase in about 14 is one.  Anchors are counted over the corpus.
2. *Confirm.*  Windows with an anchor that occurs twice or more are counted by their own fingerprint; those found
   twice are recurring.  Counts are combined per slice of documents first, so a hot passage is one row per slice.
3. *Automata.*  Each slice learns which of its windows recur, cuts the recurring passages into tiles of 35
   words and compiles them into an Aho-Corasick automaton of its own: as large as the repeated text in one slice
   at most, and split further by vocabulary.  Words become single characters, so matches are aligned to words.
4. *Locate.*  All documents of the slice stream through its automaton; every occurrence marks its words.

Slices are dealt by text, so copies meet and count as one row, except copies of a text that together are larger than a
slice: those are dealt by document.

Cases: a null or empty text and one of fewer than 35 words lose nothing; repeated rows count as different places,
so rows that repeat a text of 35 words and more lose it entirely; null ids are passed through; an empty table gives
an empty result; other columns are kept, whatever their names.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import SLICE_BYTES, free_name, keep, pieces, text_bytes
from .words import BLANK_WORDS, Words, covered, find_words, sliding_min, window_hashes, window_starts

#: Words of a window, and of a phrase that can be an anchor.
WINDOW = 35
PHRASE = 8
#: Distinct words that the patterns of one automaton may use.
VOCABULARY = 400_000
FIELDS = "n_words long, n_removed long, kept string"


def _windows(w: Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows of all texts, and the anchor of each; fingerprints of all phrases."""
    starts = np.flatnonzero(window_starts(w.first, window))
    phrases = window_hashes(w.hash, phrase)
    least = sliding_min(phrases, window - phrase + 1)
    return starts, least[starts] if len(starts) else np.empty(0, np.uint64), phrases


def _anchors(w: Words, window: int, phrase: int) -> np.ndarray:
    """The anchor of every place at which a phrase is one, repeats included."""
    starts, least, phrases = _windows(w, window, phrase)
    if not len(starts):
        return np.empty(0, np.uint64)
    reach = window - phrase + 1
    at_start = np.zeros(len(phrases) + reach, np.uint64)
    at_start[starts] = least
    # A phrase is an anchor if it is the least of one of the windows that contain it.
    padded = np.concatenate([np.zeros(reach - 1, np.uint64), at_start[:len(phrases)]])
    greatest = ~sliding_min(~padded, reach)
    return phrases[greatest == phrases]


def _slices(docs: DataFrame, text: str, slice_name: str, slice_bytes: int) -> tuple[DataFrame, int]:
    column = F.col(text)
    size = text_bytes(docs, text)
    n = max(1, math.ceil(size / slice_bytes))
    code = F.xxhash64(column)
    # Copies of a text that together are larger than a slice: a row for each such text, written and joined.
    hot_name = free_name(docs, "hot_code")
    hot = keep(docs.groupBy(code.alias(hot_name)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(column)).alias("size"))
               .where(f"n > 1 AND coalesce(size, 0L) + 64 * n > {slice_bytes}").select(hot_name), "hot")
    if hot.isEmpty():
        return docs.withColumn(slice_name, F.pmod(code, F.lit(n)).cast("int")), n
    every = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if not _has_map(f.dataType)])
    key = F.when(F.col(hot_name).isNotNull(), every).otherwise(code)
    joined = docs.join(hot, code == F.col(hot_name), "left")
    return joined.withColumn(slice_name, F.pmod(key, F.lit(n)).cast("int")).drop(hot_name), n


def _has_map(kind) -> bool:
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()


def _uint(column) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


def remove_repeats(docs: DataFrame, *, text: str = "text", name: str | None = None, window: int = WINDOW,
                   phrase: int = PHRASE, slice_bytes: int = SLICE_BYTES, vocabulary: int = VOCABULARY) -> DataFrame:
    """``docs`` with a struct ``{n_words, n_removed, kept}``; ``kept`` has the words that stay, joined by a blank."""
    number = free_name(docs, "slice_number")
    name = name or free_name(docs, "repeats")
    sliced, _ = _slices(docs, text, number, slice_bytes)

    def find_anchors(batches):
        for batch in batches:
            for piece in pieces(batch):
                for k, rows in _by_slice(piece.column("slice")):
                    found = _anchors(find_words(piece.column("text").take(rows), BLANK_WORDS), window, phrase)
                    keys, n = np.unique(found, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), k, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int32))],
                        names=["slice", "anchor", "n"])

    narrow = sliced.select(F.col(text).alias("text"), F.col(number).alias("slice"))
    anchors = keep(narrow.mapInArrow(find_anchors, "slice int, anchor long, n int"), "anchors")
    often = anchors.groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1").select("anchor")
    wanted = anchors.join(often, "anchor", "left_semi").select("slice", "anchor")

    def count_windows(key, left: pa.Table, right: pa.Table) -> pa.Table:
        anchor = np.unique(_uint(right.column("anchor")))
        hashes = []
        for piece in pieces(left):
            w = find_words(piece.column("text"), BLANK_WORDS)
            starts, least, _ = _windows(w, window, phrase)
            if len(starts):
                hashes.append(window_hashes(w.hash, window)[starts[_among(least, anchor)]])
        found, n = np.unique(np.concatenate([*hashes, np.empty(0, np.uint64)]), return_counts=True)
        return pa.table({"slice": pa.array(np.full(len(found), key[0].as_py(), np.int32)),
                         "code": pa.array(found.view(np.int64)), "n": pa.array(n.astype(np.int32))})

    counted = narrow.groupBy("slice").cogroup(wanted.groupBy("slice")).applyInArrow(
        count_windows, "slice int, code long, n int")
    # One row per slice and window: what a slice finds twice it knows already.
    other = F.sum("n").over(Window.partitionBy("code")) > 1
    recurring = counted.withColumn("other", other).where("other and n = 1").select("slice", "code")

    schema = StructType([*docs.schema.fields, StructField(name, StructType.fromDDL(FIELDS))])
    columns = docs.columns

    def locate(left: pa.Table, right: pa.Table) -> pa.Table:
        known = np.unique(_uint(right.column("code")))
        made = _locate(left.column(text), known, window, vocabulary)
        return pa.table([*(left.column(c) for c in columns), made], names=[*columns, name])

    return sliced.groupBy(number).cogroup(recurring.groupBy("slice")).applyInArrow(locate, schema)


def _by_slice(column) -> list[tuple[int, pa.Array]]:
    codes = column.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    cuts = np.flatnonzero(np.diff(codes[order])) + 1
    return [(int(codes[part[0]]), pa.array(part)) for part in np.split(order, cuts) if len(part)]


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def _locate(column, known: np.ndarray, window: int, vocabulary: int) -> pa.StructArray:
    """Remove from the texts of a slice every occurrence of its recurring passages."""
    parts = [find_words(p.column(0), BLANK_WORDS) for p in pieces(pa.table({"text": column}), "text")]
    codes = [window_hashes(w.hash, window)[np.flatnonzero(window_starts(w.first, window))] for w in parts]
    everything, n = np.unique(np.concatenate([*codes, np.empty(0, np.uint64)]), return_counts=True)
    known = np.union1d(known, everything[n > 1])
    tiles: dict[int, np.ndarray] = {}  # the words of each distinct tile
    for w, code in zip(parts, codes):
        starts = np.flatnonzero(window_starts(w.first, window))
        at = starts[_among(code, known)]
        for tile in _tiles(at, window):
            key = int(code[np.searchsorted(starts, tile)])
            if key not in tiles:
                tiles[key] = w.hash[tile:tile + window]
    marks = [np.zeros(len(w.hash), bool) for w in parts]
    for patterns in _shards(list(tiles.values()), vocabulary):
        words = np.unique(np.concatenate(patterns))
        automaton = ahocorasick.Automaton()
        for p in patterns:
            automaton.add_word(_characters(p, words), 1)
        automaton.make_automaton()
        for w, mark in zip(parts, marks):
            stream = _characters(w.hash, words)
            ends = []
            for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
                if b - a >= window:
                    ends.extend(e for e, _ in automaton.iter(stream, a, b))
            mark |= covered(np.array(ends, np.int64) - window + 1, window, len(mark))
    kept = [w.joined(a, b, ~mark).decode() for w, mark in zip(parts, marks)
            for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist())]
    total = [np.concatenate([[0], np.cumsum(m)]) for m in marks]
    removed = np.concatenate([*(t[w.first[1:]] - t[w.first[:-1]] for t, w in zip(total, parts)), np.empty(0, np.int64)])
    counts = np.concatenate([*(w.counts for w in parts), np.empty(0, np.int64)])
    return pa.StructArray.from_arrays(
        [pa.array(counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.string())],
        names=["n_words", "n_removed", "kept"])


def _tiles(at: np.ndarray, window: int) -> list[int]:
    """Window starts that cover the same words as all of ``at`` do: every 35th of a run, and its last."""
    if not len(at):
        return []
    out = []
    cuts = np.flatnonzero(np.diff(at) > 1) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
        first, last = int(at[a]), int(at[b - 1])
        out.extend(range(first, last, window))
        out.append(last)
    return out


def _shards(patterns: list[np.ndarray], vocabulary: int):
    """Groups of patterns whose words fit one automaton's alphabet."""
    step = max(1, vocabulary // (len(patterns[0]) if patterns else 1))
    for k in range(0, len(patterns), step):
        yield patterns[k:k + step]


def _characters(h: np.ndarray, words: np.ndarray) -> str:
    """One character per word: its place among ``words``, or the first character for any other word."""
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    code = np.where(words[at] == h, at + 0x10001, 0x10000).astype("<u4")
    return code.tobytes().decode("utf-32-le")


def digest(cleaned: DataFrame, name: str = "repeats", doc_id: str = "doc_id") -> DataFrame:
    s = F.col(name)
    return cleaned.select(F.col(doc_id), s["n_words"].alias("n_words"), s["n_removed"].alias("n_removed"),
                          F.sha2(s["kept"].cast("binary"), 256).alias("kept_sha256"))
