"""SentencePiece encoding and decoding by an Aho-Corasick Viterbi search.

An automaton over all pieces reads a text once.  At each position its output links name every piece that ends there,
and each relaxes the best score of a segmentation up to that position.  Of equal scores the longest last piece wins.
A character that is no piece falls back to the pieces of its bytes.

No piece has a blank behind another character, so the best segmentation of a text is that of its units (blanks and
the word behind them), and each distinct unit is segmented once per worker.

For a unigram model, the result is the segmentation with the greatest sum of piece scores.  A model trained by merges asks for
another one: the pieces that remain when the adjacent pair of best score is merged again and again.  Its segmentations are those in
which every two neighbours stay apart when they are merged by themselves, so for such a model a piece may only be relaxed from
a last piece with which it stays apart; just one path is left then, the library's.  Decoding gives the text back either way.

Cases: a null or empty text has no ids and decodes to an empty text; the blank mark U+2581 inside a text is a blank to
the model, as in the library, so it decodes to one; repeated rows and null ids are passed through; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import attach, free_name, strings
from .units import Ragged, UnitCoder

BLANK_MARK = "▁"
_BLANK = np.zeros(256, bool)
_BLANK[0x20] = True
_UNKNOWN_PENALTY = 10.0


class PieceModel:
    """Pieces and scores of a SentencePiece model file with byte fallback.

    ``merges`` says that the model was trained by merges, so that neighbours have to stay apart."""

    def __init__(self, path: str, merges: bool = True):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in normal}
        if any(BLANK_MARK in p.lstrip(BLANK_MARK) for p in pieces):
            raise ValueError("a piece has a blank behind another character")
        self._merges = merges
        self._scores = {p: score for p, (_, score) in pieces.items()}
        self._texts = {i: p for p, (i, _) in pieces.items()}
        self._apart: dict[tuple[int, int], bool] = {}
        if merges and not set("".join(pieces)) <= set(pieces):
            raise ValueError("a character of a piece is no piece itself")
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self._automaton = ahocorasick.Automaton()
        for piece, (i, score) in pieces.items():
            self._automaton.add_word(piece, (len(piece), score, i))
        self._automaton.make_automaton()
        self._whole = {i for p, (i, _) in pieces.items() if not merges or len(self.merge(p)) == 1}
        self._characters = frozenset(p for p in pieces if len(p) == 1)
        self._unknown = min(score for _, score in pieces.values()) - _UNKNOWN_PENALTY
        self._bytes = Ragged(np.uint8)
        raw = [b""] * model.vocab_size()
        for piece, (i, _) in pieces.items():
            raw[i] = piece.replace(BLANK_MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            raw[i] = bytes([b])
        self._bytes.extend(np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw]))
        self.units = UnitCoder(self._encode_units, _BLANK)

    def segment(self, text: str) -> list[int]:
        """Ids of the best segmentation of ``text``, whose blanks are blank marks."""
        n = len(text)
        best, length, last = [0.0] + [float("-inf")] * n, [0] * (n + 1), [0] * (n + 1)
        unknown = [] if self._characters.issuperset(text) else [i + 1 for i, c in enumerate(text) if c not in self._characters]
        at = 0
        for end, (size, score, piece) in self._automaton.iter(text):
            end += 1
            while at < len(unknown) and unknown[at] < end:  # characters without a piece, up to here
                self._relax_unknown(unknown[at], best, length, last)
                at += 1
            total = best[end - size] + score
            if total > best[end] and (not self._merges or self._stays(last[end - size] if size < end else -1, piece)):
                best[end], length[end], last[end] = total, size, piece
        for k in unknown[at:]:
            self._relax_unknown(k, best, length, last)
        out, end = [], n
        while end:
            if last[end] < 0:
                out.extend(self.byte_ids[b] for b in reversed(text[end - 1].encode()))
            else:
                out.append(last[end])
            end -= length[end]
        return out[::-1]

    def merge(self, text: str) -> list[str]:
        """What remains of the characters of a short text when the pair of best score, the first of equals, is merged until none is left."""
        parts = list(text)
        while len(parts) > 1:
            found = [(self._scores.get(a + b, float("-inf")), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            score, at = max(found)
            if score == float("-inf"):
                break
            parts[-at:2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def _stays(self, left: int, piece: int) -> bool:
        """Whether a piece is what merging makes of it behind ``left`` (-1: a character without a piece, or nothing)."""
        if left < 0:
            return piece in self._whole
        known = self._apart.get((left, piece))
        if known is None:
            if len(self._apart) >= 400_000:
                self._apart.clear()
            a, b = self._texts[left], self._texts[piece]
            known = self._apart[left, piece] = self.merge(a + b) == [a, b]
        return known

    def _relax_unknown(self, end: int, best: list, length: list, last: list) -> None:
        total = best[end - 1] + self._unknown
        if total > best[end]:
            best[end], length[end], last[end] = total, 1, -1

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [self.segment(u.replace(" ", BLANK_MARK)) for u in units]
        return np.array([i for ids in lists for i in ids], np.int32), np.array([len(ids) for ids in lists], np.int64)

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text begins."""
        texts = pc.replace_substring(strings(column), BLANK_MARK, " ")
        # The model sets a blank before every text that is not empty.
        texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(" ", texts, ""))
        return self.units.code(texts)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all texts, and where each begins; the blank set before each text is taken off again."""
        raw = self._bytes.gather(ids)
        at = np.concatenate([[0], np.cumsum(self._bytes.lengths(ids))])[first]
        stay = np.ones(len(raw), bool)
        stay[at[:-1][np.diff(at) > 0]] = False
        return raw[stay].tobytes(), at - np.concatenate([[0], np.cumsum(np.diff(at) > 0)])


_models: dict[tuple[str, bool], PieceModel] = {}


def load(path: str, merges: bool = True) -> PieceModel:
    if (path, merges) not in _models:
        _models[path, merges] = PieceModel(path, merges)
    return _models[path, merges]


def encode(docs: DataFrame, path: str, *, text: str = "text", merges: bool = True, name: str | None = None) -> DataFrame:
    """``docs`` with a struct ``{ids}``: the piece ids of every text."""
    def compute(piece):
        ids, first = load(path, merges).encode(piece.column(text))
        return [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))]

    return attach(docs, name or free_name(docs, "pieces"), "ids array<int>", compute, text)


def decode(docs: DataFrame, path: str, *, ids: str, name: str | None = None) -> DataFrame:
    """``docs`` with a struct ``{text}``: the texts of the id lists in column ``ids`` (null: empty)."""
    def compute(piece):
        lists = piece.column(ids)
        flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        raw, at = load(path).decode(flat, np.concatenate([[0], np.cumsum(sizes)]))
        return [pa.array([raw[a:b].decode(errors="replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.string())]

    return attach(docs, name or free_name(docs, "decoded"), "text string", compute, sized_by=None)


def round_trip(docs: DataFrame, path: str, *, text: str = "text", merges: bool = True, name: str | None = None) -> DataFrame:
    """``docs`` with a struct ``{n_bytes, n_pieces, ids_crc32, decoded_bytes, round_trip}``: every text encoded, its ids
    decoded, and whether that gives the text back.  The checksum is over the ids as little-endian 32-bit integers."""
    def compute(piece):
        model, texts = load(path, merges), strings(piece.column(text))
        ids, first = model.encode(texts)
        raw, at = model.decode(ids, first)
        given = [t.encode() for t in texts.to_pylist()]
        crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        same = [raw[a:b] == t for a, b, t in zip(at[:-1].tolist(), at[1:].tolist(), given)]
        return [pa.array([len(t) for t in given], pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array(crc, pa.int64()),
                pa.array(np.diff(at), pa.int64()), pa.array(same, pa.bool_())]

    fields = "n_bytes long, n_pieces long, ids_crc32 long, decoded_bytes long, round_trip boolean"
    return attach(docs, name or free_name(docs, "pieces"), fields, compute, text)
