"""Quality rules by distribution divergence.

Every document has two histograms: classes of characters, and common words of the known languages with
everything else in one bin.  Both are compared with reference histograms of each language by the
Jensen-Shannon distance (base 2, so 0 to 1), and the nearest language counts.  References are measured on
the corpus: the mean histogram of all documents of a language that pass the base rules, summed as
integers so that partitioning cannot change them.

Cases: a null or empty text has no words and fails the base rules; a text shorter than the guards is not
judged by the histogram concerned; a null language joins no reference and is judged like all others, by
the nearest one; without any reference (empty tables) only the base rules decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, free_name, pieces
from .words import BLANK_WORDS, PLAIN_WORDS, find_words, fingerprints, mix, spans_of, window_hashes, window_starts

# Frequent function words of the languages, and the characters of each class.
COMMON_WORDS = {
    "en": "the of and to in is was for that with as it on be by at this from are or an which not have he she they".split(),
    "fr": "de la le et les des en un une du est que dans pour qui par sur pas au ne se ce plus il elle son avec".split(),
    "de": "der die und das in den von zu mit sich des auf ist im dem nicht ein eine als auch es an er aus bei sie".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como o pero sus le ha".split(),
}
CLASSES = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "blank": " \t\r\x0b\x0c", "line": "\n",
    "stop": ".,;:!?", "mark": "'\"()-/", "symbol": "#*$%&|<>@^~`_+=\\{}[]",
}
SYMBOLS = "#*$%&|<>"
_VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words})
_N_CLASSES = len(CLASSES) + 3  # and lower-case ASCII, other ASCII, non-ASCII
_CLASS = np.full(256, len(CLASSES) + 1, np.int64)
for _i, _chars in enumerate(CLASSES.values()):
    _CLASS[[ord(c) for c in _chars]] = _i
_CLASS[0x61:0x7B] = len(CLASSES)
_CLASS[0x80:] = len(CLASSES) + 2
_BASE_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
FIELDS = _BASE_FIELDS + ", base_failed boolean, class_distance double, word_distance double, kept boolean"
_SCALE = 1_000_000_000

#: Beyond these distances a document is rejected.  See the README for the distances of clean and bad texts.
MAX_CLASS_DISTANCE = 0.125
#: Divided by the number of words, added to the limit of the class distance: short texts scatter more.
CLASS_NOISE = 10.0
MAX_WORD_DISTANCE = 0.365
#: Shorter texts are not judged by the histogram.
MIN_CHARS = 200
MIN_WORDS = 100


def _vocabulary_hashes() -> tuple[np.ndarray, np.ndarray]:
    w = find_words(pa.array(_VOCABULARY), PLAIN_WORDS, lower=True)
    order = np.argsort(w.hash)
    return w.hash[order], order


def _within_row_repeats(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry: how often its value occurs in its row, and whether it is the first."""
    key = mix(h + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, first, back, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    mark = np.zeros(len(key), bool)
    mark[first] = True
    return n[back], mark


def measure(column) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The five base counts, the characters, and both histograms (texts x bins)."""
    w = find_words(column, BLANK_WORDS)
    n, row = len(w.counts), w.row
    lead = (w.data & 0xC0) != 0x80
    at_byte = np.concatenate([[0], np.cumsum(lead)])
    chars = at_byte[w.rows[1:]] - at_byte[w.rows[:-1]]
    word_chars = np.bincount(row, weights=at_byte[w.end] - at_byte[w.start], minlength=n).astype(np.int64)
    is_symbol = np.zeros(256, bool)
    is_symbol[[ord(c) for c in SYMBOLS]] = True
    symbols = np.concatenate([[0], np.cumsum(is_symbol[w.data])])
    n_symbols = symbols[w.rows[1:]] - symbols[w.rows[:-1]]

    in_line = np.ones(256, bool)
    in_line[0x0A] = False
    a, b = spans_of(w.data, w.rows, in_line)
    with_word = np.searchsorted(w.start, b) > np.searchsorted(w.start, a)
    a, b = a[with_word], b[with_word]
    line_row = np.searchsorted(w.rows, a, "right") - 1
    _, fresh = _within_row_repeats(line_row, fingerprints(w.data, a, b))
    dup_lines = np.bincount(line_row[~fresh], minlength=n)

    starts = np.flatnonzero(window_starts(w.first, 3))
    times, _ = _within_row_repeats(row[starts], window_hashes(w.hash, 3)[starts])
    repeated = np.zeros(len(row) + 3, bool)
    for j in range(3):
        repeated[starts[times > 1] + j] = True
    n_repeat = np.bincount(row[repeated[:len(row)]], minlength=n)

    byte_row = np.repeat(np.arange(n), np.diff(w.rows))
    classes = np.bincount((byte_row * _N_CLASSES + _CLASS[w.data])[lead], minlength=n * _N_CLASSES)
    p = find_words(column, PLAIN_WORDS, lower=True)
    known, number = _vocabulary_hashes()
    slot = np.minimum(np.searchsorted(known, p.hash), len(known) - 1)
    bin_of = np.where(known[slot] == p.hash, number[slot], len(known))
    bins = len(known) + 1
    words = np.bincount(p.row * bins + bin_of, minlength=n * bins)
    counts = [w.counts, word_chars, n_symbols, dup_lines, n_repeat]
    return counts, chars, classes.reshape(n, _N_CLASSES), words.reshape(n, bins)


def failed_base(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def shares(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=1, keepdims=True)
    return counts / np.maximum(total, 1)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of each row of p to the distribution q: square root of the Jensen-Shannon divergence, base 2."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def fit_references(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean histograms of each language over all documents that pass the base rules."""
    width = _N_CLASSES + len(_VOCABULARY) + 1

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                counts, _, classes, words = measure(piece.column("text"))
                fine = ~failed_base(counts[0], counts[4])
                both = np.rint(np.hstack([shares(classes), shares(words)]) * _SCALE).astype(np.int64)
                sums: dict[str, np.ndarray] = {}
                for k, code in enumerate(piece.column("lang").to_pylist()):
                    if fine[k] and code is not None:
                        total = sums.setdefault(code, np.zeros(width + 1, np.int64))
                        total[0] += 1
                        total[1:] += both[k]
                codes = [c for c in sums for _ in range(width + 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(codes, pa.string()), pa.array(np.tile(np.arange(width + 1), len(sums)), pa.int32()),
                     pa.array(np.concatenate([*sums.values(), np.empty(0, np.int64)]), pa.int64())],
                    names=["lang", "bin", "total"])

    summed = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")) \
        .mapInArrow(run, "lang string, bin int, total long").groupBy("lang", "bin").agg(F.sum("total").alias("total"))
    by_lang = summed.groupBy("lang").agg(
        F.max(F.when(F.col("bin") == 0, F.col("total"))).alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("bin", "total"))), lambda x: x["total"]).alias("totals"))
    out = {}
    for r in by_lang.collect():  # a row of about 130 numbers per language
        mean = np.array(r["totals"][1:], float)
        c, v = mean[:_N_CLASSES], mean[_N_CLASSES:]
        out[r["lang"]] = (c / max(c.sum(), 1), v / max(v.sum(), 1))
    return out


def judge(docs: DataFrame, references: dict[str, tuple[np.ndarray, np.ndarray]], *, text: str = "text",
          name: str | None = None, max_class: float = MAX_CLASS_DISTANCE, class_noise: float = CLASS_NOISE,
          max_word: float = MAX_WORD_DISTANCE, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with a struct of ``FIELDS``; a distance that is not judged is null."""
    ordered = [references[k] for k in sorted(references)]

    def nearest(p, which, judged):
        if not ordered:
            return np.zeros(len(p)), np.zeros(len(p), bool)
        return np.min([js_distance(p, r[which]) for r in ordered], axis=0), judged

    def compute(piece):
        counts, chars, classes, words = measure(piece.column(text))
        base = failed_base(counts[0], counts[4])
        c, c_judged = nearest(shares(classes), 0, chars >= min_chars)
        v, v_judged = nearest(shares(words), 1, counts[0] >= min_words)
        limit = max_class + class_noise / np.maximum(counts[0], 1)
        kept = ~base & ~(c_judged & (c > limit)) & ~(v_judged & (v > max_word))
        return [*(pa.array(x, pa.int64()) for x in counts), pa.array(base),
                pa.array(c, mask=~c_judged), pa.array(v, mask=~v_judged), pa.array(kept)]

    return attach(docs, name or free_name(docs, "quality_rules"), FIELDS, compute, text)
