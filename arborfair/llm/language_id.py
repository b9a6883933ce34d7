"""Language identification by unigrams over pieces, summed over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary.  The probability of a word is the sum, over
all ways to cut it into pieces, of the product of the piece probabilities (forward algorithm); that of a text is the
product over its words.  Training is expectation maximisation: expected piece counts over all segmentations of all training
words, starting from equal probabilities.  Words of one length run through the algorithm together, a column per language.

A word is a run of letters of any script in lower case, with the blank mark before it.  One of more than ``UNIT`` characters goes
through the algorithm step by step: the last forward sums, as many as the longest piece has characters, are rescaled and carried
on, so its sums are over all segmentations too.  A character that is no piece is one unknown piece.

Languages are learned and scored in blocks of ``BLOCK_LANGUAGES``, a pass over the texts each, so a model in memory has a bounded size
whatever the number of languages.

Cases: a null text or one without a letter is ``und`` with score 0, as is every text if nothing was learned; null languages are not
learned; null ids take part in training (their text is empty); repeated rows count as often; extra columns are not read.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, free_name, pieces, strings
from .units import Memo
from .words import find_words, mix

#: Characters (the mark included) up to which words of one length are held whole.
UNIT = 40
#: Longer ones: characters between two rescalings, steps between two states that are kept for the way back, numbers held at a time.
STEP = 32
STEPS = 32
HELD = 1 << 22
#: Rounds of expectation maximisation.
ROUNDS = 1
#: Added to the expected count of every piece.
SMOOTHING = 0.1
#: Bytes of text whose new words are scored together: the steps of the algorithm cost the same for few words as for many.
SCORED_BYTES = 1 << 20
#: Languages of one model in memory.
BLOCK_LANGUAGES = 256
_SCALE = 1_000_000
#: Keeps products of up to UNIT characters (or STEP and a piece) inside the range of doubles; taken off again in the logarithm.
_PER_CHARACTER = 1e4
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_MARK = ord("▁")
_M = 0x9E3779B97F4A7C15 | 1
_REACH = 1024
_POWERS = np.array([pow(_M, i, 1 << 64) for i in range(_REACH)], np.uint64)
_INVERSE = np.array([pow(pow(_M, -1, 1 << 64), i, 1 << 64) for i in range(_REACH)], np.uint64)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


class Vocabulary:
    """Pieces by the fingerprint of their characters; number ``size`` is an unknown character, ``size + 1`` no piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = [model.id_to_piece(i) for i in range(model.vocab_size())
                 if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        texts = sorted(texts)
        self.size, self.longest = len(texts), max(map(len, texts), default=1)
        if self.longest + STEP >= _REACH:
            raise ValueError(f"pieces of more than {_REACH - STEP} characters")
        self._memo = Memo(1 << max(12, self.size.bit_length()))
        codes = [np.array([ord(c) for c in t], np.uint64) for t in texts]
        self._memo.add(np.array([self._fingerprint(c) for c in codes], np.uint64), np.arange(self.size, dtype=np.int32))

    @staticmethod
    def _fingerprint(code: np.ndarray) -> np.uint64:
        return mix((mix(code) * _POWERS[:len(code)]).sum(keepdims=True))[0]

    def lattice(self, codes: np.ndarray):
        """For units of one length (units x characters): yields ``(begin, end, piece numbers)``, ends ascending."""
        m, n = codes.shape
        total = self._sums(codes)
        for end in range(1, n + 1):
            for begin in range(max(0, end - self.longest), end):
                number = self._numbers(total, begin, end)
                if end - begin == 1 or (number <= self.size).any():
                    yield begin, end, number

    @staticmethod
    def _sums(codes: np.ndarray) -> np.ndarray:
        m, n = codes.shape
        total = np.zeros((n + 1, m), np.uint64)
        np.cumsum(mix(codes.T.astype(np.uint64)) * _POWERS[:n, None], axis=0, out=total[1:])
        return total

    def _numbers(self, total: np.ndarray, begin: int, end: int) -> np.ndarray:
        number = self._memo.find(mix((total[end] - total[begin]) * _INVERSE[begin]))
        number[number < 0] = self.size if end - begin == 1 else self.size + 1
        return number

    def ending(self, codes: np.ndarray, first: int) -> np.ndarray:
        """``[i, d - 1]``: the piece of ``d`` characters whose last is number ``first + i`` (no piece where it begins before 0)."""
        total, n = self._sums(codes), codes.shape[1]
        out = np.full((n - first, self.longest, len(codes)), self.size + 1, np.int64)
        for i in range(n - first):
            for d in range(1, min(self.longest, first + i + 1) + 1):
                out[i, d - 1] = self._numbers(total, first + i + 1 - d, first + i + 1)
        return out


_vocabularies: dict[str, Vocabulary] = {}


def load(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    whole = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(w) for w in words], np.int64)
    return whole, sizes, np.cumsum(sizes) - sizes


def _units(words: list[str]):
    """Words of at most ``UNIT`` characters in groups of one length: ``(codes, number of the word of each)``."""
    whole, sizes, begin = _codes(words)
    for n in np.unique(sizes[sizes < UNIT]).tolist():
        rows = np.flatnonzero(sizes == n)
        for lo in range(0, len(rows), 8192):
            part = rows[lo:lo + 8192]
            codes = np.empty((len(part), n + 1), np.uint32)
            codes[:, 0] = _MARK
            codes[:, 1:] = whole[begin[part][:, None] + np.arange(n)]
            yield codes, part


class _Long:
    """Longer words of like length, walked in steps; beyond its end a word is filled up with a character that no piece has."""

    def __init__(self, vocabulary: Vocabulary, codes: np.ndarray, sizes: np.ndarray, p: np.ndarray):
        self.vocabulary, self.codes, self.sizes, self.p = vocabulary, codes, sizes, p
        self.reach = vocabulary.longest
        self.weight = (_PER_CHARACTER ** np.arange(1, self.reach + 1))[:, None, None]
        self.shape = (len(codes), p.shape[1])

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        """The last forward sums, the newest at the end, and the logarithms taken off them."""
        tail = np.zeros((self.reach, *self.shape))
        tail[-1] = 1
        return tail, np.zeros(self.shape)

    def numbers(self, lo: int, hi: int) -> np.ndarray:
        before = max(0, lo - self.reach + 1)
        return self.vocabulary.ending(self.codes[:, before:hi], lo - before)

    def ahead(self, state, lo: int, hi: int) -> np.ndarray:
        """Forward sums up to ``hi`` in the scale of ``state``; row ``reach - 1`` is place ``lo``."""
        sums = np.concatenate([state[0], np.zeros((hi - lo, *self.shape))])
        for i, number in enumerate(self.numbers(lo, hi)):
            sums[self.reach + i] = (sums[i:self.reach + i][::-1] * self.p[number] * self.weight).sum(axis=0)
        return sums

    def carried(self, sums: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tail = sums[-self.reach:]
        top = tail.max(axis=0)
        top[top == 0] = 1
        return tail / top, off + np.log(top)

    def steps(self, lo: int = 0, hi: int | None = None):
        hi = self.codes.shape[1] if hi is None else min(hi, self.codes.shape[1])
        return [(a, min(a + STEP, hi)) for a in range(lo, hi, STEP)]

    def likelihood(self, kept: list | None = None) -> np.ndarray:
        """Scaled log likelihoods; ``kept`` gets the state before every ``STEPS`` steps."""
        state, out = self.start(), np.zeros(self.shape)
        for k, (lo, hi) in enumerate(self.steps()):
            if kept is not None and k % STEPS == 0:
                kept.append(state)
            sums = self.ahead(state, lo, hi)
            ends = np.flatnonzero((self.sizes > lo) & (self.sizes <= hi))
            out[ends] = np.log(sums[self.reach - 1 + self.sizes[ends] - lo, ends]) + state[1][ends]
            state = self.carried(sums, state[1])
        return out

    def expected(self, weights: np.ndarray, out: np.ndarray) -> None:
        """Add the expected counts of all pieces to ``out``: back from the end, the forward sums of each stretch made again."""
        kept: list = []
        whole = self.likelihood(kept)
        tail, off = np.zeros((self.reach, *self.shape)), np.zeros(self.shape)  # backward sums after the step, nearest first
        for k in reversed(range(len(kept))):
            states = [kept.pop()]
            stretch = self.steps(k * STEPS * STEP, (k + 1) * STEPS * STEP)
            for lo, hi in stretch[:-1]:
                states.append(self.carried(self.ahead(states[-1], lo, hi), states[-1][1]))
            for (lo, hi), state in zip(reversed(stretch), reversed(states)):
                sums, size = self.ahead(state, lo, hi), hi - lo
                # Places lo - reach + 1 .. hi; the backward sum of hi is complete but for words that end there.
                back = np.zeros((self.reach + size, *self.shape))
                back[size:] = tail
                ends = np.flatnonzero((self.sizes > lo) & (self.sizes <= hi))
                back[self.reach - 1 + self.sizes[ends] - lo, ends] += np.exp(-off[ends])
                scale = np.exp(np.minimum(state[1] + off - whole, 600)) * weights  # beyond a word's end, where it meets zeros
                numbers = self.numbers(lo, hi)
                for i in reversed(range(size)):
                    piece = self.p[numbers[i]] * self.weight * back[self.reach + i]
                    share = piece * sums[i:self.reach + i][::-1] * scale
                    back[i:self.reach + i] += piece[::-1]
                    for c in range(share.shape[2]):
                        out[:, c] += np.bincount(numbers[i].ravel(), share[:, :, c].ravel(), len(out))
                tail = back[:self.reach]
                top = tail.max(axis=0)
                top[top == 0] = 1
                tail, off = tail / top, off + np.log(top)


def _long_words(vocabulary: Vocabulary, words: list[str], p: np.ndarray):
    """Groups of the words that ``_units`` leaves: ``(walk, number of the word of each)``."""
    sizes = np.array([len(w) for w in words], np.int64)
    rows = np.flatnonzero(sizes >= UNIT)
    rows = rows[np.argsort(sizes[rows], kind="stable")]
    at_once = max(1, HELD // (vocabulary.longest * STEP * max(1, p.shape[1])))
    lo = 0
    while lo < len(rows):
        hi = lo + 1
        while hi < len(rows) and hi - lo < at_once and sizes[rows[hi]] <= 1.25 * sizes[rows[lo]]:
            hi += 1
        part = rows[lo:hi]
        codes = np.zeros((len(part), sizes[part[-1]] + 1), np.uint32)
        codes[:, 0] = _MARK
        for i, r in enumerate(part.tolist()):
            codes[i, 1:sizes[r] + 1] = np.frombuffer(words[r].encode("utf-32-le"), np.uint32)
        yield _Long(vocabulary, codes, sizes[part] + 1, p), part
        lo = hi


def _forward(vocabulary: Vocabulary, codes: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, list]:
    """Scaled forward sums (characters + 1, units, columns), and the lattice."""
    m, n = codes.shape
    steps = list(vocabulary.lattice(codes))
    alpha = np.zeros((n + 1, m, p.shape[1]))
    alpha[0] = 1
    for begin, end, number in steps:
        alpha[end] += alpha[begin] * (p[number] * _PER_CHARACTER ** (end - begin))
    return alpha, steps


def log_likelihood(vocabulary: Vocabulary, words: list[str], p: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language (words x languages)."""
    out = np.zeros((len(words), p.shape[1]))
    for codes, rows in _units(words):
        alpha, _ = _forward(vocabulary, codes, p)
        out[rows] = np.log(alpha[-1]) - codes.shape[1] * math.log(_PER_CHARACTER)
    for walk, rows in _long_words(vocabulary, words, p):
        out[rows] = walk.likelihood() - walk.sizes[:, None] * math.log(_PER_CHARACTER)
    return out


def expected_counts(vocabulary: Vocabulary, words: list[str], weights: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected piece counts (pieces + unknown, languages) of words that occur ``weights`` times in each language."""
    out = np.zeros((vocabulary.size + 2, weights.shape[1]))
    for codes, rows in _units(words):
        alpha, steps = _forward(vocabulary, codes, p)
        beta = np.zeros_like(alpha)
        beta[-1] = 1
        weight = weights[rows]
        for begin, end, number in reversed(steps):
            piece = p[number] * _PER_CHARACTER ** (end - begin)
            share = alpha[begin] * piece * beta[end] / alpha[-1] * weight
            beta[begin] += piece * beta[end]
            for k in range(weights.shape[1]):
                out[:, k] += np.bincount(number, share[:, k], vocabulary.size + 2)
    for walk, rows in _long_words(vocabulary, words, np.broadcast_to(p, (len(p), weights.shape[1]))):
        walk.expected(weights[rows], out)
    return out[:-1]


class Block:
    """Some of the languages in order, their log priors, and piece probabilities with a last row of zeros (no piece)."""

    def __init__(self, languages: list[str], prior: np.ndarray, p: np.ndarray):
        self.languages, self.prior, self.p, self.key = languages, prior, p, uuid.uuid4().hex


class Model:
    """Blocks of languages, each broadcast to the tasks."""

    def __init__(self, languages: list[str], blocks: list):
        self.languages, self.blocks = languages, blocks


def _lower_words(column):
    texts = pc.utf8_lower(strings(column))
    return find_words(texts, _LETTERS)


def _expect(docs: DataFrame, path: str, languages: list[str], p: np.ndarray) -> np.ndarray:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((languages, p))

    def run(batches):
        names, probabilities = shared.value
        column = {c: k for k, c in enumerate(names)}
        vocabulary = load(path)
        total = np.zeros((vocabulary.size + 1, len(names)))
        for batch in batches:
            seen: list[np.ndarray] = []
            texts: list[list[str]] = []
            counts: list[np.ndarray] = []
            for piece in pieces(batch):
                w = _lower_words(piece.column("text"))
                lang = np.array([column.get(c, -1) for c in piece.column("lang").to_pylist()])[w.row]
                h, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
                known = lang >= 0
                n = np.bincount(back[known] * len(names) + lang[known], minlength=len(h) * len(names))
                seen.append(h)
                texts.append([w.text(i) for i in first.tolist()])
                counts.append(n.reshape(len(h), len(names)))
            if not seen:
                continue
            h, first, back = np.unique(np.concatenate(seen), return_index=True, return_inverse=True)
            flat = [t for part in texts for t in part]
            weights = np.zeros((len(h), len(names)))
            np.add.at(weights, back, np.concatenate(counts))
            total += expected_counts(vocabulary, [flat[i] for i in first.tolist()], weights, probabilities)
        at, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(np.rint(total[at, lang] * _SCALE).astype(np.int64))],
            names=["piece", "lang", "n"])

    found = docs.mapInArrow(run, "piece int, lang int, n long").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((load(path).size + 1, len(languages)))  # the size of the model
    out[found.column("piece").to_numpy(), found.column("lang").to_numpy()] = found.column("n").to_numpy() / _SCALE
    return out


def fit(docs: DataFrame, path: str, *, text: str = "text", lang: str = "lang", rounds: int = ROUNDS) -> Model:
    """Learn from all rows of ``docs`` that have a language."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null and text is not null")
    counted = sorted(rows.groupBy("lang").count().collect(), key=lambda r: r["lang"])  # a row per language
    languages, n = [r["lang"] for r in counted], np.array([r["count"] for r in counted], float)
    size, blocks = load(path).size, []
    for lo in range(0, len(languages), BLOCK_LANGUAGES):
        names = languages[lo:lo + BLOCK_LANGUAGES]
        p = np.vstack([np.full((size + 1, 1), 1 / (size + 1)), [[0.0]]])
        for _ in range(rounds):
            counts = _expect(rows, path, names, p) + SMOOTHING
            p = np.vstack([counts / counts.sum(axis=0), np.zeros((1, len(names)))])
        block = Block(names, np.log(n / n.sum())[lo:lo + BLOCK_LANGUAGES], np.broadcast_to(p, (size + 2, len(names))))
        blocks.append(docs.sparkSession.sparkContext.broadcast(block))
    return Model(languages, blocks)


class _Scores:
    """Log probabilities of the words a worker has met, emptied when full."""

    def __init__(self, model: Block, path: str, capacity: int):
        self.model, self.path, self.capacity, self.memo = model, path, capacity, Memo(capacity)
        self.scores, self._used = np.empty((1 << 12, len(model.languages))), 0

    def numbers(self, w) -> np.ndarray:
        """A row of ``scores`` for every word."""
        h, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
        if self.memo.size + len(h) > self.capacity:
            self.memo.clear()
            self._used = 0
        number = self.memo.find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            need = self._used + len(new)
            if need > len(self.scores):
                grown = np.empty((need + need // 4, self.scores.shape[1]))
                grown[:self._used] = self.scores[:self._used]
                self.scores = grown
            self.scores[self._used:need] = log_likelihood(load(self.path), [w.text(i) for i in first[new].tolist()], self.model.p)
            number[new] = self._used + np.arange(len(new))
            self._used = need
            if self.memo.size + len(new) <= 2 * self.capacity:
                self.memo.add(h[new], number[new])
        return number[back]


_scored: dict[str, _Scores] = {}


def _scores_of(model: Block, path: str, capacity: int) -> _Scores:
    if model.key not in _scored:
        _scored.clear()
        _scored[model.key] = _Scores(model, path, capacity)
    return _scored[model.key]



def identify(docs: DataFrame, model: Model, path: str, *, text: str = "text", name: str | None = None, capacity: int = 1 << 19) -> DataFrame:
    """``docs`` with a struct ``{lang_pred, score}``; the score is the posterior probability of the prediction."""
    name = name or free_name(docs, "language")
    if not model.blocks:
        return docs.withColumn(name, F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score")))
    judged, parts = docs, []
    for shared in model.blocks:
        parts.append(free_name(judged, f"{name}_{len(parts)}"))
        judged = attach(judged, parts[-1], "lang string, top double, mass double", _block_scores(shared, path, text, capacity), text,
                        SCORED_BYTES)
    top = F.array_max(F.array(*[F.col(c)["top"] for c in parts]))
    # Of equal scores the first language counts; texts without a letter have no score.
    best = F.coalesce(*[F.when(F.col(c)["top"] == top, F.col(c)["lang"]) for c in parts], F.lit("und"))
    mass = sum((F.col(c)["mass"] * F.exp(F.col(c)["top"] - top) for c in parts[1:]), F.col(parts[0])["mass"] * F.exp(F.col(parts[0])["top"] - top))
    return judged.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(best.alias("lang_pred"), F.coalesce(1 / mass, F.lit(0.0)).alias("score")).alias(name))


def _block_scores(shared, path: str, text: str, capacity: int):
    """Per text the likeliest language of a block, its log score, and the sum of all scores of the block relative to it."""
    def compute(piece):
        fitted: Block = shared.value
        column = strings(piece.column(text))
        w = _lower_words(column)
        table = _scores_of(fitted, path, capacity)
        number = table.numbers(w)
        total = np.vstack([np.zeros((1, len(fitted.languages))), np.cumsum(table.scores[number], axis=0)])
        scores = total[w.first[1:]] - total[w.first[:-1]] + fitted.prior
        best, top = scores.argmax(axis=1), scores.max(axis=1)
        letters = np.array([n > 0 and (t.isascii() or any(map(str.isalpha, t))) for n, t in zip(w.counts.tolist(), column.to_pylist())], bool)
        return [pa.array([fitted.languages[k] for k in best.tolist()], pa.string()), pa.array(top, mask=~letters),
                pa.array(np.exp(scores - top[:, None]).sum(axis=1), mask=~letters)]

    return compute
