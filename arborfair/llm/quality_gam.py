"""A generalised additive model of document quality with pairwise interactions.

Features of the text are cut into bins at training quantiles.  Every feature has a table with a value per bin, and the strongest
pairs of features have a table with a value per pair of coarse bins.  Tables are learned by cyclic gradient boosting: feature
after feature, a shallow tree over the bins is fitted to the current gradient and added to the table with a small step.  A
score is a sum of table entries through the logistic function.

Labels come from a bounded sample: the ``MAX_TRAIN`` labelled training rows whose ids hash lowest.  Only their features reach the driver.

Cases: a null or empty text has features too (zeros) and gets a score; missing or other labels than 0 and 1 are not learned;
without any label every score is 0.5; ids that repeat are scored as often; null ids are scored and never learned.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces
from .divergence import measure

#: Most labelled rows that training uses.
MAX_TRAIN = 100_000
BINS = 48
COARSE = 8
PAIRS = 8
CYCLES = 150
PAIR_CYCLES = 60
STEP = 0.1
_LEAST = 20.0  # of a leaf: rows
FEATURES = ("log_words", "word_length", "symbol_share", "upper_share", "digit_share", "stop_share", "mark_share", "line_share",
            "blank_share", "wide_share", "dup_lines", "repeat_share", "common_share", "chars_per_line")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def features(column) -> np.ndarray:
    """Texts x features."""
    (n_words, word_chars, n_symbols, dup_lines, n_repeat), chars, classes, words = measure(column)
    upper, digit, blank, line, stop, mark, _, lower, _, wide = classes.T
    some, per = np.maximum(n_words, 1), np.maximum(chars, 1)
    common = words[:, :-1].sum(axis=1) / np.maximum(words.sum(axis=1), 1)
    columns = [np.log1p(n_words), word_chars / some, n_symbols / per, upper / np.maximum(upper + lower + wide, 1), digit / per, stop / some,
               mark / some, line / some, blank / some, wide / per, dup_lines / (line + 1), n_repeat / some, common, np.log1p(chars / (line + 1))]
    return np.column_stack(columns).astype(float)


@dataclass
class Gam:
    edges: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)])

    def coarse(self, bins: np.ndarray) -> np.ndarray:
        """Neighbouring bins together, COARSE of them per feature."""
        width = np.array([len(e) + 1 for e in self.edges])
        return bins * COARSE // width

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not self.tables:
            return np.full(len(x), self.intercept)
        bins = self.bins(x)
        out = self.intercept + sum(t[bins[:, j]] for j, t in enumerate(self.tables))
        if self.pairs:
            rough = self.coarse(bins)
            out = out + sum(t[rough[:, a], rough[:, b]] for a, b, t in self.pairs)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -35, 35)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """The gain and place of the best cut of a row of bins."""
    if len(g) < 2:
        return 0.0, 0
    lg, lh, ln = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = _gain(lg, lh) + _gain(g.sum() - lg, h.sum() - lh) - _gain(g.sum(), h.sum())
    gain[(ln < _LEAST) | (n.sum() - ln < _LEAST)] = 0
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Values per bin of a tree with a few leaves, grown where it gains most."""
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        options = [(*_best_cut(g[a:b], h[a:b], n[a:b]), a) for a, b in zip(cuts[:-1], cuts[1:])]
        gain, at, start = max(options)
        if gain <= 0:
            break
        cuts = sorted([*cuts, start + at])
    out = np.empty(len(g))
    for a, b in zip(cuts[:-1], cuts[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Over a grid: one cut of an axis, then one cut of the other axis on either side; its gain and values."""
    best = (0.0, np.zeros_like(g))
    for flip in (False, True):
        gg, hh, nn = (x.T if flip else x for x in (g, h, n))
        for cut in range(1, len(gg)):
            total, values = 0.0, np.zeros_like(gg)
            for side in (slice(0, cut), slice(cut, None)):
                a, b, c = gg[side].sum(axis=0), hh[side].sum(axis=0), nn[side].sum(axis=0)
                _, at = _best_cut(a, b, c)
                for part in ([slice(0, at), slice(at, None)] if at else [slice(None)]):
                    total += float(_gain(a[part].sum(), b[part].sum()))
                    values[side, part] = a[part].sum() / (b[part].sum() + 1.0)
            total -= float(_gain(g.sum(), h.sum()))
            if total > best[0]:
                best = total, values.T if flip else values
    return best


def fit_gam(x: np.ndarray, y: np.ndarray) -> Gam:
    """Learn from a bounded matrix of features and labels 0/1."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.empty(0) for c in x.T] or [np.empty(0)] * len(FEATURES)
    gam = Gam(edges)
    if not len(y):
        return gam
    rate = (y.sum() + 0.5) / (len(y) + 1)
    gam.intercept = math.log(rate / (1 - rate))
    bins = gam.bins(x)
    width = [len(e) + 1 for e in edges]
    gam.tables = [np.zeros(w) for w in width]
    counts = [np.bincount(bins[:, j], minlength=w).astype(float) for j, w in enumerate(width)]
    logit = np.full(len(y), gam.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(CYCLES):
        for j, w in enumerate(width):
            g, h = slopes()
            add = STEP * _shallow_tree(np.bincount(bins[:, j], g, w), np.bincount(bins[:, j], h, w), counts[j])
            gam.tables[j] += add
            logit += add[bins[:, j]]
    rough = gam.coarse(bins)
    cells = {(a, b): rough[:, a] * COARSE + rough[:, b] for a in range(len(width)) for b in range(a)}
    grid = lambda cell, v=None: np.bincount(cell, v, COARSE * COARSE).reshape(COARSE, COARSE).astype(float)
    g, h = slopes()
    ranked = sorted(cells, key=lambda k: -_pair_tree(grid(cells[k], g), grid(cells[k], h), grid(cells[k]))[0])[:PAIRS]
    gam.pairs = [(a, b, np.zeros((COARSE, COARSE))) for a, b in ranked]
    for _ in range(PAIR_CYCLES):
        for a, b, t in gam.pairs:
            g, h = slopes()
            add = STEP * _pair_tree(grid(cells[a, b], g), grid(cells[a, b], h), grid(cells[a, b]))[1]
            t += add
            logit += add[rough[:, a], rough[:, b]]
    return gam


def with_features(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, features)`` of every row."""
    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                x = features(piece.column("text"))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(FEATURES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), flat], names=["doc_id", "features"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, features array<double>")


def fit(featured: DataFrame, labels: DataFrame, *, label: str = "quality", doc_id: str = "doc_id", max_train: int = MAX_TRAIN) -> Gam:
    """Learn from rows that are not held out."""
    wanted = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    wanted = wanted.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = featured.dropDuplicates(["doc_id"]).join(wanted, "doc_id").orderBy("doc_id").select("features", "y").toArrow()
    x = rows.column("features").combine_chunks()
    flat = (x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks)).flatten().to_numpy(zero_copy_only=False) if rows.num_rows else np.empty(0)
    return fit_gam(flat.reshape(-1, len(FEATURES)), rows.column("y").to_numpy().astype(float))


def score(featured: DataFrame, model: Gam, *, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``(doc_id, features)``."""
    shared = featured.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            s = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])

    scored = featured.mapInArrow(run, f"doc_id {featured.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
