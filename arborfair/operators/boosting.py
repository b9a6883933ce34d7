"""Gradient boosting of small trees on numeric columns, with a split at any boundary between two values.

A round fits one regression tree per class (one in all for two classes) to the gradients of the log loss, and gives each
leaf its Newton step.  Rows whose values lie in the same buckets and that share their label are one *cell* with a count: no cut
in use divides a cell, so its rows have the same margins.  One level of all trees of a round is one pass over
the cells: every task adds up rows, gradients and curvatures per (tree, node, column, bucket of values), and one shuffle brings the
buckets of a column together.

The gain of a cut is convex in the sums on its left, so what a cut inside a bucket can gain is bounded by the corners of the box
of sums which the bucket spans.  Only buckets whose bound reaches the best border are taken apart, in a second
pass over their rows, and are finer from then on; the tree is that of all boundaries.  The rows of such buckets are set aside: they
take the place of their cells, and second passes read nothing else.  Sums are whole numbers (gradients in fixed point), so partitioning cannot change a tree.

Ties: the lowest column, then the lowest threshold.  Missing values and NaN fail every test, infinite values are values; rows without
a label are left out; a table without rows, or of one class, has no trees.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import quoted
from ..functions.ranks import midpoint
from ..session import Scratch, spread

#: Buckets of values per column, and sums a task may hold (columns with buckets, of all nodes and trees of a level).
BUCKETS = 1024
TASK_SUMS = 1 << 22
#: An opened bucket becomes this many, as long as its column has no more than FINEST times the buckets of the start.
PIECES = 32
FINEST = 8
#: Tables of fewer rows are read whole in every pass: jobs cost more than rows there.
SMALL_ROWS = 2_000_000
#: Rows of opened buckets in one file, about, and the tables of them that are read side by side.
ROWS_ASIDE = 200_000
MOST_ASIDE = 8
#: Cuts must gain this share of a row's gradient on average.
LEAST_GAIN = 1e-12
_SLACK = 1 + 1e-9
_SUMS = ("n", "g", "h")
_KEYS = ["t", "node", "feature"]


@dataclass
class BoostedTree:
    """Nodes by number; a leaf has feature -1.  ``x <= threshold`` goes left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    @property
    def splits(self) -> list[tuple[int, float]]:
        return [(f, t) for f, t in zip(self.feature, self.threshold) if f >= 0]

    def leaves(self, x: list[np.ndarray]) -> np.ndarray:
        node = np.zeros(len(x[0]), np.int64)
        if self.feature[0] < 0:
            return node
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right = np.array(self.left), np.array(self.right)
        while True:
            f = feature[node]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return node
            passed = np.zeros(len(inner), bool)
            for j in np.unique(f[inner]):
                of = f[inner] == j
                passed[of] = x[j][inner[of]] <= threshold[node[inner[of]]]
            node[inner] = np.where(passed, left[node[inner]], right[node[inner]])

    def split(self, node: int, feature: int, threshold: float, gain: float, left: float, right: float) -> tuple[int, int]:
        made = len(self.feature), len(self.feature) + 1
        self.feature[node], self.threshold[node], self.gain[node] = feature, threshold, gain
        self.left[node], self.right[node] = made
        for value in (left, right):
            for values, v in zip((self.feature, self.threshold, self.left, self.right, self.value, self.gain),
                                 (-1, 0.0, 0, 0, value, 0.0)):
                values.append(v)
        return made


@dataclass
class Model:
    n_classes: int
    prior: list[float]
    learning_rate: float
    rounds: list[list[BoostedTree]]

    def splits(self) -> list[tuple[int, float]]:
        """Distinct ``(column position, threshold)`` of all trees, in order."""
        return sorted({s for trees in self.rounds for tree in trees for s in tree.splits})

    def importances(self, columns: int) -> list[float]:
        """What the splits on each column gained, as shares of the whole."""
        sums = [0.0] * columns
        for trees in self.rounds:
            for tree in trees:
                for f, gain in zip(tree.feature, tree.gain):
                    if f >= 0:
                        sums[f] += gain
        whole = sum(sums)
        return [s / whole if whole else 0.0 for s in sums]

    def margins(self, x: list[np.ndarray]) -> np.ndarray:
        """Trees x rows.  Trees of one split are added up to one step function per column first."""
        out = np.empty((len(self.prior), len(x[0])))
        for t, start in enumerate(self.prior):
            out[t] = start
            steps: dict[int, dict[float, float]] = {}
            for trees in self.rounds:
                tree = trees[t]
                if len(tree.feature) == 3:
                    out[t] += self.learning_rate * tree.value[2]
                    at = steps.setdefault(tree.feature[0], {})
                    at[tree.threshold[0]] = at.get(tree.threshold[0], 0.0) + tree.value[1] - tree.value[2]
                elif len(tree.feature) > 3:
                    out[t] += self.learning_rate * np.array(tree.value)[tree.leaves(x)]
            for f in sorted(steps):
                cuts = np.array(sorted(steps[f]))
                # What a value gets is the sum over all thresholds that it does not exceed; a missing value gets none.
                gets = np.append(np.cumsum([steps[f][c] for c in cuts[::-1]])[::-1], 0.0)
                out[t] += self.learning_rate * gets[np.searchsorted(cuts, x[f], "left")]
        return out


def gradients(margins: np.ndarray, y: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """What is missing to the label, and the curvature of the loss, per tree and row."""
    if n_classes == 2:
        p = 1 / (1 + np.exp(-margins))
        hit = (y == 1)[None]
    else:
        p = np.exp(margins - margins.max(axis=0))
        p /= p.sum(axis=0)
        hit = y[None] == np.arange(n_classes)[:, None]
    return hit - p, p * (1 - p)


def _whole_sums(key: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of whole numbers per key, exact although the counting is done in doubles."""
    if np.abs(values).sum(dtype=float) < 2.0**52:
        return np.bincount(key, weights=values, minlength=size).astype(np.int64)
    low = values & 0xFFFFF
    high = (values - low) >> 20
    return (np.bincount(key, weights=high, minlength=size).astype(np.int64) << 20) + _whole_sums(key, low, size)


class Booster:
    """Fits models on the columns ``x0, x1, ..`` of a table kept for the fit (``_y``, ``_w``, the columns)."""

    def __init__(self, kept: DataFrame, columns: int, n_classes: int, n_estimators: int, learning_rate: float,
                 max_depth: int, edges: list[list[float]], scratch: Scratch):
        if max_depth < 1 or n_classes < 2:
            raise ValueError("boosting needs a depth of at least 1 and two classes")
        self.kept, self.columns, self.n_classes, self.max_depth = kept, columns, n_classes, max_depth
        self.n_estimators, self.learning_rate = n_estimators, learning_rate
        self.edges = [np.array(e, float) for e in edges]
        self.first_edges, self.scratch = list(self.edges), scratch
        self.most_edges = FINEST * max([PIECES, *map(len, edges)])
        # Buckets of the start that were opened, by column, and their rows.
        self.opened: dict[int, set[int]] = {}
        self.aside: list[DataFrame] = []
        found = kept.groupBy("_y").agg(F.sum("_w").alias("w"), F.count(F.lit(1)).alias("n")).collect()
        counts = {r["_y"]: r["w"] for r in found}
        self.n_rows, size = sum(counts.values()), sum(r["n"] for r in found)
        self.small = size <= SMALL_ROWS
        self.coarse = None if self.small else scratch.keep(self._cells(kept), "cells")
        self.prior: list[float] = []
        if sum(0 <= y < n_classes for y in counts) > 1:
            share = [min(max(counts.get(c, 0) / self.n_rows, 1e-7), 1 - 1e-7) for c in range(n_classes)]
            self.prior = [math.log(share[1] / share[0])] if n_classes == 2 else [math.log(s) for s in share]
        self.bits = min(30, 62 - int(self.n_rows or 1).bit_length())

    def fit(self, allowed: list[int] | None = None, before: Model | None = None) -> Model:
        """A model on the ``allowed`` columns.

        ``before``, fitted on more columns, hands down its rounds up to the first that splits a column now missing:
        up to there both fits are the same.
        """
        allowed = list(range(self.columns)) if allowed is None else allowed
        model = Model(self.n_classes, self.prior, self.learning_rate, [])
        if not self.prior or not allowed:
            return model
        for trees in before.rounds if before else []:
            if any(f not in allowed for tree in trees for f, _ in tree.splits):
                break
            model.rounds.append(trees)
        else:
            if before:
                return model
        while len(model.rounds) < self.n_estimators:
            trees = self._round(model, allowed)
            if not any(tree.splits for tree in trees):
                break
            model.rounds.append(trees)
        return model

    def accuracy(self, model: Model) -> float:
        """The share of training rows whose class has the greatest margin."""
        if not model.prior:
            return 1.0
        read, live = self._reader(model, []), self._live()

        def run(batches):
            for batch in live(batches):
                _, y, w, margins = read(batch)
                said = (margins[0] >= 0).astype(np.int64) if len(margins) == 1 else margins.argmax(axis=0)
                yield pa.RecordBatch.from_pydict({"w": pa.array([int(w[said == y].sum())], pa.int64())})

        return (self._table().mapInArrow(run, "w long").agg(F.sum("w")).first()[0] or 0) / self.n_rows

    # -- cells -------------------------------------------------------------------------------------

    def _cells(self, rows: DataFrame) -> DataFrame:
        """The rows between the same edges and of one label: their weight, and the least (``x``) and greatest (``hi``)
        value of each column, null where it is missing."""
        edges, columns = self.edges, range(self.columns)

        def run(batches):
            for batch in batches:
                x = [batch.column(f"x{i}").to_numpy(zero_copy_only=False).astype(float) for i in columns]
                places = [np.where(np.isnan(v), len(e) + 1, np.searchsorted(e, v, "left")) for v, e in zip(x, edges)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *(pa.array(b.astype(np.int32)) for b in places)],
                    names=[*batch.schema.names, *(f"b{i}" for i in columns)])

        kinds = ", ".join(["_y int", "_w long", *(f"x{i} double" for i in columns), *(f"b{i} int" for i in columns)])
        placed = rows.select("_y", "_w", *[f"x{i}" for i in columns]).mapInArrow(run, kinds)
        return placed.groupBy("_y", *[f"b{i}" for i in columns]).agg(
            F.sum("_w").alias("_w"), *[F.min(f"x{i}").alias(f"x{i}") for i in columns],
            *[F.max(f"x{i}").alias(f"hi{i}") for i in columns],
        ).select("_y", "_w", *[f"x{i}" for i in columns], *[f"hi{i}" for i in columns])

    def _table(self) -> DataFrame:
        """The cells, and the rows set aside as cells of their own; ``_live`` drops the cells that those replace."""
        x, hi = [f"x{i}" for i in range(self.columns)], [f"hi{i}" for i in range(self.columns)]
        own = ["_y", "_w", *x, *[f"{a} AS {b}" for a, b in zip(x, hi)], "false AS _cell"]
        if self.small:
            return self.kept.selectExpr(*own)
        rows = [df.selectExpr(*own) for df in self.aside]
        return reduce(DataFrame.unionAll, rows, self.coarse.selectExpr("_y", "_w", *x, *hi, "true AS _cell"))

    def _live(self):
        edges, gone = self.first_edges, {}
        for f, of in self.opened.items():
            gone[f] = np.zeros(len(edges[f]) + 2, bool)
            gone[f][sorted(of)] = True

        def live(batches):
            for batch in batches:
                if gone:
                    cell = batch.column("_cell").to_numpy(zero_copy_only=False)
                    drop = np.zeros(len(batch), bool)
                    for f, of in gone.items():
                        x = batch.column(f"x{f}").to_numpy(zero_copy_only=False).astype(float)
                        drop |= of[np.where(np.isnan(x), len(edges[f]) + 1, np.searchsorted(edges[f], x, "left"))]
                    batch = batch.filter(pa.array(~(drop & cell)))
                yield batch

        return live

    def _rows(self, opened: dict[int, set[int]]) -> DataFrame:
        """The rows of buckets of the start, each once; those not set aside before are set aside now."""
        if self.small:
            return self.kept
        new = {f: of - self.opened.get(f, set()) for f, of in opened.items()}
        new = {f: of for f, of in new.items() if of}
        if new:
            found = self.kept.where(self._in_buckets(self.first_edges, new))
            if self.opened:
                found = found.where(f"NOT {self._in_buckets(self.first_edges, self.opened)}")
            self.aside.append(self.scratch.keep(found.repartition(self._files(new)), "aside"))
            self.opened = {f: self.opened.get(f, set()) | new.get(f, set()) for f in {*self.opened, *new}}
            if len(self.aside) > MOST_ASIDE:
                together = reduce(DataFrame.unionAll, self.aside).repartition(self._files(self.opened))
                self.aside = [self.scratch.keep(together, "aside")]
        return reduce(DataFrame.unionAll, self.aside)

    def _files(self, opened: dict[int, set[int]]) -> int:
        share = sum(len(of) / (len(self.first_edges[f]) + 1) for f, of in opened.items())
        return max(1, math.ceil(min(share, 1.0) * self.n_rows / ROWS_ASIDE))

    @staticmethod
    def _in_buckets(edges: list[np.ndarray], buckets: dict[int, set[int]]) -> str:
        """A condition (never null) that holds for the rows in any of the buckets of each column."""
        parts = []
        for f, of in sorted(buckets.items()):
            ends = sorted(of)
            runs = np.split(np.array(ends), np.flatnonzero(np.diff(ends) > 1) + 1)
            for run in runs:
                lo = f"x{f} > {_number(edges[f][run[0] - 1])}" if run[0] > 0 else "true"
                hi = f"x{f} <= {_number(edges[f][run[-1]])}" if run[-1] < len(edges[f]) else "true"
                parts.append(f"coalesce(x{f} IS NOT NULL AND {lo} AND {hi}, false)")
        return f"({' OR '.join(parts)})"

    # -- one round ---------------------------------------------------------------------------------

    def _round(self, model: Model, allowed: list[int]) -> list[BoostedTree]:
        trees = [BoostedTree() for _ in self.prior]
        level = [(t, 0) for t in range(len(trees))]
        for _ in range(self.max_depth):
            following = []
            for (t, node), best in sorted(self._best(model, allowed, trees, level).items()):
                right = [best[f"t{s}"] - best[f"l{s}"] for s in _SUMS]
                left = [best[f"l{s}"] for s in _SUMS]
                made = trees[t].split(node, best["feature"], best["threshold"], best["gain"] / self.n_rows,
                                      self._step(left), self._step(right))
                following += [(t, child) for child, side in zip(made, (left, right)) if side[0] > 1]
            level = following
            if not level:
                break
        return trees

    def _step(self, sums: list[int]) -> float:
        n_trees = len(self.prior)
        share = (n_trees - 1) / n_trees if n_trees > 1 else 1.0
        return share * sums[1] / sums[2] if sums[2] else 0.0

    def _reader(self, model: Model, trees: list[BoostedTree]):
        columns = self.columns

        def read(batch):
            table = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            x = [table[f"x{i}"].to_numpy(zero_copy_only=False).astype(float) for i in range(columns)]
            return x, table["_y"].to_numpy(zero_copy_only=False), table["_w"].to_numpy(zero_copy_only=False), model.margins(x)

        return read

    def _placed(self, model: Model, allowed: list[int], trees: list[BoostedTree], level: list[tuple[int, int]]):
        """Of a batch: per tree the rows in open nodes, the slot of each node, fixed-point gradients; and buckets per column."""
        read, edges, n_classes, scale = self._reader(model, trees), self.edges, self.n_classes, 1 << self.bits
        slots = [np.full(len(tree.feature), -1, np.int64) for tree in trees]
        for i, (t, node) in enumerate(level):
            slots[t][node] = i

        def place(batch):
            x, y, w, margins = read(batch)
            g, h = gradients(margins, y, n_classes)
            buckets = {f: np.where(np.isnan(x[f]), len(edges[f]) + 1, np.searchsorted(edges[f], x[f], "left")) for f in allowed}
            found = []
            for t, tree in enumerate(trees):
                slot = slots[t][tree.leaves(x)]
                rows = np.flatnonzero(slot >= 0)
                if len(rows):
                    sums = [w[rows], *(np.rint(v[t][rows] * scale).astype(np.int64) * w[rows] for v in (g, h))]
                    found.append((slot[rows], rows, sums))
            return x, buckets, found

        return place

    def _best(self, model: Model, allowed: list[int], trees: list[BoostedTree], level: list[tuple[int, int]]) -> dict:
        """The best cut of each open node that has one."""
        borders = self._borders(model, allowed, trees, level)
        top: dict = {}
        for r in borders:
            if r["gain"] > LEAST_GAIN * r["tn"]:
                key = (r["t"], r["node"])
                if key not in top or self._order(r) < self._order(top[key]):
                    top[key] = r
        opened = [r for r in borders if r["bound"] is not None and r["bound"] * _SLACK > LEAST_GAIN * r["tn"]
                  and ((r["t"], r["node"]) not in top or r["bound"] * _SLACK >= top[r["t"], r["node"]]["gain"])]
        inner = self._inner(model, trees, level, opened) if opened else []
        for r in inner:
            if r["gain"] is None:
                continue
            key = (r["t"], r["node"])
            if key not in top or self._order(r) < self._order(top[key]):
                top[key] = r
        self._refine(inner, [(r["feature"], r["threshold"]) for r in top.values() if "pieces" in r])
        return top

    @staticmethod
    def _order(r) -> tuple:
        return -r["gain"], r["feature"], r["threshold"]

    def _gain(self, n: str, g: str) -> str:
        unit = float(1 << self.bits)
        l, r, w = (f"({v} / {unit!r}D)" for v in (f"double({g})", f"double(tg - ({g}))", "double(tg)"))
        return f"({l} * {l} / double({n}) + {r} * {r} / double(tn - ({n})) - {w} * {w} / double(tn))"

    def _borders(self, model: Model, allowed: list[int], trees: list[BoostedTree], level: list[tuple[int, int]]) -> list[dict]:
        """The best border between buckets per node and column, and the buckets that may hide a better cut."""
        place, live, width = self._placed(model, allowed, trees, level), self._live(), max(len(self.edges[f]) for f in allowed) + 2
        number = {f: i for i, f in enumerate(allowed)}
        size = len(level) * len(allowed) * width
        names = ["t", "node", "feature", "bucket", "n", "g", "h", "neg", "pos", "lo", "hi"]

        def run(batches):
            sums = np.zeros((5, size), np.int64)
            lo, hi = np.full(size, np.inf), np.full(size, -np.inf)
            for batch in live(batches):
                x, buckets, found = place(batch)
                for slot, rows, (n, g, h) in found:
                    for f in allowed:
                        key = (slot * len(allowed) + number[f]) * width + buckets[f][rows]
                        for i, v in enumerate((n, g, h, np.minimum(g, 0), np.maximum(g, 0))):
                            sums[i] += _whole_sums(key, v, size)
                        np.fmin.at(lo, key, x[f][rows])
                        np.fmax.at(hi, key, batch.column(f"hi{f}").to_numpy(zero_copy_only=False)[rows])
            used = np.flatnonzero(sums[0])
            at, bucket = used // width, used % width
            slot, feature = at // len(allowed), np.array(allowed)[at % len(allowed)]
            open_nodes = np.array(level).reshape(-1, 2)
            missing = bucket == np.array([len(e) + 1 for e in self_edges])[feature]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v.astype(np.int32)) for v in (open_nodes[slot, 0], open_nodes[slot, 1], feature, bucket)]
                + [pa.array(s[used]) for s in sums] + [pa.array(lo[used], mask=missing), pa.array(hi[used], mask=missing)], names=names)

        self_edges = self.edges
        schema = "t int, node int, feature int, bucket int, n long, g long, h long, neg long, pos long, lo double, hi double"
        # Tasks have added up already: the buckets of a column meet by one shuffle, in which no key is hot.
        buckets = self._table().mapInArrow(run, schema).repartition(*_KEYS).groupBy(*_KEYS, "bucket").agg(
            *[F.sum(s).alias(s) for s in ("n", "g", "h", "neg", "pos")], F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        by = ", ".join(_KEYS)
        swept = buckets.selectExpr(
            "*", *[f"sum({s}) OVER (PARTITION BY {by} ORDER BY bucket) AS l{s}" for s in _SUMS],
            *[f"sum({s}) OVER (PARTITION BY {by}) AS t{s}" for s in _SUMS],
            f"lead(lo) OVER (PARTITION BY {by} ORDER BY bucket) AS next_lo")
        corners = [self._gain(n, g) for n in ("ln - n + 1", "ln - 1") for g in ("lg - g + neg", "lg - g + pos")]
        scored = swept.selectExpr(
            "*", f"if(next_lo IS NULL, 0D, {self._gain('ln', 'lg')}) AS gain",
            f"if(next_lo IS NULL, NULL, {midpoint('hi', 'next_lo')}) AS threshold",
            f"if(lo < hi, greatest({', '.join(corners)}), NULL) AS bound")
        best = scored.selectExpr("*", f"max(gain) OVER (PARTITION BY {by}) AS best")
        rows = best.where(f"(gain > 0 AND gain = best) OR bound * {_SLACK!r}D >= best").selectExpr(
            *_KEYS, "bucket", "gain", "threshold", "bound", "ln", "lg", "lh", "tn", "tg", "th",
            "ln - n AS bn", "lg - g AS bg", "lh - h AS bh").collect()
        return [r.asDict() for r in rows]

    def _inner(self, model: Model, trees: list[BoostedTree], level: list[tuple[int, int]], opened: list[dict]) -> list[dict]:
        """The best cut inside each opened bucket (its gain is null if none gains), and quantiles of its distinct values."""
        columns = sorted({r["feature"] for r in opened})
        place, slot_of = self._placed(model, columns, trees, level), {key: i for i, key in enumerate(level)}
        wanted = {f: np.zeros((len(level), len(self.edges[f]) + 2), bool) for f in columns}
        for r in opened:
            wanted[r["feature"]][slot_of[r["t"], r["node"]], r["bucket"]] = True
        open_nodes = np.array(level).reshape(-1, 2)
        ends = {f: np.append(self.edges[f], np.inf) for f in columns}
        of_start = {f: {int(np.searchsorted(self.first_edges[f], ends[f][r["bucket"]], "left"))
                        for r in opened if r["feature"] == f} for f in columns}
        source = self._rows(of_start)

        def run(batches):
            for batch in batches:
                x, buckets, found = place(batch)
                for slot, rows, sums in found:
                    for f in columns:
                        hit = np.flatnonzero(wanted[f][slot, buckets[f][rows]])
                        at = open_nodes[slot[hit]]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(v.astype(np.int32)) for v in (at[:, 0], at[:, 1], np.full(len(hit), f), buckets[f][rows[hit]])]
                            + [pa.array(x[f][rows[hit]] + 0.0)] + [pa.array(s[hit]) for s in sums],
                            names=["t", "node", "feature", "bucket", "value", "n", "g", "h"])

        schema = "t int, node int, feature int, bucket int, value double, n long, g long, h long"
        values = source.mapInArrow(run, schema).groupBy(*_KEYS, "bucket", "value").agg(*[F.sum(s).alias(s) for s in _SUMS])
        # One row per opened bucket: at most columns x buckets of the open nodes.
        names = [*_KEYS, "bucket", "bn", "bg", "bh", "tn", "tg", "th"]
        kinds = [pa.int32()] * 4 + [pa.int64()] * 6
        starts = self.kept.sparkSession.createDataFrame(pa.table(
            [pa.array([r[c] for r in opened], k) for c, k in zip(names, kinds)], names=names))
        inside = f"(PARTITION BY {', '.join(_KEYS)}, bucket ORDER BY value"
        upto = f"{inside} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        swept = values.selectExpr("*", *[f"sum({s}) OVER {upto} AS c{s}" for s in _SUMS], f"lead(value) OVER {inside}) AS next") \
            .join(F.broadcast(starts), [*_KEYS, "bucket"])
        scored = swept.selectExpr(
            *_KEYS, "bucket", "value", f"if(next IS NULL, NULL, {midpoint('value', 'next')}) AS threshold",
            *[f"b{s} + c{s} AS l{s}" for s in _SUMS], "tn", "tg", "th",
        ).selectExpr("*", f"if(threshold IS NULL, NULL, {self._gain('ln', 'lg')}) AS gain")
        cut = "struct(gain, threshold, ln, lg, lh, tn, tg, th)"
        shares = ", ".join(f"{i / PIECES!r}D" for i in range(1, PIECES + 1))
        best = scored.groupBy(*_KEYS, "bucket").agg(
            F.expr(f"max_by({cut}, struct(gain, -threshold)) FILTER (WHERE gain > {LEAST_GAIN!r}D * tn) AS _b"),
            F.expr(f"percentile_approx(value, array({shares}), 1000) AS pieces")).select(*_KEYS, "pieces", "_b.*")
        return [r.asDict() for r in best.collect()]

    def _refine(self, opened: list[dict], cuts: list[tuple[int, float]]) -> None:
        """Borders at the cuts made inside buckets, and inside the buckets that were opened: later rounds mostly cut near
        the same places."""
        for f in sorted({r["feature"] for r in opened}):
            finer = np.union1d(self.edges[f], [t for of, t in cuts if of == f])
            pieces = np.union1d(finer, [e for r in opened if r["feature"] == f for e in r["pieces"] if math.isfinite(e)])
            if len(pieces) <= self.most_edges:
                finer = pieces
            self.edges[f] = finer


def _number(x: float) -> str:
    return f"double('{float(x)!r}')" if math.isfinite(x) else f"double('{'-' if x < 0 else ''}Infinity')"


def bucket_count(columns: int, n_classes: int, max_depth: int, buckets: int = BUCKETS) -> int:
    """As many buckets as a task can hold sums of for the widest level, but 16 at least."""
    trees = 1 if n_classes == 2 else n_classes
    return min(buckets, max(16, TASK_SUMS // (FINEST * trees * columns * 2 ** (max_depth - 1))))


def boost(df: DataFrame, label: str, numeric: list[str], n_classes: int, scratch: Scratch, n_estimators: int = 100,
          learning_rate: float = 0.1, max_depth: int = 1, buckets: int = BUCKETS) -> Model:
    """Boosted trees of ``max_depth`` splits on a path, on the given numeric columns.  Labels are 0..n_classes-1.

    ``buckets`` changes the speed only.
    """
    wide = spread(df.where(F.col(label).isNotNull()).selectExpr(
        f"int({quoted(label)}) AS _y", "1L AS _w", *[f"nanvl(double({quoted(c)}), NULL) + 0.0D AS x{i}" for i, c in enumerate(numeric)]))
    kept = scratch.keep(wide, "boosting")
    names, count = [f"x{i}" for i in range(len(numeric))], bucket_count(len(numeric), n_classes, max_depth, buckets)
    found = kept.approxQuantile(names, [i / count for i in range(1, count)], 1 / (4 * count)) if names else []
    edges = [sorted({e for e in of or [] if math.isfinite(e)}) for of in found]
    return Booster(kept, len(numeric), n_classes, n_estimators, learning_rate, max_depth, edges, scratch).fit()
