"""Greedy information-gain trees, grown for many cells at once, one Spark job per level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import SCORE_DIGITS, information_gain, plus
from .cells import MAX_CELLS, Cell, Order, cell_counts, split_counts, with_gain
from .patterns import Patterns
from .tree import count_errors, count_leaves, leaf_of, split_of

MIN_CANDIDATES = 5


def level_candidates(size: int, remaining: int, budget: int) -> int:
    """How many of ``size`` ranked tests a node may try: all at the top, fewer further down."""
    if remaining >= budget:
        return size
    return min(size, max(MIN_CANDIDATES, int(size * (remaining / max(budget, 1)))))


def can_improve(cell: Cell, n_rows: int, reg: float) -> bool:
    """False if no tree on this cell can beat its leaf.

    A split adds at least one leaf (``reg``) and can at best remove the errors that are not
    minority rows of a pattern.
    """
    return (cell.errors - cell.minority) / n_rows > reg


def feature_gains(patterns: Patterns) -> DataFrame:
    """``fid, gain`` of every test on the whole table; constant tests have gain -1."""
    size, classes = patterns.n_features, range(patterns.n_classes)
    counts = cell_counts(patterns, [whole_table(patterns)], [Order()], [size], disjoint=True)
    t, n = [f"t{c}" for c in classes], [f"n{c}" for c in classes]
    gain = f"round({information_gain(t, n)}, {SCORE_DIGITS})"
    return counts.selectExpr(
        "fid", f"if({plus(t)} = 0 OR {plus(t)} = {plus(n)}, -1.0D, {gain}) AS gain"
    )


def rank_features(patterns: Patterns, max_features: int) -> DataFrame:
    """``fid, gain`` of the ``max_features`` tests of largest gain (lower fid wins a tie)."""
    return feature_gains(patterns).orderBy(F.desc("gain"), "fid").limit(max_features)


def _ranked_best(counts: DataFrame, n_classes: int, max_features: int, n_features: int) -> DataFrame:
    """Best test of each cell, and the ``max_features`` best in order."""
    scored = with_gain(counts, n_classes)
    order = F.transform(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("gain")).alias("g"), F.col("fid")))), 1, max_features),
        lambda s: s["fid"],
    )
    best = F.max_by(F.struct("*"), F.struct(F.col("gain"), -F.col("fid")))
    return scored.groupBy("cell").agg(best.alias("best"), order.alias("order"))


def grow(
    patterns: Patterns,
    roots: list[Cell],
    budgets: Sequence[int],
    reg: float,
    max_features: int = 0,
    orders: list[Order] | None = None,
    pick_first: bool = False,
    narrow: bool = True,
    disjoint: bool = False,
    max_cells: int = MAX_CELLS,
) -> list[tuple]:
    """One subtree per root cell.  A budget of ``d`` allows ``d - 1`` splits on a path.

    Each node takes the test of largest gain (lower rank wins a tie); with ``pick_first`` the
    first test in rank order with a positive gain.  Afterwards a split is kept only if the
    losses of its two sides add up to less than the loss of the leaf.  With ``max_features``
    every root ranks the tests on its own rows and keeps that many.  ``disjoint`` promises that
    the roots share no rows.
    """
    n_rows, C, n_features = patterns.n_rows, patterns.n_classes, patterns.n_features
    rank_here = orders is None and 0 < max_features < n_features
    natural = Order()
    root_orders = list(orders) if orders is not None else [natural] * len(roots)
    chosen: dict[tuple[int, str], tuple[int, Cell, Cell]] = {}
    frontier = [(i, "", cell, b) for i, (cell, b) in enumerate(zip(roots, budgets))]
    while True:
        frontier = [
            f for f in frontier if f[3] > 1 and f[2].n >= 2 and can_improve(f[2], n_rows, reg)
        ]
        if not frontier or not n_features:
            break
        # Roots with the same cell and budget differ only by the caller's order.
        at_root = rank_here and frontier[0][1] == ""
        limits = []
        for i, _path, _cell, remaining in frontier:
            size = n_features if at_root else root_orders[i].size(n_features)
            limits.append(level_candidates(size, remaining, budgets[i]) if narrow else size)
        counts = cell_counts(
            patterns, [f[2] for f in frontier], [root_orders[f[0]] for f in frontier], limits,
            disjoint=disjoint or len(roots) == 1, max_cells=max_cells, pick=None if at_root or pick_first else "gain",
        )
        if at_root:
            picked = _ranked_best(counts, C, max_features, n_features)
        else:
            first = F.when(F.col("gain") > 0, F.lit(1)).otherwise(0)
            score = (
                F.struct(first, F.when(first == 1, F.lit(0.0)).otherwise(F.col("gain")), -F.col("rank"))
                if pick_first
                else F.struct(F.col("gain"), -F.col("rank"))
            )
            picked = with_gain(counts, C).groupBy("cell").agg(
                F.max_by(F.struct("*"), score).alias("best")
            )
        grown = []
        for row in picked.collect():
            i, path, cell, remaining = frontier[row["cell"]]
            if at_root:
                fids = list(row["order"])
                # Constant tests fill the list up to its size, but never split anything.
                size = min(max_features, n_features)
                root_orders[i] = Order(fids + [f for f in range(n_features) if f not in set(fids)][: size - len(fids)])
            best = row["best"]
            t, tm, f, fm = split_counts(best, C)
            left = cell.child(best["fid"], True, t, tm)
            right = cell.child(best["fid"], False, f, fm)
            chosen[(i, path)] = (best["fid"], left, right)
            grown += [(i, path + "T", left, remaining - 1), (i, path + "F", right, remaining - 1)]
        frontier = grown

    def collapse(i: int, path: str, cell: Cell) -> tuple:
        leaf = leaf_of(cell)
        if (i, path) not in chosen:
            return leaf
        fid, left, right = chosen[(i, path)]
        sub = split_of(fid, collapse(i, path + "T", left), collapse(i, path + "F", right))
        return sub if is_better(sub, leaf, n_rows, reg) else leaf

    return [collapse(i, "", cell) for i, cell in enumerate(roots)]


def is_better(sub: tuple, leaf: tuple, n_rows: int, reg: float) -> bool:
    """Strictly smaller loss, compared after rounding."""
    def loss(part: tuple) -> float:
        return round(count_errors(part) / n_rows + reg * count_leaves(part), SCORE_DIGITS)

    return loss(sub) < loss(leaf)


def whole_table(patterns: Patterns) -> Cell:
    return Cell((), patterns.class_counts, patterns.minority)
