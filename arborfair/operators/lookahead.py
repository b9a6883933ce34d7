"""Lookahead trees: an exact search near the root, greedy below, then a refill of the leaves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..session import Scratch
from .binarize import BinaryFeatures, fit_midpoints
from .exact import MAX_CELLS, search
from .greedy import grow, whole_table
from .patterns import compact
from .stumps import fit_stump_thresholds
from .tree import Tree, leaf_cells, replace_leaves, subtree_loss, to_tree


@dataclass(frozen=True)
class BinarizerOptions:
    """How numeric columns become tests: "midpoint" or "stump" thresholds."""

    kind: str = "midpoint"
    max_thresholds: int = 50
    n_stumps: int = 100
    stump_depth: int = 1


def fit_binary_features(
    df: DataFrame, label: str, numeric: list[str], categorical: list[str], n_classes: int,
    options: BinarizerOptions = BinarizerOptions(),
) -> BinaryFeatures:
    if options.kind == "midpoint":
        return fit_midpoints(df, numeric, categorical, options.max_thresholds)
    if options.kind == "stump":
        return fit_stump_thresholds(
            df, label, numeric, categorical, n_classes, n_estimators=options.n_stumps, max_depth=options.stump_depth
        )
    raise ValueError(f"unknown binarizer {options.kind!r}")


def greedy_tree(
    df: DataFrame, label: str, features: BinaryFeatures, n_classes: int, budget: int = 3,
    reg: float = 1e-4, max_features: int = 0,
) -> Tree:
    """A greedy tree with at most ``budget - 1`` splits on a path."""
    with Scratch(df.sparkSession) as scratch:
        patterns = compact(df, features, label, n_classes, scratch)
        sub = grow(patterns, [whole_table(patterns)], [budget], reg, max_features)[0]
        return to_tree(sub, features, patterns.n_rows, reg)


def optimal_tree(
    df: DataFrame, label: str, features: BinaryFeatures, n_classes: int, depth: int = 2,
    reg: float = 1e-4, max_features: int = 0, narrow: bool = False, max_cells: int = MAX_CELLS,
    greedy_bound: bool = False,
) -> Tree:
    """The tree of smallest objective with at most ``depth`` splits on a path.

    With ``greedy_bound`` a greedy tree of that depth is grown first, and the search leaves out what cannot
    beat it; the result is the same.  ``Tree.info["opened"]`` has the cells counted per level.
    """
    if depth < 0:
        raise ValueError("depth must not be negative")
    with Scratch(df.sparkSession) as scratch:
        patterns = compact(df, features, label, n_classes, scratch)
        root, bound, opened = whole_table(patterns), None, []
        if greedy_bound and not max_features:  # a ranked search may not have the greedy tree among its trees
            bound = subtree_loss(grow(patterns, [root], [depth + 1], reg, narrow=False)[0], patterns.n_rows, reg)
        sub = search(patterns, [root], [depth], reg, max_features, narrow=narrow, max_cells=max_cells,
                     incumbent=None if narrow else bound, opened=opened)[0]
        tree = to_tree(sub, features, patterns.n_rows, reg)
        tree.info = {"opened": opened, **({} if bound is None else {"greedy_objective": bound})}
        return tree


def lookahead_tree(
    df: DataFrame, label: str, features: BinaryFeatures, n_classes: int, lookahead: int = 2,
    budget: int = 5, reg: float = 1e-4, leaf_fill: str = "optimal", max_features: int = 0,
    max_cells: int = MAX_CELLS, with_greedy: bool = False,
) -> Tree:
    """Exact for the first ``lookahead`` splits, given greedy completions of the rest.

    Then every leaf at depth ``t`` is replaced by the best ("optimal") or the greedy
    ("greedy") tree of depth ``budget - t`` on its rows.  A budget of 0 is none: the prefix is searched without completions and
    every leaf is refilled with a budget of one.  ``Tree.info`` holds the objective of
    the prefix and, with ``with_greedy``, of a plain greedy tree; the search does not need that
    upper bound, because it finds the true minimum.
    """
    open_end = budget == 0
    check_depths(lookahead, lookahead if open_end else budget)
    if leaf_fill not in ("optimal", "greedy"):
        raise ValueError(f"unknown leaf_fill {leaf_fill!r}")
    with Scratch(df.sparkSession) as scratch:
        patterns = compact(df, features, label, n_classes, scratch)
        n_rows, root = patterns.n_rows, whole_table(patterns)
        prefix = search(patterns, [root], [lookahead], reg, max_features,
                        remaining=0 if open_end else budget - lookahead, max_cells=max_cells)[0]
        sub = prefix
        if open_end or budget > lookahead:
            leaves = leaf_cells(prefix)
            cells = [c for _, c in leaves]
            left = [1 if open_end else budget - len(path) for path, _ in leaves]
            if leaf_fill == "optimal":
                filled = search(patterns, cells, left, reg, max_features, max_cells=max_cells, disjoint=True)
            else:
                filled = grow(patterns, cells, left, reg, max_features, disjoint=True, max_cells=max_cells)
            sub = replace_leaves(prefix, {p: f for (p, _), f in zip(leaves, filled)})
        tree = to_tree(sub, features, n_rows, reg)
        tree.info = {"prefix_objective": subtree_loss(prefix, n_rows, reg)}
        if with_greedy:
            start = grow(patterns, [root], [budget], reg, max_features)[0]
            tree.info["greedy_objective"] = subtree_loss(start, n_rows, reg)
        return tree


def check_depths(lookahead: int, budget: int) -> None:
    if lookahead < 1:
        raise ValueError(f"lookahead must be at least 1, got {lookahead}")
    if budget < lookahead:
        raise ValueError(f"budget {budget} is below lookahead {lookahead}")
