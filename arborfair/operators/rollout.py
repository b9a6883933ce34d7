"""Rollout trees: at each node the test whose two greedy subtrees have the smallest loss."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import Scratch
from .binarize import BinaryFeatures
from .cells import Cell
from .exact import ranked_splits
from .greedy import grow, whole_table
from .patterns import compact
from .tree import Tree, leaf_of, split_of, subtree_loss, to_tree


def rollout_tree(
    df: DataFrame, label: str, features: BinaryFeatures, n_classes: int, budget: int = 5,
    reg: float = 1e-4, max_features: int = 0,
) -> Tree:
    """At most ``budget`` splits on a path.

    All candidate tests of all open nodes are tried together: their two sides are the cells
    of one greedy growth.  The best test splits its node if its summed loss is below the leaf's.
    ``Tree.info["selection_loss"]`` is the estimate at the root when it was chosen.
    """
    with Scratch(df.sparkSession) as scratch:
        patterns = compact(df, features, label, n_classes, scratch)
        n_rows, size = patterns.n_rows, patterns.n_features
        chosen: dict[str, tuple[int, Cell, Cell]] = {}
        root = whole_table(patterns)
        frontier = [("", root)]
        selection_loss = subtree_loss(leaf_of(root), n_rows, reg)
        for depth in range(budget, 0, -1):
            # A node without errors beyond its minority rows stays a leaf whatever is tried.
            frontier = [
                (p, c) for p, c in frontier
                if c.n >= 2 and (c.errors - c.minority) / n_rows > reg
            ]
            if not frontier or not size:
                break
            cells = [c for _, c in frontier]
            sides, trials = [], []
            tried = ranked_splits(patterns, cells, max_features, disjoint=True)
            for i, (_order, children) in enumerate(tried):
                for _rank, fid, a, b in children:
                    trials.append((i, fid, a, b))
                    sides += [a, b]
            subs = grow(patterns, sides, [depth - 1] * len(sides), reg, max_features)
            best = {
                i: (subtree_loss(leaf_of(c), n_rows, reg), None)
                for i, c in enumerate(cells)
            }
            for k, (i, fid, a, b) in enumerate(trials):
                loss = round(
                    subtree_loss(subs[2 * k], n_rows, reg) + subtree_loss(subs[2 * k + 1], n_rows, reg), 12
                )
                if loss < best[i][0]:
                    best[i] = (loss, (fid, a, b))
            grown = []
            for i, (path, _cell) in enumerate(frontier):
                loss, pick = best[i]
                if path == "":
                    selection_loss = loss
                if pick is not None:
                    chosen[path] = pick
                    grown += [(path + "T", pick[1]), (path + "F", pick[2])]
            frontier = grown

        def build(path: str, cell: Cell) -> tuple:
            if path not in chosen:
                return leaf_of(cell)
            fid, a, b = chosen[path]
            return split_of(fid, build(path + "T", a), build(path + "F", b))

        tree = to_tree(build("", root), features, n_rows, reg)
        tree.info = {"selection_loss": selection_loss}
        return tree
