"""A set of different trees whose objectives lie close to the best one found."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from ..session import Scratch
from .binarize import BinaryFeatures
from .cells import Order
from .exact import MAX_CELLS, search
from .forest import Forest
from .greedy import grow, whole_table
from .lookahead import check_depths
from .patterns import compact
from .tree import Tree, leaf_cells, replace_leaves, shape, subtree_loss, to_tree


@dataclass
class TreeSet:
    """Trees by rising objective."""

    trees: list[Tree]

    def __len__(self) -> int:
        return len(self.trees)

    def __getitem__(self, index: int) -> Tree:
        return self.trees[index]

    def objective(self, index: int = 0) -> float:
        return self.trees[index].objective

    def predict(self, index: int = 0) -> Column:
        if index >= len(self.trees):
            raise IndexError(f"tree {index} asked for, {len(self.trees)} present")
        return self.trees[index].predict()

    def score(self, df: DataFrame, count: int = 3, prefix: str = "prediction") -> DataFrame:
        """``df`` and the predictions of the best ``count`` trees (all, if fewer), side by side in one pass."""
        return Forest(self.trees[:count]).score(df, prefix)

    def table(self, spark: SparkSession) -> DataFrame:
        """``tree_id, rank, objective, n_leaves``."""
        rows = [(i, i + 1, t.objective, t.num_leaves()) for i, t in enumerate(self.trees)]
        return spark.createDataFrame(rows, "tree_id int, rank int, objective double, n_leaves int")


def shuffled(n_features: int, seed: int, draw: int) -> Order:
    """A reproducible random order of the tests."""
    def key(fid: int) -> str:
        return hashlib.md5(f"{fid}:{seed}:{draw}".encode()).hexdigest()

    return Order(sorted(range(n_features), key=key))


def near_optimal_trees(
    df: DataFrame, label: str, features: BinaryFeatures, n_classes: int, lookahead: int = 3,
    budget: int = 5, reg: float = 1e-4, tolerance: float = 0.01, n_prefixes: int = 20,
    max_features: int = 0, seed: int = 42, max_cells: int = MAX_CELLS,
) -> TreeSet:
    """Random greedy prefixes, completed at every leaf, without doubles, within the tolerance.

    Prefixes have at most ``lookahead - 1`` splits on a path.  Each of their leaves gets a greedy
    completion and, if it differs, an optimal one, of depth ``budget - lookahead``.  All prefixes
    grow in the same jobs, and so do all their completions.  A budget of 0 is no fixed depth: the
    prefixes are the trees.
    """
    open_end = budget == 0
    check_depths(lookahead, lookahead if open_end else budget)
    with Scratch(df.sparkSession) as scratch:
        patterns = compact(df, features, label, n_classes, scratch)
        n_rows, root = patterns.n_rows, whole_table(patterns)
        orders = [shuffled(patterns.n_features, seed, i) for i in range(n_prefixes)]
        prefixes = grow(
            patterns, [root] * n_prefixes, [lookahead] * n_prefixes, reg,
            orders=orders, pick_first=True,
        )
        # Equal prefixes have equal completions.
        prefixes = list({shape(p): p for p in prefixes}.values())
        remaining = 0 if open_end else budget - lookahead
        candidates: dict[str, tuple] = {}
        if remaining == 0:
            candidates = {shape(p): p for p in prefixes}
        else:
            owners, cells = [], []
            for i, prefix in enumerate(prefixes):
                for path, cell in leaf_cells(prefix):
                    owners.append((i, path))
                    cells.append(cell)
            greedy = grow(patterns, cells, [remaining] * len(cells), reg, max_features)
            best = search(patterns, cells, [remaining] * len(cells), reg, max_features, max_cells=max_cells)
            options: list[dict[str, list[tuple]]] = [{} for _ in prefixes]
            for (i, path), g, b in zip(owners, greedy, best):
                options[i][path] = [g] if shape(g) == shape(b) else [g, b]
            for prefix, choice in zip(prefixes, options):
                for k in range(max(len(o) for o in choice.values())):
                    tree = replace_leaves(prefix, {p: o[k % len(o)] for p, o in choice.items()})
                    candidates.setdefault(shape(tree), tree)
        scored = [(subtree_loss(t, n_rows, reg), t) for t in candidates.values()]
        limit = min(loss for loss, _ in scored) * (1.0 + tolerance)
        kept = sorted((s for s in scored if s[0] <= limit), key=lambda s: s[0])
        return TreeSet([to_tree(t, features, n_rows, reg) for _, t in kept])
