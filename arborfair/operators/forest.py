"""Many trees as data: one projection walks them all, level by level.

A fitted tree alone is scored by nested conditions (``Tree.route``), whose text grows with its nodes.  Here the nodes of all trees
are entries of a few constant arrays (test, threshold, both children, prediction), and a tree is a position in them.  One step moves
every tree's position from a node to a child; after as many steps as the deepest tree has levels all positions are leaves.  The plan has
one expression per level, however many trees there are, and scoring needs no join, shuffle or Python.

Cases: null, NaN and categories never seen fail a test, as in ``Tree.route``; a tree of one leaf is a tree; no trees give an empty array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import quoted
from .tree import Tree, TreeNode


def _constant(values: Sequence, kind: str) -> Column:
    """An array that is folded into one constant; as text it costs one expression instead of one per entry."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


class Forest:
    """The nodes of ``trees``, in one numbering.  ``inputs`` are the distinct values that tests compare with thresholds: numeric
    columns, and for each set of categories 0 (in the set) or 1."""

    def __init__(self, trees: Sequence[Tree]):
        self.n_trees = len(trees)
        self.integer_labels = all(t.integer_labels for t in trees)
        self.depth = max((len(p) for t in trees for p in t.nodes), default=0)
        self.inputs: list[str] = []
        self.roots, self.slots, self.thresholds, self.first, self.second, self.values, self.paths = ([] for _ in range(7))
        known: dict[str, int] = {}
        for tree in trees:
            number = {path: len(self.paths) + i for i, path in enumerate(tree.nodes)}
            self.roots.append(number[""])
            for path, node in tree.nodes.items():
                here = number[path]
                if node.is_leaf:  # a leaf is its own child
                    slot, threshold, sides = 0, 0.0, (here, here)
                else:
                    source, threshold = self._input(node)
                    slot = known.setdefault(source, len(known))
                    sides = tuple(number[path + b] for b in tree.branches)
                self.slots.append(slot)
                self.thresholds.append(repr(float(threshold)))
                self.first.append(sides[0])
                self.second.append(sides[1])
                self.values.append(repr(float(node.prediction)) if node.is_leaf else "0.0")
                self.paths.append(path)
        self.inputs = list(known)

    @staticmethod
    def _input(node: TreeNode) -> tuple[str, float]:
        if node.is_numeric:
            return f"double({quoted(node.feature)})", node.threshold
        return f"if({node.test()}, 0D, 1D)", 0.5

    def positions(self) -> Column:
        """The number of the leaf that a row reaches, per tree."""
        def step(row: Column):
            def move(p: Column) -> Column:
                value = F.get(row["values"], F.get(row["slots"], p))
                return F.when(value <= F.get(row["thresholds"], p), F.get(row["first"], p)).otherwise(F.get(row["second"], p))
            return move

        def walk(row: Column) -> Column:
            at = _constant(self.roots, "int")
            for _ in range(self.depth):
                at = F.transform(at, step(row))
            return at

        values = F.array(*map(F.expr, self.inputs)) if self.inputs else F.array(F.lit(0.0))
        # All that the steps read is bound once: every constant stands in the plan once, and no value is worked out twice for a row.
        bound = F.struct(values.alias("values"), _constant(self.thresholds, "double").alias("thresholds"),
                         *[_constant(getattr(self, c), "int").alias(c) for c in ("slots", "first", "second")])
        return F.get(F.transform(F.array(bound), walk), F.lit(0))

    def predictions(self) -> Column:
        """The predictions of all trees as an array, in the order of the trees."""
        values = _constant(self.values, "double")
        found = F.transform(self.positions(), lambda p: F.get(values, p))
        return found.cast("array<int>") if self.integer_labels else found

    def leaf_ids(self) -> Column:
        """The paths of the leaves that a row reaches, per tree."""
        paths = _constant(self.paths, "string")
        return F.transform(self.positions(), lambda p: F.get(paths, p))

    def score(self, df: DataFrame, prefix: str = "prediction") -> DataFrame:
        """``df`` and a column ``<prefix>_<i>`` per tree, from 1; the trees are walked once for all of them."""
        name = "_all"
        while name in df.columns:
            name += "_"
        walked = df.select("*", self.predictions().alias(name))
        return walked.select(*[F.col(quoted(c)) for c in df.columns], *[F.get(name, F.lit(i)).alias(f"{prefix}_{i + 1}") for i in range(self.n_trees)])
