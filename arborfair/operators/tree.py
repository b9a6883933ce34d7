"""Fitted trees: a table of nodes keyed by path, scored by plain column expressions."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import at_most, quoted, text_literal
from .binarize import BinaryFeatures

NODE_SCHEMA = (
    "node_path string, feature string, fid int, is_numeric boolean, threshold double, "
    "left_categories array<string>, prediction double, loss double, n bigint, impurity double"
)


@dataclass(frozen=True)
class TreeNode:
    """A split (``prediction`` is null) or a leaf.  The first branch letter is the true side."""

    path: str
    feature: str | None = None
    fid: int | None = None
    is_numeric: bool | None = None
    threshold: float | None = None
    left_categories: tuple[str, ...] | None = None
    prediction: float | None = None
    loss: float | None = None
    n: int | None = None
    impurity: float | None = None
    name: str | None = None

    @property
    def is_leaf(self) -> bool:
        return self.prediction is not None

    def test(self) -> str:
        """The condition of the first branch as SQL text; false for missing values."""
        if self.is_numeric:
            return at_most(self.feature, self.threshold)
        values = ", ".join(text_literal(c) for c in self.left_categories)
        return f"coalesce({quoted(self.feature)} IN ({values}), false)"


@dataclass
class Tree:
    """``branches`` names the two sides: "LR" for raw-feature trees, "TF" for binary ones."""

    nodes: dict[str, TreeNode]
    branches: str = "LR"
    classes: list | None = None
    objective: float | None = None
    integer_labels: bool = True
    info: dict = field(default_factory=dict)

    # -- scoring -------------------------------------------------------------------

    def route(self, leaf: Callable[[TreeNode], str], path: str = "") -> str:
        """Nested IF as SQL text, with ``leaf(node)`` at the leaves."""
        node = self.nodes[path]
        if node.is_leaf:
            return leaf(node)
        first, second = self.branches
        return f"if({node.test()}, {self.route(leaf, path + first)}, {self.route(leaf, path + second)})"

    def predict(self) -> Column:
        """The prediction of a row, so scoring needs no join, shuffle or Python."""
        if self.integer_labels:
            return F.expr(self.route(lambda n: f"{int(n.prediction)}"))
        return F.expr(self.route(lambda n: f"{float(n.prediction)!r}D"))

    def leaf_id(self) -> Column:
        """The path of the leaf a row falls into."""
        return F.expr(self.route(lambda n: text_literal(n.path)))

    def score(self, df: DataFrame, prediction: str = "prediction", leaf: str | None = None) -> DataFrame:
        extra = {prediction: self.predict()}
        if leaf:
            extra[leaf] = self.leaf_id()
        return df.withColumns(extra)

    # -- inspection ----------------------------------------------------------------

    @property
    def leaves(self) -> list[TreeNode]:
        return [n for n in self.nodes.values() if n.is_leaf]

    def num_leaves(self) -> int:
        return len(self.leaves)

    def used_features(self) -> list[str]:
        """Split features breadth first, left before right; repeats are kept."""
        first = self.branches[0]
        order = sorted(self.nodes, key=lambda p: (len(p), [ch != first for ch in p]))
        splits = [self.nodes[p] for p in order if not self.nodes[p].is_leaf]
        return [n.name or n.feature for n in splits]

    def to_dict(self, path: str = "") -> dict:
        node = self.nodes[path]
        if node.is_leaf:
            value = node.prediction
            if self.integer_labels:
                value = self.classes[int(value)] if self.classes else int(value)
            return {"prediction": value, "loss": node.loss}
        shown: dict = {"feature": node.feature}
        if self.branches == "TF":
            shown["feature"] = node.fid
        elif node.is_numeric:
            shown["threshold"] = node.threshold
        else:
            shown["left_categories"] = list(node.left_categories)
        first, second = self.branches
        shown["true"] = self.to_dict(path + first)
        shown["false"] = self.to_dict(path + second)
        return shown

    def __str__(self) -> str:
        return json.dumps(self.to_dict(), default=str)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (n.path, n.feature, n.fid, n.is_numeric, n.threshold,
             None if n.left_categories is None else list(n.left_categories),
             None if n.prediction is None else float(n.prediction), n.loss, n.n, n.impurity)
            for n in sorted(self.nodes.values(), key=lambda n: (len(n.path), n.path))
        ]
        return spark.createDataFrame(rows, NODE_SCHEMA)


def tree_objective(df: DataFrame, tree: Tree, label: str, reg: float) -> DataFrame:
    """One row: errors, leaves and ``errors / rows + reg * leaves`` of a tree on a table."""
    scored = df.select((tree.predict() != F.col(label)).alias("_wrong"))
    return scored.agg(
        F.count("*").alias("n"), F.count_if(F.col("_wrong")).alias("errors")
    ).select(
        "n", "errors", F.lit(tree.num_leaves()).cast("bigint").alias("n_leaves"),
        (F.col("errors") / F.col("n") + F.lit(reg) * F.lit(tree.num_leaves())).alias("objective"),
    )


def leaf_counts(df: DataFrame, tree: Tree, label: str) -> DataFrame:
    """``leaf_id, label, n``: how the labels of a table spread over the leaves."""
    return df.select(tree.leaf_id().alias("leaf_id"), F.col(label).alias("label")).groupBy(
        "leaf_id", "label").agg(F.count("*").alias("n"))


# -- subtrees of binary tests, before they get names and thresholds ---------------------
# A leaf is ("leaf", cell); a split is ("split", fid, true side, false side).


def leaf_of(cell) -> tuple:
    return ("leaf", cell)


def split_of(fid: int, true_side: tuple, false_side: tuple) -> tuple:
    return ("split", fid, true_side, false_side)


def count_leaves(sub: tuple) -> int:
    return 1 if sub[0] == "leaf" else count_leaves(sub[2]) + count_leaves(sub[3])


def count_errors(sub: tuple) -> int:
    return sub[1].errors if sub[0] == "leaf" else count_errors(sub[2]) + count_errors(sub[3])


def shape(sub: tuple) -> str:
    """The structure as text, without losses; equal for equal trees."""
    if sub[0] == "leaf":
        return f"={sub[1].prediction}"
    return f"{sub[1]}({shape(sub[2])},{shape(sub[3])})"


def subtree_loss(sub: tuple, n_rows: int, reg: float) -> float:
    return round(count_errors(sub) / n_rows + reg * count_leaves(sub), 12)


def replace_leaves(sub: tuple, new: dict[str, tuple], path: str = "") -> tuple:
    """Hang ``new[path]`` in the place of each leaf."""
    if sub[0] == "leaf":
        return new.get(path, sub)
    return split_of(
        sub[1], replace_leaves(sub[2], new, path + "T"), replace_leaves(sub[3], new, path + "F")
    )


def leaf_cells(sub: tuple, path: str = "") -> list[tuple]:
    """``(path, cell)`` of every leaf, true side first."""
    if sub[0] == "leaf":
        return [(path, sub[1])]
    return leaf_cells(sub[2], path + "T") + leaf_cells(sub[3], path + "F")


def to_tree(
    sub: tuple, features: BinaryFeatures, n_rows: int, reg: float, classes: list | None = None
) -> Tree:
    """A named tree with its objective, out of a subtree of binary tests."""
    nodes: dict[str, TreeNode] = {}

    def visit(part: tuple, path: str) -> None:
        if part[0] == "leaf":
            cell = part[1]
            nodes[path] = TreeNode(
                path, prediction=cell.prediction, loss=cell.errors / n_rows, n=cell.n
            )
            return
        f = features.features[part[1]]
        numeric = f.op == "<="
        nodes[path] = TreeNode(
            path, feature=f.column, fid=f.fid, is_numeric=numeric,
            threshold=f.threshold if numeric else None,
            left_categories=None if numeric else (f.category,), name=f.name,
        )
        visit(part[2], path + "T")
        visit(part[3], path + "F")

    visit(sub, "")
    return Tree(nodes, "TF", classes, subtree_loss(sub, n_rows, reg))
