"""Greedy trees on raw columns, exact at every boundary, one Spark job per level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import quoted
from ..functions.ranks import ROWS_PER_BUCKET, bucket_edges, with_buckets
from ..session import Scratch, spread
from .binarize import fit_midpoints
from .patterns import positions
from .splits import Statistics, collect_best_splits, collect_best_tests
from .tree import Tree, TreeNode


SORT_ALL_ROWS = 200_000
BUCKETS = 256


def _gini(counts: list[int]) -> float:
    n = sum(counts)
    return 1.0 - sum((c / n) ** 2 for c in counts) if n else 0.0


def _variance(s: list[float]) -> float:
    return max(s[2] / s[0] - (s[1] / s[0]) ** 2, 0.0) if s[0] else 0.0


def _check(task: str, min_samples_leaf: int) -> None:
    if task not in ("classification", "regression"):
        raise ValueError(f"unknown task {task!r}")
    if min_samples_leaf < 1:
        raise ValueError("min_samples_leaf must be at least 1")


def fit_cart(
    df: DataFrame,
    label: str,
    numeric: list[str] | None = None,
    categorical: list[str] | None = None,
    task: str = "classification",
    max_depth: int = 6,
    min_samples_split: int = 20,
    min_samples_leaf: int = 10,
    max_cat_brute_force: int = 10,
    n_classes: int | None = None,
    rows_per_bucket: int = SORT_ALL_ROWS,
) -> Tree:
    """Gini (labels 0..k-1) or variance splits until depth, node size or purity stops a node.

    Numeric rows go left if ``value <= threshold``, categorical rows if the category is in the
    left set; missing values go right.  A leaf predicts its majority class (the smallest on a
    tie) or its mean.  Above ``rows_per_bucket`` rows, numeric columns are cut into buckets and
    only buckets that can hold the best split are sorted; the tree is the same.
    """
    _check(task, min_samples_leaf)
    numeric, categorical = list(numeric or []), list(categorical or [])
    columns = [*numeric, *categorical]
    regression = task == "regression"

    with Scratch(df.sparkSession) as scratch:
        # Every level reads these columns again: they are computed once.
        used = df.select(*columns, F.col(label).cast("double" if regression else "int").alias("_y"))
        source = scratch.keep(spread(used), "rows")
        return _grow(
            source, numeric, categorical, regression, max_depth, min_samples_split,
            min_samples_leaf, max_cat_brute_force, n_classes, rows_per_bucket,
        )


def _grow(
    source: DataFrame, numeric: list[str], categorical: list[str], regression: bool, max_depth: int,
    min_samples_split: int, min_samples_leaf: int, max_cat_brute_force: int,
    n_classes: int | None, rows_per_bucket: int,
) -> Tree:
    columns = [*numeric, *categorical]
    summary = source.agg(
        F.count("_y").alias("n"), F.max("_y").alias("top"), F.avg("_y").alias("mean"),
    ).first()
    if not summary["n"]:
        raise ValueError("no labelled rows")
    # Sums of squares lose digits far from zero, so regression works on the centred target.
    centre = summary["mean"] if regression else 0.0
    if regression:
        source = source.withColumn("_y", F.col("_y") - F.lit(centre))
    stats = Statistics(None if regression else n_classes or int(summary["top"]) + 1)
    edges = {c: [] for c in numeric}
    if summary["n"] > rows_per_bucket:
        buckets = max(BUCKETS, -(-summary["n"] // ROWS_PER_BUCKET))
        edges = bucket_edges(source, numeric, buckets, 1)
        source = with_buckets(source, numeric, edges)
    root = list(source.agg(*stats.aggregates("_y")).first())

    def best(nodes: dict[str, TreeNode], ids: dict[str, int], totals: list[tuple]) -> list[dict]:
        routed = source.withColumn("node", _route_open(nodes, ids)).where(F.col("node").isNotNull())
        return collect_best_splits(
            routed, numeric, categorical, "_y", totals, stats, min_samples_leaf,
            max_cat_brute_force, edges,
        )

    def split(path: str, r: dict, n: int, impurity: float) -> TreeNode:
        is_numeric = r["feature"] < len(numeric)
        return TreeNode(
            path, feature=columns[r["feature"]], is_numeric=is_numeric,
            threshold=r["threshold"],
            left_categories=None if is_numeric else tuple(r["left_categories"]),
            n=n, impurity=impurity,
        )

    nodes = _levels(root, centre, regression, max_depth, min_samples_split, best if columns else None, split)
    return Tree(nodes, "LR", integer_labels=not regression)


def _levels(
    root: list, centre: float, regression: bool, max_depth: int, min_samples_split: int,
    best: Callable[[dict[str, TreeNode], dict[str, int], list[tuple]], list[dict]] | None,
    split: Callable[[str, dict, int, float], TreeNode],
) -> dict[str, TreeNode]:
    """Grow level by level: ``best`` finds the splits of all open nodes, ``split`` makes a node of one."""
    root_impurity = _variance(root) if regression else _gini(root)
    nodes: dict[str, TreeNode] = {}
    open_nodes: dict[str, list] = {"": root}

    def leaf(path: str, s: list) -> TreeNode:
        if regression:
            value, n, impurity = s[1] / s[0] + centre, int(s[0]), _variance(s)
        else:
            value, n, impurity = s.index(max(s)), sum(s), _gini(s)
        return TreeNode(path, prediction=value, n=n, impurity=impurity)

    for depth in range(max_depth + 1):
        splittable = {}
        for path, s in open_nodes.items():
            nodes[path] = leaf(path, s)
            n, impurity = nodes[path].n, nodes[path].impurity
            pure = impurity <= 1e-12 * root_impurity if regression else max(s) == n
            if depth < max_depth and n >= min_samples_split and not pure:
                splittable[path] = s
        if not splittable or best is None:
            break
        ids = {path: i for i, path in enumerate(sorted(splittable))}
        totals = [tuple(splittable[p]) for p in ids]
        paths = {i: p for p, i in ids.items()}
        open_nodes = {}
        for r in best(nodes, ids, totals):
            path = paths[r["node"]]
            s = splittable[path]
            left = [r[f"l{i}"] for i in range(len(s))]
            nodes[path] = split(path, r, nodes[path].n, nodes[path].impurity)
            open_nodes[path + "L"] = left
            open_nodes[path + "R"] = [a - b for a, b in zip(s, left)]
    return nodes


def _route_open(nodes: dict[str, TreeNode], ids: dict[str, int]) -> Column:
    """The number of the open node a row has reached; null in a finished leaf."""
    return F.expr(Tree(nodes, "LR").route(lambda n: f"int({ids.get(n.path, 'NULL')})"))


def fit_cart_on_tests(
    df: DataFrame, label: str, numeric: list[str], categorical: list[str],
    max_thresholds: int = 50, task: str = "classification", max_depth: int = 6, min_samples_split: int = 20,
    min_samples_leaf: int = 10, n_classes: int | None = None, **kw,
) -> Tree:
    """CART on the 0/1 columns of the midpoint binarizer; the tree is returned on raw columns.

    Rows that answer all tests alike and share their label are one row with a count, so a level reads patterns and
    counts one position per input column, not one answer per test.  A row with answer 1 is on the right of a 0/1
    split at one half, as in :func:`fit_cart` on the answers; "T" of a binary test is that side, so the two
    branches are swapped to get tests on the raw columns.
    """
    _check(task, min_samples_leaf)
    if unknown := set(kw) - {"max_cat_brute_force", "rows_per_bucket"}:  # without use on 0/1 columns
        raise TypeError(f"unknown options {sorted(unknown)}")
    regression = task == "regression"
    features = fit_midpoints(df, numeric, categorical, max_thresholds)
    with Scratch(df.sparkSession) as scratch:
        used = dict.fromkeys(f.column for f in features.features)
        y = F.col(label).cast("double" if regression else "int").alias("_y")
        placed, ranges = positions(spread(df.select(y, *[F.col(quoted(c)) for c in used])), features, ["_y"])
        grouped = placed.groupBy(*placed.columns).agg(F.count(F.lit(1)).alias("_n"))
        patterns = scratch.keep(grouped, "patterns")
        summary = patterns.agg(
            F.expr("coalesce(sum(_n) FILTER (WHERE _y IS NOT NULL), 0L)").alias("n"), F.max("_y").alias("top"),
            F.expr("sum(_y * _n) / sum(_n) FILTER (WHERE _y IS NOT NULL)").alias("mean"),
        ).first()
        if not summary["n"]:
            raise ValueError("no labelled rows")
        centre = summary["mean"] if regression else 0.0
        if regression:
            patterns = patterns.withColumn("_y", F.col("_y") - F.lit(centre))
        stats = Statistics(None if regression else n_classes or int(summary["top"]) + 1)
        sums = stats.weighted("_y", "_n")
        keys = [c for c in placed.columns if c != "_y"]

        def best(nodes: dict[str, TreeNode], ids: dict[str, int], totals: list[tuple]) -> list[dict]:
            routed = patterns.withColumn("node", F.expr(_route_ranges(nodes, ids, ranges))).where("node IS NOT NULL")
            return collect_best_tests(routed, keys, ranges, sums, totals, stats, min_samples_leaf)

        def split(path: str, r: dict, n: int, impurity: float) -> TreeNode:
            return TreeNode(path, fid=r["feature"], feature=str(r["feature"]), n=n, impurity=impurity)

        root = list(patterns.agg(*sums).first())
        nodes = _levels(root, centre, regression, max_depth, min_samples_split, best if len(features) else None, split)
    swap = str.maketrans("LR", "RL")
    raw = {}
    for path, node in nodes.items():
        swapped = path.translate(swap)
        if node.is_leaf:
            raw[swapped] = TreeNode(
                swapped, prediction=node.prediction, n=node.n, impurity=node.impurity
            )
            continue
        f = features.features[node.fid]
        raw[swapped] = TreeNode(
            swapped, feature=f.column, fid=f.fid, is_numeric=f.op == "<=", threshold=f.threshold,
            left_categories=None if f.op == "<=" else (f.category,), n=node.n,
            impurity=node.impurity, name=f.name,
        )
    return Tree(raw, "LR", integer_labels=not regression)


def _route_ranges(nodes: dict[str, TreeNode], ids: dict[str, int], ranges: list[tuple[int, int, int]], path: str = "") -> str:
    """As :func:`_route_open`, for patterns; a test that holds leads to the right."""
    node = nodes[path]
    if node.is_leaf:
        return f"int({ids.get(path, 'NULL')})"
    column, low, high = ranges[node.fid]
    right, left = (_route_ranges(nodes, ids, ranges, path + side) for side in "RL")
    return f"if(k{column} BETWEEN {low} AND {high}, {right}, {left})"
